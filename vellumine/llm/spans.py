"""Spans of patterns in whole texts with DataFrame functions only.

Spark gives the matches of a pattern but not their places. Splitting the text by the same
pattern gives what lies between, so a match begins after all gaps and matches before it: a
running sum per (row, kind), in a window that holds one text's matches. Lengths are in code
points. Patterns are written so that no text, however long, makes the matcher go back far:
runs start at their first sign, repeats are possessive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import stored

BEFORE = 4  # pieces between white space that a gap's end is read by: a part of a word, two words, a part


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern and the group that is its value."""

    name: str
    pattern: str
    group: int = 0


def described(rank: int, context: bool):
    """A match as a struct, from its gap, its whole and its value."""
    def one(x: Column, at: Column) -> Column:
        pieces = F.split(x["gap"], r"[\x20\x09-\x0D]+")
        before = F.array_join(F.slice(pieces, F.greatest(F.lit(1), F.size(pieces) - BEFORE + 1), BEFORE), " ") if context else F.lit("")
        whole = (F.size(pieces) >= BEFORE) if context else F.lit(True)
        return F.struct(F.lit(rank).alias("rank"), at.alias("ordinal"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"),
                        x["whole"].alias("whole"), x["value"].alias("value"), before.alias("context"), whole.alias("told"))
    return one


def scanned(docs: DataFrame, text_col: str, kinds: Sequence[Kind], keep: dict[str, Column], context: bool = False) -> DataFrame:
    """A stored table: rid (unique per row), the columns ``keep``, and found.

    found holds a struct per match, in the order of each kind: rank (place of the kind),
    ordinal, gap, size (code points before and of the match), whole, value, context (the last
    words of the gap before the match) and told (the gap has two whole words).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *[c.alias(f"k_{n}") for n, c in keep.items()], text.alias("text"))
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m{i}") for i, k in enumerate(kinds)])
    found = []
    for i, k in enumerate(kinds):
        m = F.col(f"m{i}")
        gaps = F.slice(F.split("text", k.pattern, -1), 1, F.size(m))
        values = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)) if k.group else m

        zipped = F.arrays_zip(gaps.alias("gap"), m.alias("whole"), values.alias("value"))
        found.append(F.when(F.size(m) > 0, F.transform(zipped, described(i, context))))
    empty = F.array().cast("array<struct<rank:int,ordinal:int,gap:int,size:int,whole:string,value:string,context:string,told:boolean>>")
    parts = [F.coalesce(f, empty) for f in found]
    return stored(rows.select("rid", *[F.col(f"k_{n}").alias(n) for n in keep], F.concat(*parts).alias("found")), "scan")


def placed(scan: DataFrame, *carry: str) -> DataFrame:
    """One row per match: rid, ``carry``, rank, start, end, whole, value, context.

    Where the gap before a match has less than two whole words, the context goes back over the
    two matches before it and the ends of their gaps.
    """
    m = scan.select("rid", *carry, F.explode("found").alias("f")).select("rid", *carry, "f.*")
    before = Window.partitionBy("rid", "rank").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    along = Window.partitionBy("rid", "rank").orderBy("ordinal")
    back = lambda c, n: F.coalesce(F.lag(c, n).over(along), F.lit(""))
    longer = F.concat(back("context", 2), back("whole", 2), back("context", 1), back("whole", 1), F.col("context"))
    m = m.withColumn("context", F.when(F.col("told"), F.col("context")).otherwise(longer))
    return m.withColumn("start", start).withColumn("end", F.col("start") + F.col("size")).select("rid", *carry, "rank", "start", "end", "whole", "value", "context")


def listed(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:end of the sorted structs ``spans`` (rank, start, end), comma-joined."""
    label = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(label, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
