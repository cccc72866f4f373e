"""Personal data with bootstrapped contextual extraction, with DataFrame functions only.

Addresses, numbers and cards that pass their checks are seeds. The words before a seed are
lexical patterns; the same patterns before other words with digits point at identifiers that
no check knows. Scores go round the graph of patterns and instances: a pattern scores the
share of its distinct instances that are trusted, an instance the best of its patterns, seeds
stay at one. After the rounds, words that a high-scoring pattern introduces become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import stored
from vellumine.llm.spans import Kind, listed, placed, scanned

#: Patterns (fixed values). \G lets a match begin right after the one before.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Kind("id", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*+"),
)
NAMES = tuple(k.name for k in KINDS)
BASE = 4
ROUNDS = 3
TRUST = 0.6  # score from which patterns and instances are believed
DOUBT = 4.0  # unknown instances that every pattern is held to have besides its own
DIGITS = 4  # digits of a word that may be an identifier
#: Signs at the ends of a word that are not part of an identifier (fixed value).
TRIM = r"""^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$"""


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (i % 2 + 1))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def checked() -> Column:
    """Whether a match passes the check of its kind; the last kind has none."""
    digits = F.regexp_replace("whole", "[^0-9]", "")
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split("whole", r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(F.substring(plain(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits)
    return (F.when(F.col("rank") == 0, F.lit(True)).when(F.col("rank") == 1, small)
            .when(F.col("rank") == 2, n.between(16, 19) & luhn(F.substring(digits, 1, 19))).when(F.col("rank") == 3, n.between(8, 15)).otherwise(n >= DIGITS))


def patterns_of() -> Column:
    """The last word, and the last two words, before a match; none at the start of a text."""
    words = F.regexp_extract_all(F.lower("context"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    one = F.when(n >= 1, F.element_at(words, -1))
    two = F.when(n >= 2, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))
    return F.filter(F.array(one, two), lambda x: x.isNotNull())


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base, spans, n_found.

    base and spans are texts of kind:start:end (code points, end exclusive) by kind, then
    start, comma-joined; spans has the discovered identifiers (kind id) too, which never
    overlap the others, and n_found counts them. A null text has no spans. Repeated rows are
    scanned each by itself; patterns and instances count once per distinct value. An empty
    table gives no rows.
    """
    scan = scanned(docs, text_col, KINDS, {"id": F.col(f"`{id_col}`")}, context=True)
    found = placed(scan).where(checked())
    lead = F.length("whole") - F.length(F.regexp_replace("whole", r"^[^A-Za-z0-9+]+", ""))
    bare = F.regexp_replace("whole", TRIM, "")
    loose = F.col("rank") == BASE
    found = found.select("rid", "rank", "context", F.when(loose, F.col("start") + lead).otherwise(F.col("start")).alias("start"),
                         F.when(loose, F.col("start") + lead + F.length(bare)).otherwise(F.col("end")).alias("end"), F.when(loose, bare).otherwise(F.col("whole")).alias("value"))
    along = Window.partitionBy("rid").orderBy("start", "rank", "end")
    base_end = F.max(F.when(F.col("rank") < BASE, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("rank") < BASE, F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    clear = ~F.coalesce(base_end > F.col("start"), F.lit(False)) & ~F.coalesce(base_start < F.col("end"), F.lit(False))
    found = stored(found.withColumn("clear", clear).where((F.col("rank") < BASE) | F.col("clear")).select("rid", "rank", "start", "end", "value", patterns_of().alias("patterns")), "instances")

    edges = stored(found.select("value", (F.col("rank") < BASE).alias("seed"), F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    scores = edges.where("seed").select("value", F.lit(1.0).alias("score")).distinct()
    believed = None
    for _ in range(rounds):
        scored = edges.join(stored(scores, "scores").hint("merge"), "value", "left").select("pattern", F.coalesce("score", F.lit(0.0)).alias("score"))
        believed = stored(scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + DOUBT)).alias("trust")).where(F.col("trust") >= trust), "patterns")
        reached = edges.join(believed.hint("merge"), "pattern").groupBy("value").agg(F.max("trust").alias("score"), F.max("seed").alias("seed"))
        scores = reached.where(~F.col("seed")).select("value", "score").unionByName(edges.where("seed").select("value", F.lit(1.0).alias("score")).distinct())
    new = found.where(F.col("rank") == BASE).select("rid", "rank", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(believed.select("pattern").hint("merge"), "pattern").select("rid", "rank", "start", "end").distinct()
    kept = found.where(F.col("rank") < BASE).select("rid", "rank", "start", "end").unionByName(new)
    per_row = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end"))).alias("all"))
    out = scan.select("rid", "id").join(stored(per_row, "rows").hint("merge"), "rid", "left")
    every = F.coalesce("all", F.array().cast("array<struct<rank:int,start:bigint,end:bigint>>"))
    number = lambda i: F.size(F.filter(every, lambda s: s["rank"] == i)).cast("long")
    return out.select(F.col("id").alias(id_col), *[number(i).alias(f"n_{NAMES[i]}") for i in range(BASE)], listed(F.filter(every, lambda s: s["rank"] < BASE), NAMES).alias("base"),
                      listed(every, NAMES).alias("spans"), number(BASE).alias("n_found"))
