"""Exact duplicates: local, salted and global combining, whole texts compared throughout.

Every grouping key holds the digest *and* the text, so rows combine only when their texts
are identical. Spark combines inside each map task first (the local step), then per
(digest, salt), then per digest: a text that a third of all rows share reaches a task as
one row per map task, never as all its copies. The decision returns to the copies over
(digest, salt) as well, so one hot digest is spread over ``salts`` keys there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import free_names

SALTS = 16


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    The largest id of a group of equal texts stays. A null text counts as empty. A null id
    is smaller than every other; in a group of null ids only, keep_id is null and its rows
    count as kept. Rows that repeat id and text carry the same decision each. An empty table
    gives no rows. ``digest`` may be any function of the text: texts that share a digest but
    differ are told apart by content.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body")).select(
        "id", "body", digest(F.col("body")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    whole = whole.select("digest", sha256_of(F.col("body")).alias("text_sha256"), "keep_id", "group_size", "salts")
    # one row per (digest, salt); two texts under one digest differ in text_sha256
    spread = whole.select("digest", "text_sha256", "keep_id", "group_size", F.explode("salts").alias("salt"))
    light = rows.select("id", "digest", "salt", sha256_of(F.col("body")).alias("text_sha256"))
    found = light.join(spread, ["digest", "salt", "text_sha256"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one per text, the largest id.

    Of rows with equal id and text the one with the largest other columns stays (nulls are
    smallest), so exactly one row is left of each text. A null text counts as empty. Columns
    of map or variant type cannot be ordered; cast them first.
    """
    digest_c, salt_c, body_c, row_c = free_names(docs, "digest", "salt", "body", "row")
    rest = [id_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text_col}`").isNotNull().alias("told"))
    rows = docs.select(text.alias(body_c), row.alias(row_c)).select(
        "*", digest(F.col(body_c)).alias(digest_c), F.pmod(F.xxhash64(F.col(row_c)["c0"]), F.lit(salts)).alias(salt_c))
    salted = rows.groupBy(digest_c, salt_c, body_c).agg(F.max(row_c).alias(row_c))
    whole = salted.groupBy(digest_c, body_c).agg(F.max(row_c).alias(row_c))
    at = {c: F.col(row_c)[f"c{i}"] for i, c in enumerate(rest)} | {text_col: F.when(F.col(row_c)["told"], F.col(body_c))}
    return whole.select(*[at[c].alias(c) for c in docs.columns])
