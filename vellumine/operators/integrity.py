"""Content digests and re-verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import fixed


def digests(df: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 and MD5 of the content, in one pass over the scan."""
    raw = F.col(content).cast("binary")
    return df.withColumns({"sha256": F.sha2(raw, 256), "md5": F.md5(raw)})


def digest(content: Column, algorithm: str = "sha256") -> Column:
    raw = content.cast("binary")
    if algorithm == "md5":
        return F.md5(raw)
    if algorithm == "sha1":
        return F.sha1(raw)
    return F.sha2(raw, int(algorithm.removeprefix("sha")))


def verify(content: Column, expected: Column, algorithm: str = "sha256") -> Column:
    """True on a match, false on a mismatch, null when the content is missing."""
    return F.when(content.isNotNull(), F.lower(digest(content, algorithm)) == F.lower(expected))


def intake_status(sha256: Column) -> Column:
    return F.when(F.nullif(sha256, F.lit("")).isNotNull(), "Verified").otherwise("Error")


def reverify(registry: DataFrame, scan: DataFrame, on: list[str]) -> DataFrame:
    """Compare stored digests with the current scan.

    ``registry`` holds ``sha256``; ``scan`` holds the same key and ``current_sha256``.
    One equi-join on the path; both sides are narrow (key and digest only).
    """
    joined = registry.join(scan.select(*on, "current_sha256", F.lit(True).alias("_seen")), on, "left")
    status = (
        F.when(F.col("_seen").isNull(), fixed.MISSING_FILE)
        .when(F.col("current_sha256") == F.col("sha256"), fixed.INTEGRITY_VERIFIED)
        .otherwise(fixed.INTEGRITY_CHANGED)
    )
    return joined.withColumn("status", status).drop("_seen")


def verification_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def snapshot(text: Column, file_digest: Column, engine: Column) -> Column:
    """Digest that seals recognised text with its source file and engine."""
    none = F.lit("")
    return F.sha2(F.concat(F.coalesce(text, none), F.coalesce(file_digest, none), F.coalesce(engine, none)), 256)
