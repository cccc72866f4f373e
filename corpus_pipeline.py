"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all rows its predecessor kept and takes any row: nulls in any column,
empty and very long texts, repeated rows, empty tables and extra columns pass through as the
stage's operator defines. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import exact_dedup, mixing, ngram_join, pieces, queries, toxicity
from vellumine.llm.common import free_names, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go; null and empty texts stay."""
    return toxicity.drop_toxic(docs, queries.fitted_toxicity(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked n-gram sets stays, the one with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as their source's target asks."""
    return mixing.training_order(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, their number, and whether the ids give the text back.

    The new columns are ids, n_pieces and round_trip, with a leading underscore where the
    documents have such a column.
    """
    model = pieces.Vocabulary(pieces.MODEL)
    ids, decoded, number, same = free_names(docs, "ids", "decoded", "n_pieces", "round_trip")
    both = pieces.decode(pieces.encode(docs, ids_col=ids, model=model), ids_col=ids, text_col=decoded, model=model)
    back = F.col(decoded).eqNullSafe(F.translate("text", pieces.MARK, " "))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], ids, F.coalesce(F.size(ids), F.lit(0)).cast("long").alias(number), back.alias(same))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources), ("sentencepiece", to_pieces)]

#: SQL cannot score toxicity or segment text; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each stage to what its predecessor wrote.

    Here the mixing stage writes each reading's number and position too, so the rows of the
    result keep their place in training whatever the order in which they are read.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = mixing.readings(docs) if stage is mix_sources else stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
