"""Consecutive numbering inside groups of any size."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 1 << 20  # rows of a group from which it is split, and of a part of it
DRAWN = 64  # rows that the sample has of that many
MOST_BOUNDS = 1024  # parts of one group
STRIDE = 32  # bounds that a row passes at once


def hash_order(*cols: str) -> Column:
    """A well-spread sort key for text keys."""
    return F.xxhash64(*cols)


def _placed(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` with its group and order as one value each; equal orders are told apart by the row."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.withColumns({
        "_g": F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)]),
        "_o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], F.xxhash64(*plain).alias("row"))})


def quantile_bounds(placed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(_g, _bounds): for each group of about ``chunk_rows`` rows or more, the orders that cut it in
    parts of about that size, in at most about ``MOST_BOUNDS`` parts.

    They are quantiles of a sample by hash, 64 rows of every ``chunk_rows``; of a group that has
    more of them than 64 for each part, so many are left by a second hash. Only the group and
    order columns are read. Numbers do not depend on the bounds.
    """
    most = DRAWN * MOST_BOUNDS
    drawn = placed.where(F.pmod(F.xxhash64("_g", "_o"), F.lit(max(1, chunk_rows // DRAWN))) == 0).select("_g", "_o")
    # one row for every ``most`` drawn at the utmost
    large = drawn.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > most)
    thin = F.ceil(F.coalesce("_m", F.lit(1)) / F.lit(most))
    drawn = drawn.join(F.broadcast(large), "_g", "left").where(F.pmod(F.xxhash64("_o", "_g"), thin) == 0)
    ranked = drawn.select("_g", "_o", F.row_number().over(W.partitionBy("_g").orderBy("_o")).alias("_k"), F.count(F.lit(1)).over(W.partitionBy("_g")).alias("_m"))
    step = F.greatest(F.lit(DRAWN if chunk_rows >= DRAWN else 1), F.ceil(F.col("_m") / F.lit(MOST_BOUNDS)))
    return ranked.where(F.col("_k") % step == 0).groupBy("_g").agg(F.array_sort(F.collect_list("_o")).alias("_bounds"))


def _part(bounds: str, order: str) -> Column:
    """How many of the sorted bounds are not above the order: every ``STRIDE``-th is compared, then those behind the last of them."""
    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: b <= F.col(order)))

    passed = below(F.col("_every")) * STRIDE
    return F.coalesce(passed + below(F.slice(bounds, passed + 1, F.lit(STRIDE))), F.lit(0))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "seq", within: Sequence[str] = (),
                measured: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``row_number`` over (group, order) that never sorts a hot group in one task.

    Measured quantiles cut groups of ``chunk_rows`` rows or more; all others take one window.
    Parts are numbered where they are and moved on by the sizes of the parts before them, a
    table of one row per part. Where no group is hot the plan is the window alone. Rows with a
    null group are a group of their own; of rows equal in ``order`` the row's hash decides.

    ``within`` are further columns of few values: every combination is numbered by itself.
    ``measured`` is a table with the group and order columns to measure instead of ``df``,
    where ``df`` is expensive, such as the scan that ``df`` joins.
    """
    from vellumine.session import stored

    placed = _placed(df, group, order)
    bounds = stored(quantile_bounds(placed if measured is None else _placed(measured, group, order), chunk_rows), "bounds")
    parts = ["_g", *within]
    if bounds.isEmpty():
        number = F.row_number().over(W.partitionBy(*parts).orderBy("_o")).cast("long")
        return placed.withColumn(out, number).drop("_g", "_o")
    every = F.filter("_bounds", lambda b, i: (i + 1) % STRIDE == 0)
    # a few rows per hot group: the optimizer broadcasts the file by its size; no row keeps the bounds
    cut = (placed.join(bounds.withColumn("_every", every), "_g", "left")
           .withColumns({"_c": _part("_bounds", "_o"), "_hot": F.col("_bounds").isNotNull()}).drop("_bounds", "_every"))
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*parts, "_c").orderBy("_o")).cast("long"))
    before = W.partitionBy(*parts).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.where("_hot").groupBy(*parts, "_c").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_offset", F.sum("_n").over(before)).drop("_n")
    return (local.join(offsets, [*parts, "_c"], "left")
            .withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0)))
            .select(*[F.col(f"`{c}`") for c in df.columns if c != out], out))
