"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

A schedule is a list of (time, weight) knots over [0, 1], linear between knots. Its integral
is the source's total weight; targets share the demand by these totals, and no target passes
``most`` times its source. Documents of a source stand in a fixed pseudo-random order; the
running sum of their sizes, divided by the target, is the share of the source's demand met
when they are read, and the inverse of the integrated schedule turns it into a training
position. Running sums go by hash buckets: sums per (source, bucket), offsets over the
buckets, then a window inside each bucket, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import WORD, free_names

Schedule = Sequence[tuple[float, float]]

#: Default curriculum: integrals 5, 2 and 1; the first source fades, the third comes in.
SCHEDULES: tuple[Schedule, ...] = (((0, 7), (1, 3)), ((0, 2), (1, 2)), ((0, 0.5), (1, 1.5)))
BUCKETS_HEX = 3  # hex digits of the order key that name a bucket: 4096 per source
MOST = 3


def area(schedule: Schedule) -> float:
    """Integral of the piecewise linear weight over [0, 1]."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def position_at(share: Column, schedule: Schedule) -> Column:
    """Time at which ``share`` (0 to 1) of the schedule's integral is reached."""
    need, met, out = share * F.lit(float(area(schedule))), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        part = (t1 - t0) * (w0 + w1) / 2
        if part > 0:
            x, slope = need - F.lit(met), (w1 - w0) / (t1 - t0)
            # x = w0 * d + slope * d^2 / 2, in the form that has no zero divisor
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * x, F.lit(0.0)))
            pieces.append((met + part, F.lit(float(t0)) + F.when(x <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * x / (F.lit(float(w0)) + root))))
            met += part
    for end, at in reversed(pieces):
        out = F.when(need <= F.lit(end), at).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(out, F.lit(1.0)))


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, most: float = MOST) -> DataFrame:
    """Per source of ``sizes`` (skey, total): kind (its schedule) and target.

    One row per source, so the two windows over all sources see as many rows as there are
    sources, whatever the number of documents. Sources stand by code point, null last, and
    take the schedules in turn. The level of the water-filling is closed form: in order of
    total/weight, the first source that the level of the remaining weight leaves below its
    limit, and all after it, share what the limited ones left.
    """
    weights = F.array(*[F.lit(float(area(s))) for s in schedules])
    order = Window.orderBy(F.col("skey") == "", "skey")
    s = sizes.withColumn("kind", F.pmod(F.row_number().over(order) - 1, F.lit(len(schedules))))
    s = s.withColumn("w", F.element_at(weights, F.col("kind") + 1)).withColumn("limit", F.lit(float(most)) * F.col("total"))
    by_need = Window.orderBy(F.col("limit") / F.col("w"), "skey")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("total").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(by_need))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("limit") >= F.col("level") * F.col("w"), F.col("place"))).over(everything))
    return s.select("skey", "kind", F.coalesce(F.least("limit", F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        schedules: Sequence[Schedule] = SCHEDULES, most: int = MOST, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and positions (array<double>).

    size is the number of words (null text: 0). A document is read whole, 0 to ``most``
    times: pass k of its source covers the running sums k * source_size + [before, before +
    size), and the document is read in it when the middle of that stretch lies before the
    target, so a source's taken words miss its target by less than one document. positions
    has the training position of each reading. ``carry`` names the columns to keep (default
    all). A null source is a source of its own, last; empty texts are never read. Documents
    stand in the order of md5(id); equal ids are ordered by size and then by a hash of all
    columns, so rows that remain tied are identical. An empty table gives no rows.
    """
    carry = list(docs.columns if carry is None else carry)
    names = free_names(docs.select(*[f"`{c}`" for c in carry]), "skey", "slot", "okey", "tie", "before", "size", "source_size", "target", "copies", "taken", "positions", "kind", "offset")
    skey, slot, okey, tie, before, size, source_size, target, copies, taken, positions, kind, offset = names
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in carry],
                       F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias(skey),
                       F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias(okey),
                       F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias(size))
    rows = rows.withColumn(slot, F.substring(okey, 1, BUCKETS_HEX)).withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in carry]))
    light = docs.select(
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("skey"),
        F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), 1, BUCKETS_HEX).alias("slot"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    slots = light.groupBy("skey", "slot").agg(F.sum("size").alias("n"))
    along = Window.partitionBy("skey").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.withColumn("offset", F.coalesce(F.sum("n").over(along), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("skey")))
    targets = source_targets(slots.groupBy("skey").agg(F.sum("n").alias("total")), schedules, most)
    offsets = offsets.join(targets, "skey").select(F.col("skey").alias(skey), F.col("slot").alias(slot), F.col("offset").alias(offset),
                                                   F.col("total").alias(source_size), F.col("kind").alias(kind), F.col("target").alias(target))
    inside = Window.partitionBy(skey, slot).orderBy(okey, size, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [skey, slot]).withColumn(before, F.col(offset) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    middle = [F.lit(float(k)) * F.col(source_size) + F.col(before) + F.col(size) / 2 for k in range(most)]
    read = [(m < F.col(target)) & (F.col(size) > 0) for m in middle]
    n = sum((r.cast("int") for r in read[1:]), read[0].cast("int"))
    at = [F.coalesce(*[F.when(F.col(kind) == i, position_at(m / F.col(target), s)) for i, s in enumerate(schedules)]) for m in middle]
    spots = F.filter(F.array(*[F.when(r, a) for r, a in zip(read, at, strict=True)]), lambda x: x.isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in carry], size, source_size, target, n.alias(copies), (n * F.col(size)).alias(taken), spots.alias(positions))


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``keys``: files follow the order, nulls last."""
    order = [F.asc_nulls_last(f"`{k}`") for k in keys]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def readings(docs: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs`` and reading (0, 1, ...) and position, one row per reading, by position.

    Documents that the mix does not take are gone, those read k times come k times. The new
    columns have a leading underscore where the documents have such a column.
    """
    mixed = mix(docs, **kw)
    reading, place = free_names(docs, "reading", "position")
    positions = [c for c in mixed.columns if c.endswith("positions")][-1]
    kept = docs.columns if kw.get("carry") is None else kw["carry"]
    rows = mixed.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(positions).alias(reading, place))
    return in_order(rows, place, kw.get("id_col", "doc_id"))


def training_order(docs: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs``, one row per reading, range-sorted by training position.

    As ``readings`` without the columns it adds; the files of the result follow training order.
    """
    return readings(docs, **kw).select(*[f"`{c}`" for c in docs.columns])
