"""Threshold labels and rounding shared by many operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from vellumine.functions import fixed


def band(value: Column, bounds: Iterable[tuple[float, str]], floor: str) -> Column:
    """Label of the first bound that ``value`` reaches; ``floor`` below all (and for null)."""
    out = None
    for low, label in bounds:
        out = F.when(value >= low, label) if out is None else out.when(value >= low, label)
    return out.otherwise(floor)


def confidence_level(value: Column) -> Column:
    return band(value, fixed.CONFIDENCE_BANDS, fixed.CONFIDENCE_FLOOR)


def recognition_quality(value: Column) -> Column:
    return band(value, fixed.RECOGNITION_BANDS, "Poor")


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, as interactive languages do.

    ``round`` in Spark is half-up; ``rint`` is one machine instruction and gives
    the same bits in every engine that follows IEEE 754.
    """
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded half-even, 0 when the whole is 0."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(100.0)
    return F.coalesce(half_even(share, digits), F.lit(0.0))


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column; only for the fixed tables, never for data."""
    items = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*items)


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
