"""Timestamps at the report edge."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_OFFSET_MINUTES = 330
DEFAULT_SUFFIX = "IST (UTC+05:30)"


def shown_local(ts: Column, naive: bool = True, offset_minutes: int = DEFAULT_OFFSET_MINUTES,
                suffix: str = DEFAULT_SUFFIX) -> Column:
    """Timestamp text in the display zone.

    ``naive=True`` takes the value as already local; otherwise it is an instant in
    UTC and the offset is added. Null and instants at or before the epoch are absent.
    """
    wall = ts.cast("timestamp_ntz")
    if not naive:
        # an instant shows in the session zone when cast: bring it to UTC first
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
        wall = F.when(F.typeof(ts) == "timestamp", utc).otherwise(wall)
        wall = F.when(wall > F.lit("1970-01-01").cast("timestamp_ntz"),
                      wall + F.expr(f"INTERVAL {int(offset_minutes)} MINUTES"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), F.lit(" " + suffix))
