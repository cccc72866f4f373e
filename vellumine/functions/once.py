"""Evaluate expensive columns once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def compute_once(df: DataFrame, columns: Mapping[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add SQL expressions whose results later steps read instead of recomputing.

    Plain projections are merged by the optimizer and a later filter is pushed down
    through them, copying a regular-expression pass once per use. Producing the
    columns with a one-row generator keeps each at one evaluation per row: filters on
    them stay above, filters on other columns still reach the scan.
    """
    gone = {*columns, *drop}
    kept = [f"`{c}`" for c in df.columns if c not in gone]
    fields = ", ".join(f"'{name}', {expr}" for name, expr in columns.items())
    return df.selectExpr(*kept, f"inline(array(named_struct({fields})))")
