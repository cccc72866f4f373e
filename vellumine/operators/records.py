"""Case, evidence and audit records as set operations.

Keyed reads and writes over whole tables: every function takes and returns
DataFrames, and a batch of keys, patches or new rows is itself a DataFrame.
"Latest" and "first" per key are ``max_by``/``min_by`` aggregates, which combine on
the map side, so a key that holds a large share of the rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import fixed
from vellumine.functions.numbering import number_rows


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# --- reads -------------------------------------------------------------------
def list_cases(cases: DataFrame, status: str | None = None, modified: str = "modified_at",
               key: str = "case_id", status_col: str = "status") -> DataFrame:
    """Cases, newest change first; ties by key. The filter reaches the scan."""
    if status is not None:
        cases = cases.where(F.col(status_col) == status)
    return cases.orderBy(F.desc(modified), F.asc(key))


def lookup(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key occurs in ``keys`` (one or millions of lookups)."""
    return table.join(keys.select(*on), list(on), "left_semi")


def find(table: DataFrame, **key: object) -> DataFrame:
    """Rows with the given key values; equality predicates reach the Parquet scan."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def evidence_of_case(evidence: DataFrame, case_id: str | None = None,
                     order: Sequence[str] = ("created_at", "evidence_id"),
                     case_col: str = "case_id") -> DataFrame:
    """Evidence in order of creation, of one case or of every case."""
    if case_id is not None:
        return evidence.where(F.col(case_col) == case_id).orderBy(*order)
    return evidence.orderBy(case_col, *order)


def timeline(events: DataFrame, case_id: object = None, case_col: str = "case_id",
             at: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Audit events in ascending time (a range-partitioned sort, no single task)."""
    if case_id is not None:
        return events.where(F.col(case_col) == F.lit(case_id)).orderBy(at, *tie)
    return events.orderBy(case_col, at, *tie)


def runs_of_evidence(runs: DataFrame, results: DataFrame, on: Sequence[str],
                     order: Sequence[str]) -> DataFrame:
    """Recognition runs of every evidence item in insertion order.

    Runs carry their evidence key, so the lookup that always came back empty in the
    studied program returns rows here.
    """
    return runs.join(results, list(on)).orderBy(*on, *order)


def count_cases(cases: DataFrame, out: str = "n_cases") -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias(out))


def count_by_case(evidence: DataFrame, case_col: str = "case_id", out: str = "n_evidence") -> DataFrame:
    return evidence.groupBy(case_col).agg(F.count(F.lit(1)).alias(out))


def recent_files(opened: DataFrame, keep: int = 15, show: int | None = None,
                 path: str = "file_path", at: str = "opened_at") -> DataFrame:
    """Last opening per path, newest first; ``keep`` rows are retained, ``show`` listed."""
    last = opened.groupBy(path).agg(F.max(at).alias(at))
    return last.orderBy(F.desc(at), F.asc(path)).limit(min(keep, show) if show else keep)


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    value_cols = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*value_cols), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in value_cols])
    )


# --- names, states -----------------------------------------------------------
def backfill_names(df: DataFrame, a: str = "case_name", b: str = "title") -> DataFrame:
    """Fill a blank name from the title and a blank title from the name."""
    left, right = _blank_to_null(F.col(a)), _blank_to_null(F.col(b))
    filled_a, filled_b = F.coalesce(left, right, F.lit("")), F.coalesce(right, left, F.lit(""))
    return df.withColumns({a: filled_a, b: filled_b})


def normalise_status(status: Column, valid: Sequence[str] = tuple(fixed.CASE_STATUSES)) -> Column:
    """Upper-case members of the valid set; blank means OPEN; others pass unchanged."""
    upper = F.upper(F.coalesce(_blank_to_null(status), F.lit("OPEN")))
    return F.when(upper.isin(list(valid)), upper).otherwise(status)


def canonical_case(batch: DataFrame, now: Column | None = None) -> DataFrame:
    """New cases as they are stored: one name, upper-case status, default times."""
    now = F.current_timestamp() if now is None else now
    name = F.coalesce(F.nullif(F.col("case_name"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.lit(""))
    return batch.withColumns({
        "case_name": name,
        "title": name,
        "status": F.upper(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("OPEN"))),
        "created_at": F.coalesce(F.col("created_at"), now),
        "modified_at": F.coalesce(F.col("modified_at"), now),
    })


# --- writes ------------------------------------------------------------------
def insert_new(base: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split a batch into (accepted, rejected) under a unique key.

    Accepted: the first row per key inside the batch whose key ``base`` lacks; of rows with
    equal ``order`` the one with the smallest other columns. Rejected: every other row, those
    with a null key included, each as often as the batch has it.
    """
    value_cols = [c for c in batch.columns if c != key]
    firsts = batch.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(F.struct(*order).alias("_order"), F.struct(*value_cols).alias("_row"))).alias("_first"))
    accepted = firsts.join(base.select(key), key, "left_anti").select(
        key, *[F.col(f"_first._row.{c}").alias(c) for c in value_cols]).select(batch.columns)
    return accepted, batch.exceptAll(accepted)


def apply_patch(base: DataFrame, patch: DataFrame, key: Sequence[str], allowed: Sequence[str],
                mirrored: tuple[str, str] | None = ("case_name", "title"),
                touched: str | None = "modified_at", now: Column | None = None) -> DataFrame:
    """Update allow-listed columns from a patch table (null = leave).

    The patch holds one row per key; reduce several with ``latest_by`` first. Columns of the patch outside ``allowed`` are ignored. Setting one of the mirrored
    columns sets both. ``touched`` is refreshed on rows where anything was set.
    """
    now = F.current_timestamp() if now is None else now
    fields = [c for c in patch.columns if c in allowed and c in base.columns]
    new = {c: F.col(f"p.{c}") for c in fields}
    if mirrored and all(m in base.columns for m in mirrored):
        a, b = mirrored
        pa, pb = new.get(a, F.lit(None)), new.get(b, F.lit(None))
        if a in new or b in new:
            new[a], new[b] = F.coalesce(pa, pb), F.coalesce(pb, pa)
    any_set = F.lit(False)
    for v in new.values():
        any_set = any_set | v.isNotNull()
    joined = base.alias("b").join(patch.alias("p"), list(key), "left")
    out = []
    for c in base.columns:
        if c in key:
            out.append(F.col(c))
        elif c == touched:
            out.append(F.when(any_set, now).otherwise(F.col(f"b.{c}")).alias(c))
        elif c in new:
            out.append(F.coalesce(new[c], F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.col(f"b.{c}").alias(c))
    return joined.select(*out)


def upsert_latest(current: DataFrame, incoming: DataFrame, key: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Keyed state after a batch of writes, last write wins."""
    return latest_by(current.unionByName(incoming), list(key), list(order))


def cascade_delete(doomed: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the deleted keys.

    Results and history go with the case; leave a table out to keep it.
    """
    keys = doomed.select(key).distinct()
    return [t.join(keys, key, "left_anti") for t in tables]


def replace_rows(base: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop the prior rows of every key in ``rows``, then add ``rows``."""
    kept = base.join(rows.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(rows)


def audit_rows(df: DataFrame, case_id: Column, evidence_id: Column, event_type: Column,
               description: Column, at: Column | None = None) -> DataFrame:
    """Rows for the append-only case event log."""
    return df.select(
        case_id.alias("case_id"), evidence_id.alias("evidence_id"), event_type.alias("event_type"),
        description.alias("description"),
        (F.current_timestamp() if at is None else at).alias("timestamp"))


def history_rows(df: DataFrame, case_id: Column, evidence_id: Column, operation: Column,
                 parameters: Sequence[Column], at: Column | None = None) -> DataFrame:
    """Rows for the processing history, parameters as one JSON object."""
    return df.select(
        case_id.alias("case_id"), evidence_id.alias("evidence_id"), operation.alias("operation"),
        F.to_json(F.struct(*parameters)).alias("parameters"),
        (F.current_timestamp() if at is None else at).alias("timestamp"))


# --- identifiers -------------------------------------------------------------
def id_suffix(identifier: Column) -> Column:
    """Number after the last dash, null when it is not a number."""
    return F.split_part(identifier, F.lit("-"), F.lit(-1)).try_cast("bigint")


def highest_suffix(existing: DataFrame, group: str, identifier: str) -> DataFrame:
    return existing.groupBy(group).agg(F.max(id_suffix(F.col(identifier))).alias("_top"))


def assign_ids(new: DataFrame, existing: DataFrame, group: str, identifier: str, order: Sequence[str | Column],
               shape: str, shape_args: Sequence[Column] = (), within: Sequence[str] = (), measured: DataFrame | None = None) -> DataFrame:
    """Number a batch of new rows after the highest existing id of their group.

    ``shape`` is a format string ending in the number, e.g. ``EVD-%06d`` or
    ``CASE-%s-%06d`` with the year as argument. ``within`` and ``measured`` are those of
    ``number_rows``.
    """
    top = highest_suffix(existing, group, identifier)
    numbered = number_rows(new, [group], list(order), "_seq", within, measured).join(top, group, "left")
    number = (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_seq")).cast("bigint")
    return numbered.withColumn(identifier, F.format_string(shape, *shape_args, number)).drop("_top", "_seq")


def default_case(df: DataFrame, generated_id: Column, case_col: str = "case_id") -> DataFrame:
    """Evidence without a case goes to a generated one; ``auto_created`` marks it."""
    missing = _blank_to_null(F.col(case_col)).isNull()
    return df.withColumns({
        case_col: F.when(missing, generated_id).otherwise(F.col(case_col)),
        "auto_created": missing,
    })


def auto_case_events(df: DataFrame, at: Column | None = None, case_col: str = "case_id") -> DataFrame:
    """One "Case Created" event per generated case."""
    made = df.where("auto_created").select(case_col).distinct()
    return audit_rows(made, F.col(case_col), F.lit(""), F.lit("Case Created"),
                      F.lit("Auto-created case for imported evidence"), at)


def register_or_reuse(scan: DataFrame, registry: DataFrame, order: Sequence[str | Column],
                      keys: tuple[str, str] = ("case_id", "file_path")) -> DataFrame:
    """Give scanned files their evidence id: the known one, or the next new one.

    Adds ``evidence_id``, ``known``, the re-import ``status`` and ``recorded_sha256``. A known
    item counts as changed only when a digest is on record and differs. Scan and registry are
    joined once; unknown rows are numbered inside that relation, apart from the known ones of
    their case. The highest number of each case comes from the registry's two id columns.
    """
    case, path = keys
    recorded = registry.select(case, path, F.col("evidence_id").alias("_id"),
                               F.nullif(F.col("sha256"), F.lit("")).alias("recorded_sha256"))
    matched = scan.join(recorded, [case, path], "left").withColumn("known", F.col("_id").isNotNull())
    numbered = assign_ids(matched, registry, case, "evidence_id", order, "EVD-%06d", within=["known"], measured=scan)
    differs = F.col("recorded_sha256").isNotNull() & (F.col("recorded_sha256") != F.col("sha256"))
    status = (
        F.when(F.col("known") & F.coalesce(differs, F.lit(False)), fixed.INTEGRITY_CHANGED)
        .when(~F.col("known") & F.col("sha256").isNull(), "Pending")
        .otherwise(fixed.INTEGRITY_VERIFIED)
    )
    return numbered.withColumns({"evidence_id": F.coalesce("_id", "evidence_id"), "status": status}).drop("_id")


def import_history(registered: DataFrame, at: Column | None = None) -> DataFrame:
    """"Evidence imported" history rows: path, digest, file type and size."""
    return history_rows(registered, F.col("case_id"), F.col("evidence_id"), F.lit("Evidence imported"),
                        [F.col("file_path"), F.col("sha256"), F.col("file_type"), F.col("file_size")], at)


# --- examinations ------------------------------------------------------------
def encode_examination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """List and struct columns to JSON text, as stored."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


def decode_examination(df: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """JSON columns to their types; text that does not parse becomes an empty value."""
    out = {}
    for name, ddl in shapes.items():
        empty = F.from_json(F.lit("[]" if ddl.lower().startswith("array") else "{}"), ddl)
        out[name] = F.coalesce(F.from_json(F.col(name), ddl, {"mode": "PERMISSIVE"}), empty)
    return df.withColumns(out)


def examinations_of_case(exams: DataFrame, at: str, tie: str, case_col: str = "case_id") -> DataFrame:
    """Examinations of every case, newest first inside each case."""
    return exams.orderBy(F.asc(case_col), F.desc(at), F.desc(tie))
