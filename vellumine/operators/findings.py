"""Findings, fusion matrix, case overview and batch work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import files as fx, fixed
from vellumine.functions.bands import string_array


def severity_rank(severity: Column) -> Column:
    """1 for Low to 4 for Critical; 0 for anything else."""
    return F.coalesce(F.array_position(string_array(fixed.SEVERITY_ORDER), severity), F.lit(0)).cast("int")


def new_findings(df: DataFrame) -> DataFrame:
    """Findings with the default severity, status and confidence filled in."""
    have = set(df.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
    return df.withColumns({"severity": default("severity", "Medium"), "status": default("status", "Potential Anomaly"),
                           "confidence": default("confidence", 0.0)})


def by_severity(findings: DataFrame, *tie: str) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), *tie)


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("module", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "severity_rank", severity_rank(F.col("severity")))


def fusion_matrix(evidence: DataFrame, results: DataFrame, key: str = "evidence_id",
                  modules: Sequence[str] = tuple(fixed.FUSION_MODULES)) -> DataFrame:
    """Every module for every evidence item; missing results stay pending.

    ``results`` holds (key, module, status, confidence, evidence_strength), at most one
    row per key and module. The module list is a constant, exploded in the row.
    """
    grid = evidence.select(key, F.explode(string_array(modules)).alias("module"))
    joined = grid.join(results.select(key, "module", "status", "confidence", "evidence_strength"), [key, "module"], "left")
    return joined.select(
        key, "module", F.coalesce("status", F.lit(fixed.ANALYSIS_PENDING)).alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("evidence_strength", F.lit("N/A")).alias("evidence_strength"))


def overall_assessment(matrix: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Completed and pending modules per item; pending until something completed."""
    done = F.count_if(F.col("status") == "Complete")
    return matrix.groupBy(key).agg(done.alias("n_complete"), F.count_if(F.col("status") == fixed.ANALYSIS_PENDING).alias("n_pending")).withColumn(
        "assessment", F.when(F.col("n_complete") == 0, fixed.ANALYSIS_PENDING).otherwise("Partially Assessed"))


def case_overview(cases: DataFrame, evidence: DataFrame, events: DataFrame, statuses: Sequence[str],
                  key: str = "case_id", status: str = "status", at: str = "timestamp", flagged: Column | None = None) -> DataFrame:
    """Evidence count, status mix, flagged items and last event per case.

    Each child table is reduced to one row per case before the joins.
    """
    flag = F.lit(False) if flagged is None else flagged
    mix = [F.count_if(F.col(status) == s).alias(f"n_{s.lower().replace(' ', '_')}") for s in statuses]
    ev = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("n_evidence"), *mix, F.count_if(flag).alias("n_flagged"))
    last = events.groupBy(key).agg(F.max(at).alias("last_event"))
    out = cases.select(key).join(ev, key, "left").join(last, key, "left")
    zero = [c for c in ev.columns if c != key]
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "last_event")


def batch_work_list(files: DataFrame, results: DataFrame | None = None, path: str = "path", length: str = "length",
                    analyses: Sequence[str] = tuple(fixed.BATCH_ANALYSES)) -> DataFrame:
    """Every supported file with every selected analysis, ready until a result says otherwise."""
    p = F.col(path)
    work = files.where(fx.is_supported(p)).select(
        path, fx.base_name(p).alias("file_name"), F.upper(fx.extension(p)).alias("file_type"),
        fx.human_size(F.col(length)).alias("file_size"), F.explode(string_array(analyses)).alias("analysis"))
    if results is None:
        return work.withColumn("status", F.lit("Ready"))
    done = results.select(path, "analysis", F.col("status").alias("_s"))
    return work.join(done, [path, "analysis"], "left").withColumn("status", F.coalesce("_s", F.lit("Ready"))).drop("_s")
