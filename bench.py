"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship",  # digest, census, language, totals per source
    "t02_primary_script", "t05_marker_scores", "t15_statistical_language", "t18_word_counts",
    "i01_digests", "i03_bulk_reverify", "r05_upsert_state", "r11_next_ids", "r18_register_or_reuse",
    "o06_page_confidence", "o07_run_consensus", "o08_run_stability", "o13_assemble_documents",
    "p03_histogram", "p05_statistics", "p22_median_blur", "p25_laplacian_variance", "p37_preprocessing_plan",
    "m05_xmp_rows", "m07_png_chunks", "m11_observed_timeline", "f02_fusion_matrix", "f03_case_overview", "st4_audit_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vellumine.plans import catalogue
    from vellumine.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(int(cpus) if cpus.isdigit() else 8), "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("OFF")
    queries = {"flagship": catalogue.flagship, **catalogue.QUERIES}
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
