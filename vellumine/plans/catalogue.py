"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.plans import q_evidence, q_flows, q_raster, q_records, q_runs, q_text  # noqa: F401
from vellumine.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence: digest, script and language of each, totals per source.

    Digests and identification are one projection over one scan; the only shuffle is the
    grouping, which receives a few partial rows per task.
    """
    from pyspark.sql import functions as F

    from vellumine.operators.integrity import digests
    from vellumine.plans.flows import identify_pages
    from vellumine.sources.files import spread

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    seen = identify_pages(digests(docs, "text"))
    return seen.groupBy("source", "script", "language").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("sha256").isNotNull()).alias("n_digests"),
        F.sum("word_count").alias("n_words"), F.sum("char_count").alias("n_chars"), F.sum("script_chars").alias("n_script_chars"))


query("l1_flagship", f"""WITH {q_text.LATIN_CENSUS_SQL}
SELECT source, CASE WHEN n > 0 THEN 'Latin' ELSE 'Unknown' END AS script, CASE WHEN n > 0 THEN 'English' ELSE 'Unknown' END AS language,
  count(*) AS n_documents, count(sha256(text)) AS n_digests, sum(words)::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars, sum(n)::BIGINT AS n_script_chars
FROM latin GROUP BY 1, 2, 3""")(flagship)
