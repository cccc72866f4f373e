"""Whole examinations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import text as tx
from vellumine.functions.once import compute_once
from vellumine.plans import flows
from vellumine.plans.q_evidence import PNG_SPARK
from vellumine.plans.q_raster import ALL_COLOUR, STAT_SQL, colour_tiles
from vellumine.plans.registry import query, table
from vellumine.sources.files import spread

WORDS = f"len(list_filter(regexp_split_to_array(text, '{tx.PORTABLE_GAP}'), lambda t: t <> ''))"


@query("l2_recognise_documents", f"""
WITH r AS (SELECT conv_id, turn, ((length(text) * 7) % 101)::DOUBLE AS c0, ((length(text) * 11) % 101)::DOUBLE AS c1, text AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN c1 > c0 THEN t || ' x' ELSE t END AS text FROM r)
SELECT conv_id, count(*) AS total_pages, sum({WORDS})::BIGINT AS total_words, sum(length(text))::BIGINT AS total_chars,
  md5(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY turn)) AS text_md5, 'Latin' AS overall_script,
  sha256(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY turn) || 'e1') AS snapshot, 0::BIGINT AS pages_to_review FROM b GROUP BY 1""")
def l2(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.char_length("text")
    first = c.withColumns({"run_no": F.lit(0), "confidence": F.pmod(n * 7, F.lit(101)).cast("double")})
    second = c.withColumns({"run_no": F.lit(1), "confidence": F.pmod(n * 11, F.lit(101)).cast("double"), "text": F.concat("text", F.lit(" x"))})
    out = flows.recognition_examination(first.unionByName(second), "conv_id", "turn", engine=F.lit("e1"))["documents"]
    return out.select("conv_id", "total_pages", "total_words", "total_chars", F.md5(F.col("total_text").cast("binary")).alias("text_md5"), "overall_script", "snapshot", "pages_to_review")


@query("l3_examine_metadata", """
WITH d AS (SELECT doc_id, n_chars, lang = 'fr' AS odd, doc_id % 4 = 1 AS exif, doc_id::VARCHAR || CASE lang WHEN 'fr' THEN '.jpg' ELSE '.png' END AS path FROM documents)
SELECT path, 'PNG' AS detected_format, concat_ws(',', CASE WHEN exif AND n_chars <> 7 THEN 'DIMENSION DISCREPANCY' END, CASE WHEN exif THEN 'EXIF PRESENT' END,
    CASE WHEN odd THEN 'FORMAT MISMATCH' END, CASE WHEN exif THEN 'GPS PRESENT' END, CASE WHEN exif THEN 'METADATA PRESENT' ELSE 'NO METADATA' END) AS flags,
  odd::INT + (exif AND n_chars <> 7)::INT AS n_inconsistencies, CASE WHEN exif THEN 'PRESENT' ELSE 'LIMITED' END AS metadata_status,
  CASE WHEN exif THEN 2 ELSE 1 END::BIGINT AS n_times, (odd::INT + (exif AND n_chars <> 7)::INT + exif::INT)::BIGINT AS n_anomalies FROM d""")
def l3(spark, d):
    docs = spread(table(spark, d, "documents"))
    files = compute_once(docs, {
        "path": "concat(doc_id, CASE lang WHEN 'fr' THEN '.jpg' ELSE '.png' END)", "content": PNG_SPARK,
        "length": "CAST(n_chars AS BIGINT)", "modificationTime": "timestamp_seconds(1700000000 + doc_id)"})
    rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(v).alias("value"), F.lit(s).alias("source")) for p, v, s in (
        ("DateTime", "2024:01:02 03:04:05", "EXIF"), ("Software", "GIMP 2.10", "EXIF"), ("PixelXDimension", "7", "EXIF"), ("PixelYDimension", "16", "EXIF"), ("GPS Present", "YES", "EXIF GPS"))])
    exif = files.where("doc_id % 4 = 1").select(F.col("path").alias("evidence_id"), F.inline(rows))
    found = flows.metadata_examination(files.select("path", "content", "length", "modificationTime"), exif)
    times = found["timeline"].groupBy("evidence_id").agg(F.count("*").alias("n_times"))
    odd = found["anomalies"].groupBy("evidence_id").agg(F.count("*").alias("n_anomalies"))
    facts = found["facts"].select("evidence_id", "path", "detected_format", F.array_join("flags", ",").alias("flags"), F.size("inconsistencies").alias("n_inconsistencies"))
    out = facts.join(found["summary"].select("evidence_id", "metadata_status"), "evidence_id").join(times, "evidence_id").join(odd, "evidence_id", "left")
    return out.drop("evidence_id").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0).cast("long")))


@query("l4_histogram_examination", f"WITH {ALL_COLOUR} SELECT image_id, ch, {STAT_SQL} FROM allpx GROUP BY 1, 2")
def l4(spark, d):
    return flows.histogram_examination(colour_tiles(spark, d))["channels"].select("image_id", "ch", "pixel_count", "mean", "std_dev", "min", "max")
