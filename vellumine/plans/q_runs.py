"""Recognition-run operators.

Stand-ins: a conversation is a page with several runs (turn = run number, role =
engine) or a document with several pages (turn = page); lineitem rows are words of a
page. Run confidence is a function of the text length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import fixed, text as tx
from vellumine.operators import runs as rn, text_id as ti
from vellumine.plans.q_text import CENSUS_SQL, written
from vellumine.plans.registry import query, table
from vellumine.sources.files import spread


def runs(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("run_no"), F.col("role").alias("engine"), "text",
        F.pmod(F.char_length("text") * 7, F.lit(101)).cast("double").alias("confidence"))


RUNS_SQL = """runs AS (SELECT conv_id AS page, turn::INT AS run_no, role AS engine, text,
  ((length(text) * 7) % 101)::DOUBLE AS confidence FROM conversations)"""
STRIP = f"length(regexp_replace(text, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g'))"
WORDS = f"list_filter(regexp_split_to_array(text, '{tx.PORTABLE_GAP}'), lambda t: t <> '')"


def words(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word_no"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("text"),
        F.when(F.col("l_discount") > 0.08, -1.0).otherwise(F.col("l_quantity") * 2).alias("confidence"),
        "l_extendedprice", "l_partkey")


WORDS_SQL = """words AS (SELECT l_orderkey AS page, l_linenumber AS word_no, l_partkey, l_extendedprice,
  CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS text,
  CASE WHEN l_discount > 0.08::DOUBLE THEN -1.0::DOUBLE ELSE l_quantity * 2 END AS confidence FROM lineitem)"""


def _sql_array(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("o01_candidate_languages", f"""WITH {CENSUS_SQL}
SELECT doc_id, unnest(CASE WHEN script = 'Latin' AND script_chars % 100 < 60 THEN {_sql_array(fixed.WIDENED_CANDIDATES)}
  WHEN script = 'Latin' THEN ['English'] WHEN script = 'Devanagari' THEN {_sql_array(fixed.SCRIPT_LANGUAGES['Devanagari'])}
  WHEN script = 'Bengali' THEN ['Bengali', 'Assamese'] WHEN script = 'Kannada' THEN ['Kannada'] ELSE ['English'] END) AS candidate FROM scripted""")
def o01(spark, d):
    pages = ti.detect_script(written(spark, d)).withColumn("confidence", F.col("script_chars") % 100)
    return rn.candidate_languages(pages).select("doc_id", "candidate")


@query("o02_best_candidate", f"""WITH {RUNS_SQL},
s AS (SELECT page, engine, run_no, CASE WHEN run_no = 0 OR {STRIP} > 3 THEN confidence ELSE confidence * 0.5::DOUBLE END AS score FROM runs)
SELECT page, arg_max(engine, (score, -run_no)) AS engine, max(score) AS score FROM s GROUP BY 1""")
def o02(spark, d):
    r = runs(spark, d)
    won = rn.best_candidate(r.where("run_no = 0").drop("run_no"), r.where("run_no > 0"), ["page"])
    return won.select("page", "engine", "score")


@query("o03_best_variant", f"""WITH {RUNS_SQL},
s AS (SELECT page, run_no, confidence + least(1.0::DOUBLE, {STRIP}::DOUBLE / 50.0::DOUBLE) * 20 AS score FROM runs)
SELECT page, arg_max(run_no, (score, -run_no)) AS run_no, max(score) AS score FROM s GROUP BY 1""")
def o03(spark, d):
    return rn.best_variant(runs(spark, d), ["page"]).select("page", "run_no", "score")


@query("o04_variant_pass", f"""WITH {RUNS_SQL},
best AS (SELECT page, confidence, confidence AS score, CASE WHEN length(text) % 2 = 0 THEN 'Poor' ELSE 'Good' END AS readiness FROM runs WHERE run_no = 0),
v AS (SELECT page, run_no, confidence, confidence + least(1.0::DOUBLE, {STRIP}::DOUBLE / 50.0::DOUBLE) * 20 AS score FROM runs WHERE run_no > 0),
w AS (SELECT page, arg_max(confidence, (score, -run_no)) AS vc FROM v GROUP BY 1)
SELECT b.page, CASE WHEN readiness = 'Poor' AND score < 50 AND vc > score THEN vc ELSE confidence END AS confidence,
  coalesce(readiness = 'Poor' AND score < 50 AND vc > score, false) AS variant_adopted FROM best b LEFT JOIN w USING (page)""")
def o04(spark, d):
    r = runs(spark, d)
    best = r.where("run_no = 0").select(
        "page", "confidence", F.col("confidence").alias("score"), "text",
        F.when(F.char_length("text") % 2 == 0, "Poor").otherwise("Good").alias("readiness"))
    return rn.adopt_variants(best, r.where("run_no > 0"), ["page"]).select("page", "confidence", "variant_adopted")


@query("o05_run_status", f"""WITH {RUNS_SQL}, x AS (SELECT page, run_no, CASE WHEN run_no % 3 = 1 THEN ' ' ELSE text END AS text FROM runs)
SELECT page, run_no, CASE WHEN {STRIP} > 0 THEN 'Success' ELSE 'Empty' END AS status FROM x""")
def o05(spark, d):
    blanked = F.when(F.col("run_no") % 3 == 1, " ").otherwise(F.col("text"))
    return runs(spark, d).select("page", "run_no", rn.run_status(blanked).alias("status"))


@query("o06_page_confidence", f"""WITH {WORDS_SQL}
SELECT page, coalesce(avg(CASE WHEN confidence >= 0 AND trim(text) <> '' THEN confidence END), 0.0) AS page_confidence,
  count(CASE WHEN confidence >= 0 AND trim(text) <> '' THEN 1 END) AS n_words FROM words GROUP BY 1""")
def o06(spark, d):
    return rn.page_confidence(words(spark, d), ["page"])


BLANKED = "blanked AS (SELECT page, run_no, confidence, CASE WHEN run_no % 3 = 0 THEN ' ' ELSE text END AS text FROM runs)"


def blanked(spark, d):
    return runs(spark, d).withColumn("text", F.when(F.col("run_no") % 3 == 0, " ").otherwise(F.col("text")))


@query("o07_run_consensus", f"""WITH {RUNS_SQL}, {BLANKED},
t AS (SELECT page, list_distinct({WORDS}) AS w, row_number() OVER (PARTITION BY page ORDER BY run_no) AS rk FROM blanked WHERE trim(text) <> ''),
p AS (SELECT page, max(CASE WHEN rk = 1 THEN w END) AS t1, max(CASE WHEN rk = 2 THEN w END) AS t2 FROM t GROUP BY 1),
a AS (SELECT page, count(CASE WHEN trim(text) <> '' THEN 1 END) AS n, avg(confidence) AS m, arg_min(confidence, run_no) AS f FROM blanked GROUP BY 1),
x AS (SELECT a.page, n, m, f, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN n = 1 THEN 1.0::DOUBLE
  ELSE len(list_intersect(t1, t2))::DOUBLE / greatest(len(t1), len(t2)) END AS overlap_score FROM a LEFT JOIN p USING (page))
SELECT page, n AS n_texts, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN f ELSE m END AS overall_confidence,
  CASE WHEN n = 0 THEN 'Low' WHEN n = 1 THEN 'N/A (Single Run)' WHEN overlap_score > 0.8::DOUBLE THEN 'High'
    WHEN overlap_score > 0.4::DOUBLE THEN 'Medium' ELSE 'Low' END AS agreement_level, overlap_score FROM x""")
def o07(spark, d):
    return rn.run_consensus(blanked(spark, d), ["page"])


@query("o08_run_stability", f"""WITH {RUNS_SQL}, {BLANKED},
t AS (SELECT page, run_no, list_distinct({WORDS}) AS w FROM blanked WHERE trim(text) <> ''),
b AS (SELECT page, min(run_no) AS first_at, arg_min(w, run_no) AS base, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT t.page, sum(len(list_intersect(base, w)) * 1000000 // greatest(1, len(list_distinct(list_concat(base, w)))))::BIGINT AS sim
  FROM t JOIN b USING (page) WHERE run_no > first_at GROUP BY 1)
SELECT p.page, coalesce(n, 0) AS n_texts, CASE WHEN coalesce(n, 0) = 0 THEN 'Unstable (No Text)' WHEN n = 1 THEN 'Weak (Only one variant produced text)'
  WHEN sim / (n - 1) / 10000.0 >= 85 THEN 'Highly Stable' WHEN sim / (n - 1) / 10000.0 >= 60 THEN 'Moderately Stable'
  WHEN sim / (n - 1) / 10000.0 >= 30 THEN 'Variable' ELSE 'Highly Unstable' END AS profile
FROM (SELECT DISTINCT page FROM runs) p LEFT JOIN b USING (page) LEFT JOIN s USING (page)""")
def o08(spark, d):
    return rn.run_stability(blanked(spark, d), ["page"]).select("page", "n_texts", "profile")


PUNCT = r"""[!-/:-@\[-`{-~]"""


@query("o09_garbage", f"""
WITH x AS (SELECT doc_id, text, CASE source WHEN 'web' THEN 'Bengali' ELSE 'Latin' END AS expected, (length(text) % 101)::DOUBLE AS confidence FROM documents)
SELECT doc_id, trim(text) = '' OR (confidence > 0 AND confidence < 15)
  OR coalesce((length(text) - length(regexp_replace(text, '{PUNCT}', '', 'g')))::DOUBLE / nullif(length(text), 0) > 0.4::DOUBLE, false)
  OR (expected = 'Bengali' AND length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) > 5) AS is_garbage FROM x""")
def o09(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    expected = F.when(F.col("source") == "web", "Bengali").otherwise("Latin")
    conf = F.pmod(F.char_length("text"), F.lit(101)).cast("double")
    return docs.select("doc_id", rn.is_garbage(F.col("text"), expected, conf).alias("is_garbage"))


@query("o10_manual_review", f"""WITH {RUNS_SQL}
SELECT page, run_no, CASE WHEN confidence < 40 THEN 'Required' ELSE 'Optional' END AS review,
  CASE WHEN confidence < 30 THEN 'Recommended' ELSE 'Not required' END AS advice FROM runs""")
def o10(spark, d):
    from vellumine.functions.bands import confidence_level
    agreement = F.when(F.col("confidence") < 40, "Low").otherwise("High")
    return runs(spark, d).select("page", "run_no", rn.manual_review(agreement).alias("review"),
                                 rn.review_advice(confidence_level(F.col("confidence"))).alias("advice"))


@query("o11_recognition_quality", f"""WITH {WORDS_SQL}
SELECT page, word_no, l_partkey, CASE WHEN confidence >= 70 THEN 'Good' WHEN confidence >= 40 THEN 'Moderate' ELSE 'Poor' END AS quality FROM words""")
def o11(spark, d):
    return words(spark, d).select("page", "word_no", "l_partkey", rn.recognition_quality(F.col("confidence")).alias("quality"))


def judged(spark, d):
    """Pages with derived recognition and language confidence, some too short."""
    c = F.char_length("text")
    return table(spark, d, "documents").select(
        "doc_id", "source", (c % 60).alias("char_count"), (c % 97).cast("double").alias("ocr_confidence"),
        F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "Unknown").otherwise("Hindi").alias("language"),
        (c % 89).cast("double").alias("language_confidence"), F.lit("High").alias("language_level"),
        F.lit("m").alias("language_method"), F.when(F.col("lang") == "fr", "Odia").otherwise("English").alias("best_candidate"))


JUDGED_SQL = """judged AS (SELECT doc_id, source, length(text) % 60 AS cc, (length(text) % 97)::DOUBLE AS oc,
  CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Unknown' ELSE 'Hindi' END AS language, (length(text) % 89)::DOUBLE AS lc, lang FROM documents),
named AS (SELECT doc_id, source, cc, oc, CASE WHEN language = 'Unknown' THEN 'Odia (Candidate)' ELSE language END AS language,
  CASE WHEN language = 'Unknown' THEN oc ELSE lc END AS lc,
  CASE WHEN language = 'Unknown' THEN 'Multilingual Evaluation Pass' ELSE 'm' END AS method FROM judged)"""


@query("o12_validate_pages", f"""WITH {JUDGED_SQL},
c AS (SELECT *, CASE WHEN cc < 10 THEN least(lc, 30.0::DOUBLE) ELSE lc END AS capped FROM named),
f AS (SELECT *, CASE WHEN oc < 35 THEN least(capped, oc) WHEN oc < 50 THEN least(capped, 40.0::DOUBLE) ELSE capped END AS final FROM c)
SELECT doc_id, final AS language_confidence,
  CASE WHEN oc < 35 THEN 'Inconclusive' WHEN oc < 50 THEN CASE WHEN final >= 85 THEN 'High' WHEN final >= 60 THEN 'Medium' WHEN final >= 30 THEN 'Low' ELSE 'Inconclusive' END
    WHEN cc < 10 THEN 'Inconclusive' ELSE 'High' END AS language_level,
  CASE WHEN oc < 50 THEN 'Poor' WHEN oc >= 70 THEN 'Good' ELSE 'Moderate' END AS language_quality,
  CASE WHEN oc < 35 AND contains(language, 'Candidate') THEN 'Odia (Candidate) / Inconclusive' ELSE language END AS language,
  method || CASE WHEN cc < 10 THEN ' (insufficient text)' ELSE '' END || CASE WHEN oc < 35 THEN ' (poor OCR)' ELSE '' END AS language_method FROM f""")
def o12(spark, d):
    out = rn.validate_pages(rn.candidate_label(judged(spark, d)))
    return out.select("doc_id", "language_confidence", "language_level", "language_quality", "language", "language_method")


@query("o13_assemble_documents", f"""
SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS text_md5,
  count(*) AS total_pages, sum(len({WORDS}))::BIGINT AS total_words, sum(length(text))::BIGINT AS total_chars FROM conversations GROUP BY 1""")
def o13(spark, d):
    pages = table(spark, d, "conversations")
    out = rn.assemble_documents(pages, ["conv_id"], page="turn")
    return out.select("conv_id", F.md5(F.col("total_text").cast("binary")).alias("text_md5"), "total_pages", "total_words", "total_chars")


@query("o14_language_vote", """
WITH p AS (SELECT source, doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Unknown' ELSE 'Hindi' END AS language,
  (length(text) % 89)::DOUBLE AS lc FROM documents),
v AS (SELECT source, language, sum(lc) AS s, count(*) AS n, min(doc_id) AS seen FROM p WHERE language <> 'Unknown' GROUP BY 1, 2),
w AS (SELECT source, arg_max(language, (s, -seen)) AS language, arg_max(s, (s, -seen)) AS s, arg_max(n, (s, -seen)) AS n, count(*) AS k FROM v GROUP BY 1)
SELECT source, language AS overall_language, round_even(s / n * 10, 0) / 10 AS overall_confidence, k > 1 AS is_multi_language,
  CASE WHEN round_even(s / n * 10, 0) / 10 >= 85 THEN 'High' WHEN round_even(s / n * 10, 0) / 10 >= 60 THEN 'Medium'
    WHEN round_even(s / n * 10, 0) / 10 >= 30 THEN 'Low' ELSE 'Inconclusive' END AS overall_level FROM w""")
def o14(spark, d):
    out = rn.language_vote(judged(spark, d), ["source"], page="doc_id")
    return out.select("source", "overall_language", "overall_confidence", "is_multi_language", "overall_level")


@query("o15_script_vote", f"""WITH {CENSUS_SQL},
v AS (SELECT source, script, count(*) AS n, min(doc_id) AS seen FROM scripted WHERE script <> 'Unknown' GROUP BY 1, 2)
SELECT source, arg_max(script, (n, -seen)) AS overall_script FROM v GROUP BY 1""")
def o15(spark, d):
    return rn.script_vote(ti.detect_script(written(spark, d)), ["source"], page="doc_id")


@query("o16_document_languages", """
SELECT source, string_agg(DISTINCT lang, '+' ORDER BY lang) AS languages, count(DISTINCT lang) > 1 AS is_multi_language FROM documents GROUP BY 1""")
def o16(spark, d):
    pages = table(spark, d, "documents").select("source", F.col("lang").alias("language"))
    out = rn.document_languages(pages, ["source"])
    return out.select("source", F.array_join("detected_languages", "+").alias("languages"), "is_multi_language")


@query("o17_review_queue", f"""WITH {WORDS_SQL}
SELECT page, l_partkey, printf('R-%d-%03d', page, word_no) AS region_id, 'Low Confidence' AS issue FROM words WHERE confidence / 100 < 0.6::DOUBLE""")
def o17(spark, d):
    return rn.review_queue(words(spark, d), "page").select("page", "l_partkey", "region_id", "issue")




@query("o18_polygon_box", """
WITH p AS (SELECT vec_id, list_transform(range(1, len(embedding), 2), lambda i: embedding[i]::DOUBLE * 100) AS xs,
  list_transform(range(2, len(embedding) + 1, 2), lambda i: embedding[i]::DOUBLE * 100) AS ys FROM embeddings),
b AS (SELECT vec_id, trunc(list_min(xs))::INT AS x, trunc(list_min(ys))::INT AS y, trunc(list_max(xs) - list_min(xs))::INT AS w,
  trunc(list_max(ys) - list_min(ys))::INT AS h FROM p)
SELECT * FROM b WHERE w > 0 AND h > 0""")
def o18(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double") * 100
    points = F.transform(F.sequence(F.lit(0), F.size("embedding") - 2, F.lit(2)), lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y")))
    return e.select("vec_id", rn.polygon_box(points).alias("b")).where("b IS NOT NULL").select("vec_id", "b.*")


@query("o19_heat_band", f"""WITH {WORDS_SQL}
SELECT page, word_no, l_partkey, CASE WHEN confidence / 100 >= 0.8::DOUBLE THEN 'green' WHEN confidence / 100 >= 0.5::DOUBLE THEN 'orange' ELSE 'red' END AS heat FROM words""")
def o19(spark, d):
    return words(spark, d).select("page", "word_no", "l_partkey", rn.heat_band(F.col("confidence")).alias("heat"))


@query("o20_examination_matrix", """
WITH d AS (SELECT conv_id, (sum(length(text)) % 100)::DOUBLE AS conf, count(*) AS n FROM conversations GROUP BY 1),
l AS (SELECT *, CASE WHEN conf >= 85 THEN 'High' WHEN conf >= 60 THEN 'Medium' WHEN conf >= 30 THEN 'Low' ELSE 'Inconclusive' END AS level FROM d)
SELECT conv_id, m.analysis, m.status, m.result FROM (SELECT conv_id, unnest([
  {'analysis': 'Evidence Integrity', 'status': '✓', 'result': 'SHA-256 verified'},
  {'analysis': 'Image Quality', 'status': '✓', 'result': CASE WHEN n > 3 THEN 'Good' ELSE 'Checked' END},
  {'analysis': 'Script Detection', 'status': '✓', 'result': 'Latin'},
  {'analysis': 'Language ID', 'status': '✓', 'result': 'English'},
  {'analysis': 'Primary OCR', 'status': '✓', 'result': printf('%.1f%%', conf)},
  {'analysis': 'Engine Disagreement', 'status': CASE WHEN n > 2 THEN '⚠' ELSE '✓' END, 'result': 'Checked'},
  {'analysis': 'OCR Stability', 'status': '⚠', 'result': 'Pending'},
  {'analysis': 'OCR Regions', 'status': '✓', 'result': n::VARCHAR},
  {'analysis': 'Metadata', 'status': '✓', 'result': 'Available'},
  {'analysis': 'Histogram', 'status': '✓', 'result': 'Available'},
  {'analysis': 'Manual Review', 'status': CASE WHEN level = 'Inconclusive' THEN '⚠' ELSE '✓' END,
   'result': CASE WHEN level = 'Inconclusive' THEN 'Recommended' ELSE 'Not required' END}]) AS m FROM l)""")
def o20(spark, d):
    from vellumine.functions.bands import confidence_level
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(
        (F.sum(F.char_length("text")) % 100).cast("double").alias("overall_confidence"), F.count(F.lit(1)).alias("n_words"))
    docs = docs.withColumns({
        "overall_level": confidence_level(F.col("overall_confidence")), "overall_script": F.lit("Latin"),
        "overall_language": F.lit("English"), "readiness": F.when(F.col("n_words") > 3, "Good").otherwise("Poor"),
        "agreement_level": F.when(F.col("n_words") > 2, "Low").otherwise("High")})
    return rn.examination_matrix(docs, ["conv_id"]).drop("check_no")


@query("o21_reliability", f"""WITH {RUNS_SQL}
SELECT page, run_no, CASE WHEN run_no = 0 THEN '{rn.CONCLUSION_NONE}' WHEN confidence < 50 THEN '{rn.CONCLUSION_LOW}' ELSE '{rn.CONCLUSION_OK}' END AS conclusion FROM runs""")
def o21(spark, d):
    conf = F.when(F.col("run_no") > 0, F.col("confidence"))
    return runs(spark, d).select("page", "run_no", rn.reliability_conclusion(conf).alias("conclusion"))


@query("o22_candidate_label", f"WITH {JUDGED_SQL} SELECT doc_id, language, lc AS language_confidence, method AS language_method FROM named")
def o22(spark, d):
    return rn.candidate_label(judged(spark, d)).select("doc_id", "language", "language_confidence", "language_method")


@query("o23_provenance", f"""WITH {RUNS_SQL}
SELECT page, run_no, '{{"engine":"' || engine || '","model":"eng","resolution":"' || CASE WHEN run_no % 2 = 0 THEN length(text) || 'x' || run_no ELSE 'Unknown' END
  || '","preprocessing":[' || CASE WHEN confidence > 50 THEN '"Deskew",' ELSE '' END || '"Noise Reduction"]}}' AS provenance FROM runs""")
def o23(spark, d):
    r = runs(spark, d)
    even = F.col("run_no") % 2 == 0
    steps = F.array(F.struct(F.lit("Deskew").alias("name"), (F.col("confidence") > 50).alias("applied")),
                    F.struct(F.lit("Contrast Enhancement").alias("name"), F.lit(False).alias("applied")),
                    F.struct(F.lit("Noise Reduction").alias("name"), F.lit(True).alias("applied")))
    record = rn.provenance(F.col("engine"), F.lit("eng"), F.when(even, F.char_length("text")), F.col("run_no"), steps)
    return r.select("page", "run_no", F.to_json(record).alias("provenance"))
