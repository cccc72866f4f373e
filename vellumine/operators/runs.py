"""Evaluation of recognition runs, pages and documents.

A run table holds one row per page, engine, language and variant; these operators
pick winners, compare runs, validate pages and vote documents. Winners are ``max_by``
aggregates and the "first two runs" a ranked window with a small limit, both of which
Spark prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellumine.functions import fixed, text as tx
from vellumine.functions.bands import band, confidence_level, half_even, recognition_quality, string_array

PAGES_PER_CHUNK = 256


# --- candidates and winners --------------------------------------------------
def candidate_languages(df: DataFrame, script: str = "script", confidence: str = "confidence",
                        out: str = "candidate") -> DataFrame:
    """One row per language worth trying on a page, with its order ``candidate_no``.

    The languages of the detected script; a wide list when Latin came out with low
    confidence; English when nothing is known.
    """
    table = F.create_map(*[x for s, langs in fixed.SCRIPT_LANGUAGES.items() for x in (F.lit(s), string_array(langs))])
    wide = (F.col(script) == "Latin") & (F.col(confidence) < 60)
    options = (F.when(wide, string_array(fixed.WIDENED_CANDIDATES))
               .otherwise(F.coalesce(F.try_element_at(table, F.col(script)), string_array(["English"]))))
    return df.select("*", F.posexplode(options).alias("candidate_no", out))


def stripped_length(text: Column) -> Column:
    return F.char_length(tx.strip(F.coalesce(text, F.lit(""))))


def candidate_score(confidence: Column, text: Column) -> Column:
    """Confidence, halved for text of three characters or fewer."""
    return F.when(stripped_length(text) > 3, confidence).otherwise(confidence * 0.5)


def variant_score(confidence: Column, text: Column) -> Column:
    """Confidence plus up to 20 points for 50 characters of text."""
    return confidence + F.least(F.lit(1.0), stripped_length(text) / F.lit(50.0)) * 20


def run_status(text: Column) -> Column:
    return F.when(stripped_length(text) > 0, "Success").otherwise("Empty")


def best_run(runs: DataFrame, keys: Sequence[str], score: Column, order: str = "run_no") -> DataFrame:
    """Best-scoring run per page; the earliest wins a tie. Adds ``score``."""
    rest = [c for c in runs.columns if c not in keys] + ["score"]
    return (
        runs.withColumn("score", score)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col(order))).alias("_b"))
        .select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
    )


def best_candidate(broad: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Winner among the broad first pass and the candidate runs of each page.

    The broad pass is the incumbent with its plain confidence as score; a candidate
    replaces it only with a strictly higher score.
    """
    first = broad.withColumns({"_score": F.col("confidence"), "run_no": F.lit(-1)})
    rest = runs.withColumn("_score", candidate_score(F.col("confidence"), F.col("text")))
    return best_run(first.unionByName(rest), keys, F.col("_score")).drop("_score")


def best_variant(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return best_run(runs, keys, variant_score(F.col("confidence"), F.col("text")))


def needs_variants(readiness: Column, best_score: Column) -> Column:
    """A page gets the variant pass only when its image is poor and its best score low."""
    return (readiness == "Poor") & (best_score < 50)


def adopt_variants(best: DataFrame, variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the result of eligible pages by a better variant.

    ``best`` has ``readiness``, ``score``, ``confidence``, ``text``; ``variants`` is a
    run table of the same pages. A variant is adopted when its confidence is higher
    than the best score so far.
    """
    eligible = best.where(needs_variants(F.col("readiness"), F.col("score")))
    won = best_variant(variants.join(eligible.select(*keys), list(keys), "left_semi"), keys)
    v = won.select(*keys, F.col("confidence").alias("_vc"), F.col("text").alias("_vt"))
    better = F.coalesce(F.col("_vc") > F.col("score"), F.lit(False))
    return best.join(v, list(keys), "left").withColumns({
        "confidence": F.when(better, F.col("_vc")).otherwise(F.col("confidence")),
        "text": F.when(better, F.col("_vt")).otherwise(F.col("text")),
        "variant_adopted": better,
    }).drop("_vc", "_vt")


# --- comparing runs ----------------------------------------------------------
def _first_texts(runs: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """Token sets of the first ``k`` runs with text. The rank limit prunes before the shuffle."""
    w = W.partitionBy(*keys).orderBy(order)
    picked = (runs.where(~tx.is_blank(F.col("text"))).select(*keys, order, "text")
              .withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k))
    toks = F.array_distinct(tx.plain_words(F.col("text")))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_rk") == i, toks)).alias(f"t{i}") for i in range(1, k + 1)])


def run_consensus(runs: DataFrame, keys: Sequence[str], order: str = "run_no") -> DataFrame:
    """Agreement of the first two runs with text: overlap of their token sets.

    Mean confidence is over all runs. With one text the confidence is that of the
    first run, even if that run was the blank one.
    """
    has_text = ~tx.is_blank(F.col("text"))
    totals = runs.groupBy(*keys).agg(
        F.count_if(has_text).alias("n_texts"), F.avg("confidence").alias("_mean"),
        F.min_by("confidence", order).alias("_first"))
    both = totals.join(_first_texts(runs, keys, order, 2), list(keys), "left")
    shared = F.size(F.array_intersect("t1", "t2")) / F.greatest(F.size("t1"), F.size("t2"))
    overlap = F.when(F.col("n_texts") == 0, 0.0).when(F.col("n_texts") == 1, 1.0).otherwise(shared)
    return both.select(
        *keys, "n_texts",
        F.when(F.col("n_texts") == 0, 0.0).when(F.col("n_texts") == 1, F.col("_first")).otherwise(F.col("_mean")).alias("overall_confidence"),
        F.when(F.col("n_texts") == 0, "Low").when(F.col("n_texts") == 1, "N/A (Single Run)")
        .when(overlap > 0.8, "High").when(overlap > 0.4, "Medium").otherwise("Low").alias("agreement_level"),
        overlap.alias("overlap_score"))


def run_stability(runs: DataFrame, keys: Sequence[str], order: str = "run_no") -> DataFrame:
    """Mean Jaccard similarity of later variants with the first one that has text."""
    texts = runs.where(~tx.is_blank(F.col("text"))).select(
        *keys, order, F.array_distinct(tx.plain_words(F.col("text"))).alias("toks"))
    base = texts.groupBy(*keys).agg(F.min(order).alias("_at"), F.min_by("toks", order).alias("_base"))
    later = F.col(order) > F.col("_at")
    compared = texts.join(base, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_texts"), F.avg(F.when(later, tx.jaccard(F.col("_base"), F.col("toks")))).alias("_sim"))
    pages = runs.select(*keys).distinct().join(compared, list(keys), "left")
    n = F.coalesce(F.col("n_texts"), F.lit(0))
    score = F.when(n == 0, 0.0).when(n == 1, 50.0).otherwise(F.col("_sim") * 100)
    profile = (F.when(n == 0, "Unstable (No Text)").when(n == 1, "Weak (Only one variant produced text)")
               .otherwise(band(score, fixed.STABILITY_BANDS, "Highly Unstable")))
    return pages.select(*keys, n.alias("n_texts"), score.alias("stability_score"), profile.alias("profile"))


def manual_review(agreement: Column) -> Column:
    return F.when(agreement == "Low", "Required").otherwise("Optional")


def review_advice(level: Column) -> Column:
    return F.when(level == fixed.CONFIDENCE_FLOOR, "Recommended").otherwise("Not required")


# --- pages -------------------------------------------------------------------
def page_confidence(words: DataFrame, keys: Sequence[str], text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Mean confidence of non-blank words with a non-negative confidence; 0 when none."""
    use = (F.col(confidence) >= 0) & ~tx.is_blank(F.col(text))
    return words.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(use, F.col(confidence))), F.lit(0.0)).alias("page_confidence"),
        F.count_if(use).alias("n_words"))


def _without(text: Column, cls: str) -> Column:
    """Characters of a class, counted as the length lost by removing them."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, cls + "+", ""))


# Scripts whose letters a garbage test expects.
GARBAGE_SCRIPTS = ["Devanagari", "Bengali", "Gujarati", "Gurmukhi", "Kannada", "Malayalam", "Odia", "Tamil", "Telugu"]


def is_garbage(text: Column, expected_script: Column, confidence: Column, symbol_share: float = 0.4) -> Column:
    """Blank, barely confident, mostly punctuation, or hardly any expected letters."""
    letters = _without(text, r"\p{L}")
    wrong = F.lit(False)
    for s in GARBAGE_SCRIPTS:
        a, b = fixed.SCRIPT_BLOCKS[s][0]
        own = _without(text, rf"[\p{{L}}&&[\x{{{a:04X}}}-\x{{{b:04X}}}]]")
        wrong = F.when(expected_script == s, own < letters * 0.1).otherwise(wrong)
    return (
        tx.is_blank(text)
        | ((confidence > 0) & (confidence < 15.0))
        | (_without(text, tx.ASCII_PUNCTUATION) / F.nullif(F.char_length(text), F.lit(0)) > symbol_share)
        | ((letters > 5) & wrong)
    )


def candidate_label(df: DataFrame, candidate: str = "best_candidate") -> DataFrame:
    """A page without an identified language takes its best non-English candidate."""
    use = (F.col("language") == "Unknown") & (F.col(candidate) != "English")
    return df.withColumns({
        "language": F.when(use, F.concat(F.col(candidate), F.lit(" (Candidate)"))).otherwise(F.col("language")),
        "language_method": F.when(use, "Multilingual Evaluation Pass").otherwise(F.col("language_method")),
        "language_confidence": F.when(use, F.col("ocr_confidence")).otherwise(F.col("language_confidence")),
    })


def validate_pages(df: DataFrame) -> DataFrame:
    """Cap the language confidence of short or badly recognised pages.

    Needs ``char_count``, ``ocr_confidence``, ``language``, ``language_confidence``,
    ``language_level``, ``language_method``; sets those and ``language_quality``.
    """
    short, ocr = F.col("char_count") < 10, F.col("ocr_confidence")
    poor, weak = ocr < 35, (ocr >= 35) & (ocr < 50)
    capped = F.when(short, F.least("language_confidence", F.lit(30.0))).otherwise(F.col("language_confidence"))
    final = F.when(poor, F.least(capped, ocr)).when(weak, F.least(capped, F.lit(40.0))).otherwise(capped)
    candidate = poor & F.col("language").contains("Candidate")
    bare = F.replace(F.col("language"), F.lit(" (Candidate)"), F.lit(""))
    method = F.concat(F.col("language_method"), F.when(short, " (insufficient text)").otherwise(""),
                      F.when(poor, " (poor OCR)").otherwise(""))
    return df.withColumns({
        "language_level": F.when(poor, "Inconclusive").when(weak, confidence_level(final))
        .when(short, "Inconclusive").otherwise(F.col("language_level")),
        "language_quality": F.when(poor | weak, "Poor").otherwise(recognition_quality(ocr)),
        "language": F.when(candidate, F.concat(bare, F.lit(" (Candidate) / Inconclusive"))).otherwise(F.col("language")),
        "language_method": method,
        "language_confidence": final,
    })


def provenance(engine: Column, model: Column, width: Column, height: Column, steps: Column) -> Column:
    """Record of how a page was read; ``steps`` is an array of (name, applied)."""
    return F.struct(
        engine.alias("engine"), model.alias("model"),
        F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit("Unknown")).alias("resolution"),
        F.transform(F.filter(steps, lambda s: s["applied"]), lambda s: s["name"]).alias("preprocessing"))


# --- words and regions -------------------------------------------------------
def region_id(page: Column, word_no: Column) -> Column:
    return F.format_string("R-%d-%03d", page.cast("bigint"), word_no.cast("bigint"))


def review_queue(words: DataFrame, page: str = "page_number", word_no: str = "word_no",
                 confidence: str = "confidence", below: float = 0.6) -> DataFrame:
    """Words to look at: confidence (0-100, normalised to 0-1) below the threshold."""
    return words.where(F.col(confidence) / 100 < below).select(
        *[c for c in words.columns if c not in ("issue", "review_status")],
        region_id(F.col(page), F.col(word_no)).alias("region_id"),
        F.lit("Low Confidence").alias("issue"), F.lit("Pending Review").alias("review_status"))


def heat_band(confidence: Column) -> Column:
    """Heat colour of a word confidence given as 0-100."""
    return band(confidence / 100, fixed.HEAT_BANDS, "red")


def polygon_box(points: Column) -> Column:
    """Bounding box of an array of (x, y): struct(x, y, w, h), null without area."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    box = F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"),
                   (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"))
    return F.when((box["w"] > 0) & (box["h"] > 0), box)


# --- documents ---------------------------------------------------------------
def assemble_documents(pages: DataFrame, keys: Sequence[str], page: str = "page_number", text: str = "text",
                       separator: str = fixed.PAGE_BREAK) -> DataFrame:
    """Document text from its pages in order, blank pages left out, with totals.

    Pages are joined in chunks first and the chunks then in order, so the sort and the
    concatenation of a long document are spread over tasks; only finished chunk texts
    meet in the document's row.
    """
    def joined(pos: str, body: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(body) != "", F.struct(pos, body))))
        return F.array_join(F.transform(parts, lambda s: s[body]), separator)

    chunk = F.floor(F.col(page) / F.lit(PAGES_PER_CHUNK)).alias("_chunk")
    parts = pages.groupBy(*keys, chunk).agg(
        joined(page, text).alias("_part"),
        F.sum(tx.word_count(F.col(text))).alias("_w"), F.sum(tx.char_count(F.col(text))).alias("_c"),
        F.count(F.lit(1)).alias("_p"))
    return parts.groupBy(*keys).agg(
        joined("_chunk", "_part").alias("total_text"), F.sum("_p").alias("total_pages"),
        F.sum("_w").alias("total_words"), F.sum("_c").alias("total_chars"))


def language_vote(pages: DataFrame, keys: Sequence[str], page: str = "page_number") -> DataFrame:
    """Language of a document: the greatest sum of page confidences.

    Unknown pages do not vote; the first seen wins a tie; the reported confidence is
    the mean of the winner's pages.
    """
    votes = pages.where(F.col("language") != "Unknown").groupBy(*keys, "language").agg(
        F.sum("language_confidence").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min(page).alias("_seen"))
    won = votes.groupBy(*keys).agg(
        F.max_by(F.struct("language", "_sum", "_n"), F.struct(F.col("_sum"), -F.col("_seen"))).alias("_v"),
        F.count(F.lit(1)).alias("n_languages"), F.array_sort(F.collect_set("language")).alias("detected_languages"))
    voted = pages.select(*keys).distinct().join(won, list(keys), "left")
    confidence = F.coalesce(half_even(F.col("_v._sum") / F.col("_v._n"), 1), F.lit(0.0))
    return voted.select(
        *keys, F.coalesce(F.col("_v.language"), F.lit("Unknown")).alias("overall_language"),
        confidence.alias("overall_confidence"), confidence_level(confidence).alias("overall_level"),
        F.coalesce("detected_languages", F.array().cast("array<string>")).alias("detected_languages"),
        (F.coalesce("n_languages", F.lit(0)) > 1).alias("is_multi_language"))


def script_vote(pages: DataFrame, keys: Sequence[str], page: str = "page_number") -> DataFrame:
    """Script of a document: the one of most pages, first seen on a tie."""
    votes = pages.where(F.col("script") != "Unknown").groupBy(*keys, "script").agg(
        F.count(F.lit(1)).alias("_n"), F.min(page).alias("_seen"))
    return votes.groupBy(*keys).agg(
        F.max_by("script", F.struct(F.col("_n"), -F.col("_seen"))).alias("overall_script"))


def document_languages(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct identified languages of a document and whether there are several."""
    known = F.when(F.col("language") != "Unknown", F.col("language"))
    found = pages.groupBy(*keys).agg(F.array_sort(F.collect_set(known)).alias("detected_languages"))
    return found.withColumn("is_multi_language", F.size("detected_languages") > 1)


def _analysis(name: str, status: Column | str, result: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(name).alias("analysis"), as_col(status).alias("status"), as_col(result).alias("result"))


def examination_matrix(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eleven checks per document: (analysis, status, result).

    Needs ``readiness``, ``overall_script``, ``overall_language``,
    ``overall_confidence``, ``overall_level``, ``agreement_level`` and ``n_words``.
    """
    ok, warn = "✓", "⚠"
    unsure = F.col("overall_level") == fixed.CONFIDENCE_FLOOR
    rows = F.array(
        _analysis("Evidence Integrity", ok, "SHA-256 verified"),
        _analysis("Image Quality", F.when(F.col("readiness").isNotNull(), ok).otherwise(warn),
                  F.when(F.col("readiness") == "Good", "Good").otherwise("Checked")),
        _analysis("Script Detection", ok, F.col("overall_script")),
        _analysis("Language ID", ok, F.col("overall_language")),
        _analysis("Primary OCR", ok, F.format_string("%.1f%%", F.col("overall_confidence"))),
        _analysis("Engine Disagreement",
                  F.when(F.col("agreement_level").isNotNull() & (F.col("agreement_level") != "High"), warn).otherwise(ok), "Checked"),
        _analysis("OCR Stability", warn, "Pending"),
        _analysis("OCR Regions", ok, F.coalesce(F.col("n_words"), F.lit(0)).cast("string")),
        _analysis("Metadata", ok, "Available"),
        _analysis("Histogram", ok, "Available"),
        _analysis("Manual Review", F.when(unsure, warn).otherwise(ok),
                  F.when(unsure, "Recommended").otherwise("Not required")),
    )
    return docs.select(*keys, F.posexplode(rows).alias("check_no", "_m")).select(*keys, "check_no", "_m.*")


# Conclusions of the report.
CONCLUSION_LOW = ("The available OCR evidence indicates reduced transcription reliability in the identified regions. "
                  "Manual examination is recommended.")
CONCLUSION_OK = "OCR Transcription completed successfully with moderate-to-high reliability."
CONCLUSION_NONE = "No detailed analysis performed."


def reliability_conclusion(confidence: Column) -> Column:
    return (F.when(confidence.isNull(), CONCLUSION_NONE).when(confidence < 50.0, CONCLUSION_LOW)
            .otherwise(CONCLUSION_OK))
