"""Script and language identification of page text.

Everything about one page is computed in its own row with built-in expressions, so
identification adds no shuffle to the scan. Marker lexicons of a few hundred words
are constants of the expression; a lexicon of any size is a DataFrame and is joined
(``marker_scores_joined``), where the optimizer broadcasts it only if its measured size
allows. Statistical profiles are in ``profiles``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import fixed, text as tx
from vellumine.functions.bands import literal_map, string_array
from vellumine.functions.once import compute_once

Lexicon = Mapping[str, Sequence[str]]


# --- script ------------------------------------------------------------------
SCRIPTS = list(fixed.SCRIPT_BLOCKS)


def script_census(df: DataFrame, text: str = "text") -> DataFrame:
    """Count characters per writing script.

    White space, digits, punctuation and symbols are skipped, marks count. Adds
    ``script_chars`` (characters in any known block) and ``scripts``, an array of
    (script, n, first_at) ordered by count, then by first appearance.

    Two passes over the text (Latin run lengths, everything else kept); the remaining
    counts see only the non-Latin characters, none at all for Latin pages. The script of
    the first of them is counted first, the others see what it leaves.
    """
    others = [s for s in SCRIPTS if s != "Latin"]
    df = compute_once(df, {
        "_latin": f"char_length(`{text}`) - char_length(regexp_replace(`{text}`, r'{tx.counted_class('Latin')}+', ''))",
        # no other block has a character below U+0600 or from U+1C80 to U+AADF; what no block claims is ignored below
        "_other": f"regexp_replace(`{text}`, r'[\\x{{0}}-\\x{{5FF}}\\x{{1C80}}-\\x{{AADF}}]+', '')",
    })
    leads = " ".join(f"WHEN ascii(_other) BETWEEN {low} AND {high} THEN '{s}'" for s in others for low, high in fixed.SCRIPT_BLOCKS[s])
    df = compute_once(df, {"_lead": f"CASE {leads} END"})
    without = {s: f"regexp_replace(%s, r'{tx.counted_class(s)}+', '')" for s in others}
    df = compute_once(df, {"_rest": "CASE _lead " + " ".join(f"WHEN '{s}' THEN {without[s] % '_other'}" for s in others) + " ELSE _other END"})
    counts = {"_n_Latin": "coalesce(_latin, 0)"}
    for s in others:
        counts[f"_n_{s}"] = (f"CASE WHEN _lead = '{s}' THEN char_length(_other) - char_length(_rest) "
                             f"WHEN _rest <> '' THEN char_length(_rest) - char_length({without[s] % '_rest'}) ELSE 0 END")
    df = compute_once(df, counts, drop=("_latin", "_other", "_lead", "_rest"))
    items = ", ".join(
        f"CASE WHEN `_n_{s}` > 0 THEN named_struct('neg', -`_n_{s}`, 'first_at', "
        f"regexp_instr(`{text}`, r'{tx.counted_class(s)}'), 'script', '{s}') END" for s in SCRIPTS)
    ranked = (f"transform(sort_array(array_compact(array({items}))), "
              "s -> named_struct('script', s.script, 'n', CAST(-s.neg AS BIGINT), 'first_at', s.first_at))")
    total = "CAST(" + " + ".join(f"`_n_{s}`" for s in SCRIPTS) + " AS BIGINT)"
    return compute_once(df, {"scripts": ranked, "script_chars": total}, drop=tuple(f"_n_{s}" for s in SCRIPTS))


def primary_script(df: DataFrame, latin_cap: float = 0.15) -> DataFrame:
    """Choose the script of a page from its census.

    The most frequent script wins; when that is Latin and the runner-up holds more
    than ``latin_cap`` of the characters, the runner-up wins. Adds ``script``,
    ``script_confidence`` (0-100, one decimal) and ``script_alternatives`` (share at
    least 1 %).
    """
    swap = (f"get(scripts, 0).script = 'Latin' AND "
            f"CAST(get(scripts, 1).n AS DOUBLE) / CAST(script_chars AS DOUBLE) > CAST({latin_cap} AS DOUBLE)")
    df = compute_once(df, {"_chosen": f"CASE WHEN {swap} THEN get(scripts, 1) ELSE get(scripts, 0) END"})

    def share(n: str) -> str:
        return f"rint(CAST({n} AS DOUBLE) / CAST(script_chars AS DOUBLE) * 100D * 10D) / 10D"

    return compute_once(df, {
        "script": "coalesce(_chosen.script, 'Unknown')",
        "script_confidence": f"coalesce({share('_chosen.n')}, 0D)",
        "script_alternatives": "filter(transform(filter(scripts, s -> s.script <> _chosen.script), "
                               f"s -> named_struct('script', s.script, 'confidence', {share('s.n')})), a -> a.confidence >= 1D)",
    }, drop=("_chosen",))


def detect_script(df: DataFrame, text: str = "text") -> DataFrame:
    return primary_script(script_census(df, text)).drop("scripts")


# --- marker words ------------------------------------------------------------
def _quoted(vocabulary: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in vocabulary)


def _marked(df: DataFrame, lex: Lexicon, tokens: str, out: str) -> DataFrame:
    """Keep only tokens some language of the lexicon knows: one hash probe per token."""
    union = dict.fromkeys(w for v in lex.values() for w in v)
    return compute_once(df, {out: f"filter({tokens}, t -> t IN ({_quoted(union)}))"})


def marker_scores(df: DataFrame, lex: Lexicon, tokens: str = "tokens") -> DataFrame:
    """Score each language of a lexicon by its marker words.

    score = (0.7 * hits / words + 0.3 * distinct hits / lexicon size) * 100.
    Adds ``scores``: an array of (language, n_hits, n_distinct, score) in lexicon order.
    """
    df = _marked(df, lex, tokens, "_m")
    df = compute_once(df, {f"_h{i}": f"filter(_m, t -> t IN ({_quoted(v)}))" for i, v in enumerate(lex.values())}, drop=("_m",))
    items = ", ".join(
        f"named_struct('language', '{language}', 'n_hits', CAST(size(_h{i}) AS BIGINT), "
        f"'n_distinct', CAST(size(array_distinct(_h{i})) AS BIGINT), 'score', CASE WHEN size({tokens}) > 0 THEN "
        f"(CAST(size(_h{i}) AS DOUBLE) / CAST(size({tokens}) AS DOUBLE) * 0.7D "
        f"+ CAST(size(array_distinct(_h{i})) AS DOUBLE) / {float(max(1, len(set(v))))}D * 0.3D) * 100D ELSE 0D END)"
        for i, (language, v) in enumerate(lex.items()))
    return compute_once(df, {"scores": f"array({items})"}, drop=tuple(f"_h{i}" for i in range(len(lex))))


def marker_scores_joined(df: DataFrame, key: str, lex: DataFrame, text: str = "text") -> DataFrame:
    """The same scores for a lexicon table (language, token) of any size.

    Tokens are counted per (page, token) before the join, so a frequent word crosses
    the shuffle once per page. No broadcast is forced. One row per page and language
    with at least one hit.
    """
    words = df.select(key, F.explode(tx.tokens(F.col(text))).alias("token"))
    counted = words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    n_words = df.select(key, F.size(tx.tokens(F.col(text))).cast("bigint").alias("n_words"))
    vocabulary = lex.select("language", "token").dropDuplicates()
    size = vocabulary.groupBy("language").agg(F.count(F.lit(1)).alias("lexicon_size"))
    found = counted.join(vocabulary, "token").groupBy(key, "language").agg(
        F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_distinct"))
    score = F.expr("(n_hits / n_words * 0.7D + n_distinct / lexicon_size * 0.3D) * 100D")
    return found.join(n_words, key).join(size, "language").select(key, "language", "n_hits", "n_distinct", score.alias("score"))


def boost_scores(df: DataFrame, language: str, probability: str, weight: float = 30.0) -> DataFrame:
    """Add a statistical detector's vote to the matching language of ``scores``."""
    vote = f"CASE WHEN s.language = `{language}` THEN `{probability}` * {weight}D ELSE 0D END"
    return compute_once(df, {"scores": "transform(scores, s -> named_struct('language', s.language, 'n_hits', s.n_hits, "
                                       f"'n_distinct', s.n_distinct, 'score', s.score + {vote}))"})


def pick_language(df: DataFrame, scores: str = "scores", out: str = "winner", close: float = 0.7,
                  damp: float = 0.7, top: int = 3) -> DataFrame:
    """Winner of a score array: struct(language, confidence, raw, alternatives).

    Confidence is the share of the winner, at most 99, damped when the runner-up
    comes close. Ties go to the language listed first. Alternatives are ranks 2 to
    ``top + 1`` with a positive score.
    """
    total = f"aggregate({scores}, 0D, (acc, s) -> acc + s.score)"
    df = compute_once(df, {
        "_ranked": f"sort_array(transform({scores}, (s, i) -> named_struct('neg', -s.score, 'pos', i, 'language', s.language)))",
        "_whole": f"coalesce(nullif({total}, 0D), 1D)",
    })
    best, second = "(-get(_ranked, 0).neg)", "(-get(_ranked, 1).neg)"
    near = f"{best} > 0 AND {second} / nullif({best}, 0D) > CAST({close} AS DOUBLE)"
    plain = f"least(99D, {best} / _whole * 100D)"
    df = compute_once(df, {"_raw": f"{plain} * CASE WHEN {near} THEN {damp}D ELSE 1D END"})
    alternative = ("named_struct('language', r.language, 'confidence', rint(least(99D, -r.neg / _whole * 100D) * 10D) / 10D, "
                   "'method', 'Word marker analysis')")
    return compute_once(df, {out: (
        "named_struct('language', get(_ranked, 0).language, 'confidence', rint(_raw * 10D) / 10D, 'raw', _raw, 'alternatives', "
        f"transform(filter(slice(_ranked, 2, {top}), r -> r.neg < 0), r -> {alternative}))")}, drop=("_ranked", "_whole", "_raw"))


def split_languages(df: DataFrame, lex: Lexicon, bonus: Mapping[str, str], default: float,
                    tokens: str = "tokens", out: str = "split") -> DataFrame:
    """Raw-hit split between two or more languages of one script.

    ``bonus`` maps a language to a boolean SQL expression; where true it earns 20
    extra hits. Ties go to the language listed first; no hits at all give the first
    language with the ``default`` confidence. Adds struct(language, confidence,
    alternatives).
    """
    df = _marked(df, lex, tokens, "_m")
    items = ", ".join(
        f"named_struct('neg', -(size(filter(_m, t -> t IN ({_quoted(v)})))"
        + (f" + CASE WHEN {bonus[language]} THEN 20 ELSE 0 END" if language in bonus else "")
        + f"), 'pos', {i}, 'language', '{language}')" for i, (language, v) in enumerate(lex.items()))
    df = compute_once(df, {"_split": f"sort_array(array({items}))"}, drop=("_m",))
    total = "(-aggregate(_split, 0, (acc, s) -> acc + s.neg))"  # two or three terms: cheaper than a step
    share = f"rint(least(99D, CAST(-get(_split, 0).neg AS DOUBLE) / CAST({total} AS DOUBLE) * 100D) * 10D) / 10D"
    alternative = ("named_struct('language', s.language, 'confidence', "
                   f"rint(CAST(-s.neg AS DOUBLE) / CAST({total} AS DOUBLE) * 100D * 10D) / 10D, 'method', 'Word marker analysis')")
    return compute_once(df, {out: (
        f"named_struct('language', CASE WHEN {total} > 0 THEN get(_split, 0).language ELSE '{next(iter(lex))}' END, "
        f"'confidence', CASE WHEN {total} > 0 THEN {share} ELSE {default}D END, 'alternatives', "
        f"transform(filter(slice(_split, 2, {len(lex)}), s -> s.neg < 0), s -> {alternative}))")}, drop=("_split",))


def letter_share(text: str, letters: str, script_class: str) -> str:
    """SQL: share of the given letters among the characters of a script."""
    return f"regexp_count(`{text}`, '[{letters}]') / nullif(regexp_count(`{text}`, r'{script_class}'), 0)"


# --- language ----------------------------------------------------------------
DEVANAGARI = fixed.DEVANAGARI_MARKERS
BENGALI = fixed.BENGALI_MARKERS
PERSO_ARABIC = fixed.PERSO_ARABIC_MARKERS
_ALTERNATIVES = "ARRAY<STRUCT<language: STRING, confidence: DOUBLE, method: STRING>>"


def _level(c: str) -> str:
    whens = " ".join(f"WHEN {c} >= {low} THEN '{label}'" for low, label in fixed.CONFIDENCE_BANDS)
    return f"CASE {whens} ELSE '{fixed.CONFIDENCE_FLOOR}' END"


def _detector_between_two(df: DataFrame, column: str, second: str, first: str, language: str, probability: str) -> DataFrame:
    """A detector's vote in a two-language split: agreement raises, dissent for the
    second language overrules."""
    raised = f"least(99D, {column}.confidence + `{probability}` * 10D)"
    overruled = f"`{language}` = '{second}' AND {column}.language <> '{second}'"
    agrees = f"`{language}` IN ('{first}', '{second}')"
    return compute_once(df, {column: (
        f"named_struct('language', CASE WHEN {overruled} THEN '{second}' ELSE {column}.language END, 'confidence', "
        f"CASE WHEN {overruled} THEN 65D WHEN {agrees} THEN {raised} ELSE {column}.confidence END, "
        f"'alternatives', {column}.alternatives)")})


def _mixed(blank: str) -> str:
    latin = "exists(script_alternatives, a -> a.script = 'Latin' AND a.confidence > 10)"
    return f"coalesce(script = 'Devanagari' AND NOT {blank} AND {latin}, false)"


def mixed_language(df: DataFrame, text: str = "text") -> DataFrame:
    """``is_mixed_language`` of ``identify_language`` alone, which needs no words, only the detected script."""
    return compute_once(df, {"is_mixed_language": _mixed(f"(`{text}` IS NULL OR NOT `{text}` RLIKE r'[^{tx.SPACE}]')")})


def identify_language(df: DataFrame, text: str = "text", stat: tuple[str, str] | None = None) -> DataFrame:
    """Language of each page whose script is already detected.

    Needs ``script``, ``script_confidence`` and ``script_alternatives``. ``stat`` names
    optional columns (language, probability 0-1) of a statistical detector. Adds
    ``language``, ``language_confidence``, ``language_level``, ``language_method``,
    ``language_alternatives``, ``is_mixed_language`` and ``language_quality``.

    One-language scripts decide directly; shared scripts compare marker words. Pages of
    other scripts carry null tokens through the marker steps and cost nothing there.
    """
    toks = f"array_remove(split(`{text}`, r'{tx.SEPARATORS}'), '')"
    df = compute_once(df, {
        "_td": f"CASE WHEN script = 'Devanagari' THEN {toks} END",
        "_tb": f"CASE WHEN script = 'Bengali' THEN {toks} END",
        "_tp": f"CASE WHEN script = 'Perso-Arabic' THEN {toks} END",
    })
    df = marker_scores(df, DEVANAGARI, "_td")
    if stat:
        df = boost_scores(df, *stat)
    df = pick_language(df, "scores", "_deva")
    share = letter_share(text, fixed.ASSAMESE_LETTERS, tx.script_pattern("Bengali"))
    df = split_languages(df, BENGALI, {"Assamese": f"script = 'Bengali' AND {share} > 0.01D"}, 60.0, "_tb", "_beng")
    if stat:
        df = _detector_between_two(df, "_beng", "Assamese", "Bengali", *stat)
    letters = f"script = 'Perso-Arabic' AND regexp_count(`{text}`, '[{fixed.SINDHI_LETTERS}]') > 3"
    df = split_languages(df, PERSO_ARABIC, {"Sindhi": letters}, 50.0, "_tp", "_pers")

    only = {s: langs[0] for s, langs in fixed.SCRIPT_LANGUAGES.items() if len(langs) == 1}
    single = "CASE script " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in only.items()) + " END"
    direct = "least(99D, script_confidence)"
    none = f"CAST(array() AS {_ALTERNATIVES})"

    def result(language: str, confidence: str, basis: str, method: str, alternatives: str = none) -> str:
        return (f"named_struct('language', {language}, 'confidence', {confidence}, 'level', {_level(basis)}, "
                f"'method', {method}, 'alternatives', {alternatives})")

    df = compute_once(df, {
        "_blank": f"`{text}` IS NULL OR NOT `{text}` RLIKE r'[^{tx.SPACE}]'",
        "_single": single,
        "_unknown": f"script NOT IN ({_quoted(fixed.SCRIPT_LANGUAGES)})",
    })
    df = compute_once(df, {"_r": (
        f"CASE WHEN _blank THEN {result(_UNKNOWN, '0D', '0D', _NO_TEXT)} "
        f"WHEN _unknown THEN {result(_UNKNOWN, '0D', '0D', _NO_SCRIPT)} "
        f"WHEN _single IS NOT NULL THEN {result('_single', direct, direct, _UNIQUE)} "
        f"WHEN script = 'Devanagari' AND size(_td) = 0 THEN {result(_HINDI, '30D', '30D', _TOO_SHORT)} "
        f"WHEN script = 'Devanagari' THEN {result('_deva.language', '_deva.confidence', '_deva.raw', _MARKERS, '_deva.alternatives')} "
        f"WHEN script = 'Bengali' THEN {result('_beng.language', '_beng.confidence', '_beng.confidence', _LETTERS_FIRST, '_beng.alternatives')} "
        f"ELSE {result('_pers.language', '_pers.confidence', '_pers.confidence', _LETTERS_TOO, '_pers.alternatives')} END")})
    return compute_once(df, {
        "language": "_r.language",
        "language_confidence": "_r.confidence",
        "language_level": "_r.level",
        "language_method": "_r.method",
        "language_alternatives": "_r.alternatives",
        "is_mixed_language": _mixed("_blank"),
        "language_quality": f"CASE WHEN _blank OR _single IS NULL THEN '' WHEN {direct} > 80 THEN 'Good' ELSE 'Moderate' END",
    }, drop=("_r", "_deva", "_beng", "_pers", "_td", "_tb", "_tp", "scores", "_blank", "_single", "_unknown"))


# Defaults and method labels, as SQL literals.
_UNKNOWN, _HINDI = "'Unknown'", "'Hindi'"
_NO_TEXT = "'No text available'"
_NO_SCRIPT = "concat('Unknown script: ', script)"
_UNIQUE = "'Unique script identification'"
_TOO_SHORT = "'Default (insufficient text)'"
_MARKERS = "'Word marker analysis + statistical'"
_LETTERS_FIRST = "'Character analysis + word markers'"
_LETTERS_TOO = "'Character + word marker analysis'"


def languages_present(df: DataFrame) -> DataFrame:
    """Primary language plus the language of every other script above 5 %.

    Only scripts that stand for one language count. Adds ``languages``.
    """
    single = literal_map({s: langs[0] for s, langs in fixed.SCRIPT_LANGUAGES.items() if len(langs) == 1})
    others = F.array_compact(F.transform(
        F.filter("script_alternatives", lambda a: a["confidence"] > 5.0),
        lambda a: F.try_element_at(single, a["script"])))
    primary = F.when(F.col("language") != "Unknown", F.array("language")).otherwise(F.array().cast("array<string>"))
    return df.withColumn("languages", F.array_union(primary, others))


# --- language capability -----------------------------------------------------


def support_matrix(spark, installed: Sequence[str], second_languages: Sequence[str] = (),
                   names: Sequence[str] = ("Primary OCR", "Secondary OCR")) -> DataFrame:
    """Each registry language with its engine and kind of model.

    ``installed`` are model codes of the first engine, ``second_languages`` the
    languages the second engine serves. First capable engine wins.
    """
    registry = spark.createDataFrame(fixed.LANGUAGE_REGISTRY, "language string, script string, family string")
    direct = F.try_element_at(literal_map(fixed.MODEL_CODES), F.col("language"))
    fallback = F.try_element_at(literal_map(fixed.FALLBACK_CODES), F.col("language"))
    has = lambda code: F.coalesce(F.array_contains(string_array(installed or [""]), code), F.lit(False))
    first = has(direct) | has(fallback)
    second = F.col("language").isin(list(second_languages) or [""])
    return registry.select(
        "language", "script", "family", (first | second).alias("supported"),
        F.when(first, names[0]).when(second, names[1]).otherwise("").alias("engine"),
        F.when(~(first | second), "none").when(direct.isNotNull(), "direct")
        .when(fallback.isNotNull(), "fallback").otherwise("direct").alias("model_type"))


def resolve_request(request: Column, installed: Sequence[str], substitutes: Mapping[str, str] | None = None) -> Column:
    """Resolve a ``+``-joined code request: struct(resolved, error).

    ``hin_as_*`` codes map to ``hin``; one other missing code rejects the request.
    """
    have = string_array(installed or [""])
    extra = literal_map(dict(substitutes)) if substitutes else None
    parts = F.split(request, r"\+")

    def one(code):
        mapped = F.when(F.array_contains(have, code), code).when(code.startswith("hin_as_"), F.lit("hin"))
        return F.coalesce(mapped, F.try_element_at(extra, code)) if extra is not None else mapped

    mapped = F.transform(parts, one)
    ok = ~F.exists(mapped, lambda c: c.isNull())
    return F.struct(
        F.when(ok, F.array_join(mapped, "+")).alias("resolved"),
        F.when(~ok, F.concat(F.lit("Language model '"), request, F.lit("' not installed."))).otherwise("").alias("error"))


def available_codes(request: Column, installed: Sequence[str]) -> Column:
    """Multi-language form: the available codes of a request, joined; '' when none is."""
    return F.array_join(F.array_intersect(F.split(request, r"\+"), string_array(installed or [""])), "+")


def script_codes(script: Column, installed: Sequence[str] = ()) -> Column:
    """Codes to try for a script; unknown scripts get the installed broad-pass codes."""
    table = F.create_map(*[x for s, c in fixed.SCRIPT_CODES.items() for x in (F.lit(s), F.lit("+".join(c)))])
    broad = "+".join(c for c in fixed.BROAD_CODES if c in installed)
    return F.coalesce(F.try_element_at(table, script), F.lit(broad))


def rank_scripts_relation(df: DataFrame, key: str) -> DataFrame:
    """Census as rows (key, script, n), for grouping across pages."""
    return df.select(key, F.explode("scripts").alias("s")).select(key, "s.script", "s.n")
