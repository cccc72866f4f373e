"""Script and language identification against hand-made pages and brute force."""

import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumine.functions import fixed, text as tx
from vellumine.operators import profiles as lp, text_id as ti
from vellumine.plans import flows

PAGES = {
    "hindi": "यह एक परीक्षण है और इस में हिन्दी के शब्द हैं। वह घर में नहीं था, लेकिन उनका काम हो गया।",
    "marathi": "हा एक मजकूर आहे आणि तो मराठी मध्ये आहे. त्यांना ही माहिती नाही, पण केली आहे.",
    "nepali": "यो नेपाली भाषा हो र यस मा धेरै शब्द छन्। त्यो किताब छैन भने पनि हुन्छ।",
    "bengali": "তিনি বাংলা বলেন এবং তার একটি বই আছে কিন্তু আমি জানি না।",
    "assamese": "তেওঁ অসমীয়া কয় আৰু তাৰ এটা কিতাপ আছে, মই জানো।",
    "urdu": "یہ ایک کتاب ہے اور اس میں اردو کے الفاظ ہیں۔",
    "sindhi": "هي سنڌي ٻولي آهي ۽ ان ۾ ڪتاب آهن، ڪري ٿي، ٺيڪ، ٽي، ڳالهه.",
    "tamil": "இது ஒரு சோதனை உரை ஆகும்.",
    "kannada": "ಇದು ಕನ್ನಡ ಪಠ್ಯ.",
    "punjabi": "ਇਹ ਪੰਜਾਬੀ ਹੈ।",
    "santali": "ᱚᱞ ᱪᱤᱠᱤ ᱞᱤᱯᱤ",
    "manipuri": "ꯃꯩꯇꯩ ꯃꯌꯦꯛ",
    "english": "This is an English page with ½ of 12 items & more…",
    "mixed": "यह हिन्दी पाठ है with quite some English words inside यह भी है",
    "latin_first": "mostly English letters here यहपाठहै और",
    "digits": "123 ४५६ !!! ²³",
    "blank": "  \n",
    "greek": "Ελληνικά γράμματα",
    "dandas": "। ॥ ,",
}


def census(text):
    counts = Counter()
    for ch in text:
        if ch.isspace() or ch.isdigit() or unicodedata.category(ch)[0] in "PS":
            continue
        for script, ranges in fixed.SCRIPT_BLOCKS.items():
            if any(a <= ord(ch) <= b for a, b in ranges):
                counts[script] += 1
                break
    return counts


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "page string, text string")


@pytest.fixture(scope="module")
def identified(pages):
    return {r.page: r for r in flows.identify_pages(pages).collect()}


def test_census_matches_brute_force(pages):
    got = {r.page: {s.script: s.n for s in r.scripts} for r in ti.script_census(pages).collect()}
    assert got == {k: dict(census(v)) for k, v in PAGES.items()}


def test_ties_go_to_the_script_seen_first(spark):
    df = spark.createDataFrame([("ab कख",), ("कख ab",)], "text string")
    assert [r.scripts[0].script for r in ti.script_census(df).collect()] == ["Latin", "Devanagari"]


@pytest.mark.parametrize("page,language", [
    ("hindi", "Hindi"), ("marathi", "Marathi"), ("nepali", "Nepali"), ("bengali", "Bengali"), ("assamese", "Assamese"), ("urdu", "Urdu"),
    ("sindhi", "Sindhi"), ("tamil", "Tamil"), ("kannada", "Kannada"), ("punjabi", "Punjabi"), ("santali", "Santali"), ("manipuri", "Manipuri"),
    ("english", "English"), ("digits", "Unknown"), ("blank", "Unknown"), ("greek", "Unknown"), ("mixed", "Hindi")])
def test_language(identified, page, language):
    assert identified[page].language == language


def test_methods_and_levels(identified):
    assert identified["blank"].language_method == "No text available"
    assert identified["greek"].language_method == "Unknown script: Unknown" and identified["greek"].language_level == "Inconclusive"
    assert identified["tamil"].language_confidence == 99.0 and identified["tamil"].language_quality == "Good"
    assert identified["mixed"].is_mixed_language and not identified["hindi"].is_mixed_language
    assert identified["latin_first"].script == "Devanagari"
    assert identified["assamese"].language_confidence > 80 and identified["assamese"].language_alternatives[0].language == "Bengali"


def test_marker_scores_brute_force(spark):
    text = PAGES["hindi"]
    df = spark.createDataFrame([(text,)], "text string").withColumn("tokens", tx.tokens(F.col("text")))
    got = {s.language: s.score for s in ti.marker_scores(df, ti.DEVANAGARI).first().scores}
    words = df.first().tokens
    for language, vocabulary in ti.DEVANAGARI.items():
        hits = [w for w in words if w in vocabulary]
        want = (len(hits) / len(words) * 0.7 + len(set(hits)) / len(vocabulary) * 0.3) * 100
        assert abs(got[language] - want) < 1e-9


def test_statistical_vote_changes_the_winner(spark):
    base = ti.detect_script(spark.createDataFrame([("कमल गमन", "Marathi", 0.99), ("ক খ গ", "Assamese", 0.9), ("ক খ গ", "Bengali", 0.9)], "text string, sl string, sp double"))
    rows = ti.identify_language(base, stat=("sl", "sp")).collect()
    assert [r.language for r in rows] == ["Marathi", "Assamese", "Bengali"]
    assert rows[1].language_confidence == 65.0 and rows[2].language_confidence == 69.0


def test_languages_present(pages):
    found = {r.page: r.languages for r in ti.languages_present(flows.identify_pages(pages)).collect()}
    assert found["mixed"] == ["Hindi", "English"] and found["blank"] == []


def test_profiles_recognise_their_training_languages(spark):
    rows = [("a", "en", "the house and the garden of the king"), ("b", "fr", "la maison et le jardin du roi de la ville"), ("c", "de", "das haus und der garten des königs")]
    df = spark.createDataFrame(rows, "k string, lang string, text string")
    out = {r.k: r for r in lp.score_profiles(df, "k", lp.train_profiles(df)).collect()}
    assert {k: r.stat_language for k, r in out.items()} == {"a": "en", "b": "fr", "c": "de"}
    assert all(0 < r.stat_probability <= 1 for r in out.values())


def plain_scores(profiles, text, n):
    """{language: score in units} of one page."""
    grams = Counter(text.lower()[i : i + n] for i in range(len(text) - n + 1))
    floors = {r.language: r.floor for r in profiles}
    out = {x: sum(grams.values()) * round(f * lp.UNIT) for x, f in floors.items()}
    for r in profiles:
        out[r.language] += grams.get(r.gram, 0) * round(r.gain * lp.UNIT)
    return out


@pytest.mark.parametrize("n", [2, 3, 5])
def test_grams_are_those_of_the_letters(spark, n):
    texts = [("a", None, "Ab\U0001f600\nABa"), ("a", None, "abab"), (None, 1, "x" * n), ("b", 2, "x" * (n - 1)), ("b", 2, ""), ("b", 3, None), (None, 1, "éÉé̀ x")]
    df = spark.createDataFrame(texts, "k string, j int, text string")
    got = {(r.k, r.j, r.gram): r.n for r in lp.gram_counts(df, ["k", "j"], n=n).collect()}
    want = Counter((k, j, t.lower()[i : i + n]) for k, j, t in texts if t for i in range(len(t) - n + 1))
    assert got == want


def test_300_languages_score_alike_in_any_partitions_and_blocks(spark):
    import random

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéü "
    rows = [(f"l{i:03d}", "".join(rng.choices(letters, [rng.random() ** 3 for _ in letters], k=120))) for i in range(300)]
    profiles = lp.train_profiles(spark.createDataFrame(rows, "lang string, text string")).cache()
    pages = [(f"p{i}", rows[i * 7][1][:60]) for i in range(40)] + [("short", "ab"), ("none", None), ("strange", "漢字漢字漢"), ("p0", "more of the page p0"), (None, "abcd")]
    df = spark.createDataFrame(pages, "k string, text string")
    found = profiles.collect()
    first = None
    for parts, block in ((1, 1 << 20), (7, 1 << 20), (3, 9000)):
        out = {r.k: (r.stat_language, r.stat_probability) for r in lp.score_profiles(df.repartition(parts), "k", profiles, block_grams=block).collect()}
        assert first is None or out == first
        first = out
    assert set(first) == {k for k, t in pages if t and len(t) > 2}
    for k in ("p3", "p0", "strange", None):
        sums = Counter()
        for key, t in pages:
            if key == k:
                sums.update(plain_scores(found, t, 3))
        assert first[k][0] == max(sums, key=lambda x: (sums[x], x))
        best = max(sums.values())
        assert first[k][1] == pytest.approx(1 / sum(__import__("math").exp((s - best) / lp.UNIT) for s in sums.values()))


def test_scores_without_profiles_or_pages(spark):
    none = spark.createDataFrame([], "k string, lang string, text string")
    assert lp.train_profiles(none).count() == 0 and lp.score_profiles(none, "k", lp.train_profiles(none)).count() == 0
    some = spark.createDataFrame([("a", None, "no language"), ("b", "en", "the house")], "k string, lang string, text string")
    assert [r.stat_language for r in lp.score_profiles(some, "k", lp.train_profiles(some)).collect()] == ["en", "en"]
    assert lp.score_profiles(none, "k", lp.train_profiles(some)).count() == 0


def test_support_matrix(spark):
    got = {r.language: r for r in ti.support_matrix(spark, ["hin", "ben"], ["Tamil", "Hindi"]).collect()}
    assert len(got) == 22
    assert (got["Hindi"].engine, got["Hindi"].model_type) == ("Primary OCR", "direct")
    assert (got["Konkani"].engine, got["Konkani"].model_type) == ("Primary OCR", "fallback")
    assert (got["Tamil"].engine, got["Tamil"].model_type) == ("Secondary OCR", "direct")
    assert (got["Kashmiri"].supported, got["Kashmiri"].model_type) == (False, "none")


def test_code_requests(spark):
    df = spark.createDataFrame([("hin+ben",), ("hin_as_dogri+ben",), ("hin+xyz",)], "r string")
    rows = df.select(ti.resolve_request(F.col("r"), ["hin", "ben"]).alias("x"), ti.available_codes(F.col("r"), ["hin"]).alias("a")).collect()
    assert [r.x.resolved for r in rows] == ["hin+ben", "hin+ben", None] and rows[2].x.error == "Language model 'hin+xyz' not installed."
    assert [r.a for r in rows] == ["hin", "", "hin"]
    codes = spark.createDataFrame([("Bengali",), ("Klingon",)], "s string").select(ti.script_codes(F.col("s"), ["eng", "hin"]).alias("c")).collect()
    assert [r.c for r in codes] == ["ben+asm", "hin+eng"]


def test_normal_form(spark):
    df = spark.createDataFrame([("é",), ("plain é",), (None,), ("য়",)], "t string")
    assert [r[0] for r in df.select(tx.nfc(F.col("t"))).collect()] == ["é", "plain é", None, "য়"]


def test_normal_form_sends_only_runs_to_python(spark):
    texts = ["plain", "", None, "a\u0301", "\u0301a\u0301\n\u0301", "xe\u0301y o\u0302\u0323z", "\u1100\u1161\u11a8 \u0915\u093c", "\U0001d15e — “q” \u212b", "e\u0323\u0301\x00", "한글 각"]
    texts += ["long " * 40_000 + "e\u0301 " * 3, "e\u0301" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r.i: r.n for r in df.select("i", tx.nfc(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    # no text crosses whole: what the function gets is an array of runs
    plan = df.select(tx.nfc(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    python = plan.split("ArrowEvalPython")[1].split("\n")[0]
    assert "_nfc_runs" in python and "regexp_extract_all(t" in plan


def test_grams_are_cut_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    column = pa.array([None, *["abcdé" * 2000] * 900, ""])
    tracemalloc.start()
    firsts, size, grams = [], 0, 0
    for first, part in lp._slices(column):
        firsts.append(first)
        size += len(part)
        grams += len(lp.gram_codes(part, 3)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(column) and grams == 900 * 9998 and firsts[0] == 0 and len(firsts) > 10
    assert peak < 100 << 20


def test_census_counts_the_leading_script_first(spark, pages):
    texts = [*PAGES.values(), "", None, "— “क” ಕನ್ನಡ क क", "।।ಕ", "漢字 한글 কথা", "\U0001d15e ಕ\ufb50", "a" * 50 + "ᱚ ꯃ ﷲ ଓ తె മ ગ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: {s.script: s.n for s in r.scripts} for r in ti.script_census(df).collect()}
    assert got == {i: dict(census(t or "")) for i, t in enumerate(texts)}
    flags = ti.mixed_language(ti.detect_script(pages)).select("page", "is_mixed_language").collect()
    assert sorted(flags) == sorted(flows.identify_pages(pages).select("page", "is_mixed_language").collect())
