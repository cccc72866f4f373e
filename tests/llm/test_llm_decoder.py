"""The decoder of disguised words next to an enumeration of its lattice."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from vellumine.llm import toxicity as X


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(X.SIGNS, 0.3), size=(X.SIGNS,) * 3)
    return np.log(np.maximum(p, 1e-9)).astype(np.float32)


@pytest.fixture()
def decoder(model):
    return X.Decoder(model)


def log_p(model, word):
    """Log probability of letters, with the end of the word."""
    codes = [0, 0, 0, *[X.Decoder.code(c) for c in word], 0]
    return sum(float(model[tuple(codes[i : i + 4])]) for i in range(len(codes) - 3))


def readings(decoder, word):
    """Every reading of a word: (log probability of its signs, letters)."""
    for parts in itertools.product(*decoder.columns(word)):
        yield sum(w for _, w in parts), "".join(to for to, _ in parts)


def test_viterbi_finds_the_best_of_all_readings(decoder, model):
    rng = random.Random(3)
    words = ["a$$", "f*k", "@$$", "b1tch", "sh!!t", "1d10t", "c**t", "*#", "5", "éé1", "а$а"] + ["".join(rng.choices("abe13$!|-.6*", k=rng.randint(1, 6))) for _ in range(60)]
    for word in words:
        if word.count("*") + word.count("#") > 2:
            continue
        every = [(w + log_p(model, text), text) for w, text in readings(decoder, word)]
        some = [x for x in every if x[1]] or every
        best = max(some)[0]
        paths = decoder.paths(word)
        assert max(paths)[0] == pytest.approx(best, abs=1e-3)
        assert dict((t, s) for s, t in some)[decoder.decode(word)] == pytest.approx(best, abs=1e-3) or any(t == decoder.decode(word) and abs(s - best) < 1e-3 for s, t in some)
        for score, text in paths:  # the best reading of each last state
            assert score == pytest.approx(max(s for s, t in every if t[-3:] == text[-3:] and (len(t) >= 3 or len(t) == len(text))), abs=1e-3)


def test_fragments_are_cut_as_the_best_of_all_cuts(decoder, model):
    rng = random.Random(4)
    for _ in range(150):
        run = ["".join(rng.choices("abcdeio", k=rng.randint(1, 2))) for _ in range(rng.randint(2, 9))]
        best = None
        for marks in itertools.product([False, True], repeat=len(run) - 1):
            cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
            score = sum(log_p(model, "".join(run[i:j])) for i, j in zip(cuts, cuts[1:], strict=False))
            if best is None or score > best[0]:
                best = score, cuts
        got = decoder.joins(run)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j in zip(best[1], best[1][1:], strict=False) if j - i > 1]
        assert all(forms[0] for _, _, forms in got)


def scored(model, texts, weights):
    class Sent:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = next(X.hits(Sent(model), Sent(weights))(iter([batch])))
    return [tuple(round(out.column(i)[r].as_py(), 6) for i in range(3)) for r in range(len(texts))]


def test_every_later_beginning_of_single_letters_counts(model):
    weights = {"=idiot": 5.0, "idio": 3.0, "moron": 2.0, "=oron": 7.0}
    text = "x y z i d i o t"
    assert scored(model, [text], weights)[0][0] == 5.0
    long = scored(model, [" ".join("qq" * 30 + "idiot" + "zw" * 40)], weights)[0]
    assert long[0] == 3.0  # only its beginning is there: the run goes on
    assert scored(model, [" ".join("xxmoron"), " ".join("moronx"), "o r o n"], weights) == scored(model, [" ".join("xxmoron"), " ".join("moronx"), "o r o n"], weights)


@pytest.mark.parametrize("text", [" ".join("abcdefgh" * 25_000), " ".join("漢字" * 50_000), "a" + "*#" * 2_500 + "b", "%$#" * 2_000, "a " * 100_000, "ab " * 60_000, "$ " * 20_000])
def test_work_is_linear_in_long_texts(model, text):
    start = time.process_time()
    scored(model, [text], {"=idiot": 5.0, "abcd": 1.0})
    assert time.process_time() - start < 90


def test_memories_are_bounded_in_bytes(model, monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 20_000)
    d = X.Decoder(model)
    for i in range(2_000):
        d(f"w{i}$x")
        d.nearest(f"{i % 100}$")
    assert d.seen.held < 21_000 and len(d.seen) < 100 and d.near.held < 21_000


def test_columns_with_odd_names_pass_the_filter(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'a clean text' AS text, named_struct('a b', 1, 'c-d', array(named_struct('e.f', 'g'))) AS `s t`")
    docs = spark.createDataFrame([(i, "some words of prose " + ("idiot" if i % 2 else "nice")) for i in range(60)], "doc_id long, text string")
    scorer = X.fit(docs, docs.selectExpr("text", "CAST(doc_id % 2 AS INT) AS toxic"))
    out = X.drop_toxic(df, scorer)
    assert out.schema == df.schema and out.collect() == df.collect()
