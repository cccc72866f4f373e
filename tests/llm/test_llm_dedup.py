"""Exact dedup, n-gram join, substring dedup and embedding dedup next to plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vellumine.llm import embedding_dedup, exact_dedup, ngram_join, substring_dedup
from vellumine.llm import words as W
from vellumine.llm.common import components

DOCS = "doc_id long, text string, source string, digest string, salt int, body binary, id string, size long, k long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", "d", 1, b"x", "y", 2, 3) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, None), (4, "x " * 5000), (5, "a b"), (6, "a b"), (6, "a b"), (7, "é 😀"), (None, "a b"), (None, "only")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda c: F.length(c).cast("string")])
def test_exact_groups(spark, digest):
    got = [tuple(r) for r in exact_dedup.exact_groups(docs(spark, ODD), digest=digest).collect()]
    groups = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda c: F.length(c).cast("string")])
def test_drop_exact_copies_leaves_one_row_a_text(spark, digest):
    df = docs(spark, ODD)
    out = exact_dedup.drop_exact_copies(df, digest=digest)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {(r.text or ""): r.doc_id for r in out.collect()}
    assert out.count() == len(got) == 5
    assert got["a b"] == 6 and got[""] == 3 and got["only"] is None


def test_dedup_of_nothing(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    assert ngram_join.ngram_groups(none).count() == 0
    assert substring_dedup.repeated_windows(none).count() == 0


def near_copies(seed, groups=4, copies=12):
    """Texts and edited copies with similarities on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 6, 8, 9, 12, 30, 90]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [f"n{rng.randrange(99)}"], [w[at].upper()], [w[at], "x"]])
            rows.append((len(rows) * 7 + 3, "  ".join(w) if rng.random() < 0.5 else "\n".join(w)))
    return rows


def test_ngram_groups_are_those_of_all_pairs(spark):
    rows = near_copies(5, groups=14) + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "A b"), (10**6 + 4, "a B"), (10**6 + 5, "q " * 20000)]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_groups(docs(spark, rows)).collect()}
    assert got == brute.ngram_components(rows)


def test_ngram_rows_with_null_or_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (9, text), (None, text), (5, "eight nine ten")]
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in ngram_join.ngram_groups(docs(spark, rows)).collect())
    assert got == [(False, 5, 1, 5), (False, 5, 3, 5), (False, 5, 3, 5), (False, 9, 3, 5), (True, 0, 3, None)]
    left = ngram_join.drop_near_copies(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 5), (False, 5), (False, 5), (True, 0)]


def test_small_sets_meet_in_a_subset():
    for a in range(1, 12):
        for b in range(a, 15):
            o = ngram_join.shared_at_least(a, b)
            if o > a:
                continue
            one, two = np.arange(a, dtype=np.uint64), np.concatenate([np.arange(o), np.arange(100, 100 + b - o)]).astype(np.uint64)
            assert set(ngram_join.small_keys(one)) & set(ngram_join.small_keys(two)), (a, b)


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(W.mixed(rng.integers(0, 2**40, rng.integers(1, 400)).astype(np.uint64)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], W.mixed(rng.integers(0, 2**40, rng.integers(0, 90)).astype(np.uint64))]))
        if len(b):
            assert ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({6: 100}, 1.0) < 6 <= ngram_join.choose_boundary({6: 100}, 50.0)


@pytest.mark.parametrize("window", [8, 50])
def test_windows_that_repeat_go(spark, window):
    rng = random.Random(window)
    common = [[f"c{rng.randrange(999)}" for _ in range(window * 2)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 3 * window))]
        for _ in range(rng.randrange(0, 3)):
            c = rng.choice(common)
            a = rng.randrange(0, window)
            w[rng.randrange(len(w) + 1) : 0] = c[a : a + rng.randrange(window - 2, window + 9)]
        rows.append((1000 - i * 3, "\n ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "x " * 300), (5003, "x " * 300)]
    got = {r[0]: (r[1], r[2], r[3]) for r in substring_dedup.repeated_windows(docs(spark, rows), window=window).collect()}
    assert got == brute.cut_windows(rows, window)


def test_windows_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, text), (2, text), (2, "a b"), (None, text)]
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in substring_dedup.repeated_windows(docs(spark, rows), window=8).collect())
    assert got == [(False, 1, 20, 0), (False, 2, 2, 0), (False, 2, 20, 20), (False, 2, 20, 20), (True, 0, 20, 0)]


def test_covers_have_every_difference():
    for v, d in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    low = {x: x for e in edges for x in e}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        low[y] = x
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, n string")


def links_of_all(rows, threshold=0.98):
    ok = [(i, np.array(e, dtype=np.float32).astype(float), lab) for i, e, lab in rows if i is not None and e and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, low = Counter(), {i: i for i, *_ in rows if i is not None}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, x, a) in enumerate(ok):
        for j, y, b in ok[:k]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n.update([i, j])
                p, q = sorted((top(i), top(j)))
                low[q] = p
    return {i: (n[i], top(i), top(i) == i) for i in low}


@pytest.mark.parametrize("slack,block", [(None, 1024), (None, 16)])
def test_near_vectors_have_every_link(spark, slack, block):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(300):
        v = centres[k % 12] + rng.normal(size=8) * rng.choice([0.02, 0.12, 0.3])
        rows.append((k * 5 + 2, [float(x) for x in v], int(k % 3)))
    rows += [(9001, rows[0][1], rows[0][2]), (9002, rows[0][1], rows[0][2]), (9003, [2 * x for x in rows[0][1]], rows[0][2]), (9004, rows[0][1], None),
             (9005, None, 1), (9006, [], 1), (9007, [0.0] * 8, 1), (9008, [1.0, None] + [0.0] * 6, 1), (9009, [float("nan")] + [1.0] * 7, 1), (9010, [1.0, 0.0], 1), (9011, [2.0, 0.0], 1)]
    df = vectors(spark, [(*r, 1, "x") for r in rows])
    got = {r[0]: (r[1], r[2], r[3]) for r in embedding_dedup.near_vectors(df, slack=slack, cell=40, block=block).collect()}
    assert got == links_of_all(rows)


def test_near_vectors_of_nothing_and_null_ids(spark):
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0
    got = [tuple(r) for r in embedding_dedup.near_vectors(vectors(spark, [(None, [1.0, 0.0], 1, 1, "x"), (4, [1.0, 0.0], 1, 1, "x"), (4, [1.0, 0.0], 1, 1, "x")])).collect()]
    assert Counter(got) == Counter([(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)])
