"""Merkle manifest, spelling variants and packing next to plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import manifest as M
from vellumine.llm import packing, queries, spelling
from vellumine.llm.common import lower_ascii

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp int, node string, path int, child string, n int, id string, word int, ids string, _g int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "n", 2, "c", 3, "i", 4, "d", 5) for r in rows], DOCS)


# -- Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Levels of (digest) from the leaves to the root, runs of 16."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
        at //= 16
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, path) of every row."""
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append((r[0], h(*map(framed, r))))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        of[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([leaf for _, leaf in of[s]])
    crown = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (i, leaf) in enumerate(of[s]):
            out.append((i, leaf, trees[s][-1][0], crown[-1][0], plain_path(trees[s], at) + plain_path(crown, place)))
    return out


def odd_rows(seed=3):
    rng = random.Random(seed)
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(300)]
    rows += [(1000 + i, f"host{i}", None, i, "A b") for i in range(40)]
    rows += [(None, None, None, None, None), (None, "hot", "de", None, ""), (7, "hot", "en", 3, "Text 7"), (7, "hot", "en", 3, "another"), (2000, "", "é", -1, "é" * 5000),
             (2001, None, "en", 2, "X"), (2002, "é", "en", 1, "\U0001f600 Z")] + [(2003, "ten", "x", i % 3, None) for i in range(20)]
    rng.shuffle(rows)
    return rows


def test_manifest_is_that_of_a_plain_tree(spark):
    rows = odd_rows()
    held = M.manifest(docs(spark, rows), lower_ascii(F.col("text")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in held.collect()]
    want = plain_manifest(rows)
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_manifest_finds_tampered_rows(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    whole = M.verified(M.manifest(df)).collect()
    assert all(r.verified and r.folded_root == r.root for r in whole) and len(whole) == len(rows)
    found = {r.doc_id: r.verified for r in M.verified(M.manifest(df, F.when(F.col("doc_id") % 2 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text")))).collect()}
    assert not found[10] and found[11] and found[2000] and found[2003]
    text = {r[0]: r[4] for r in rows}
    for i, ok in found.items():
        if i is not None and i < 300 and i != 7:
            assert ok == (i % 2 == 1 or not any("A" <= c <= "Z" for c in text[i]))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    got = {r.doc_id: r for r in M.manifest(docs(spark, rows)).collect()}
    for i, leaf, subroot, root, path in plain_manifest(rows):
        assert (got[i].leaf, got[i].subroot, got[i].root, [tuple(s) for s in got[i].path]) == (leaf, subroot, root, path)
        assert got[i].root == got[i].subroot


def test_manifest_of_nothing(spark):
    assert M.verified(M.manifest(docs(spark, []))).count() == 0


def test_numbering_spreads_a_hot_source(spark):
    df = spark.range(5000).select(F.lit("hot").alias("grp"), F.col("id").alias("doc_id"), F.lit("x").alias("node")).union(spark.range(20).selectExpr("CAST(NULL AS STRING)", "id", "'y'"))
    got = M.numbered(df.repartition(7), "grp", ["doc_id", "node"]).collect()
    assert all(r["rank"] == r.doc_id and r.n == (5000 if r.grp else 20) for r in got) and len(got) == 5020


# -- spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if len(w or "") > 1 and len(v or "") > 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def vocabulary(seed, size, letters, longest):
    rng, words = random.Random(seed), set()
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        words.add(w)
        for _ in range(3):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]) or c
            words.add(w)
    return {w: rng.choice([1, 2, 3, 7, 20, 300]) for w in sorted(words)}


@pytest.mark.parametrize(("letters", "longest", "rare"), [("ab", 8, 16), ("abcé\U0001f600", 7, 1), ("aeinst", 14, 0), ("abcdefghij", 30, 2)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, letters, longest, rare):
    monkeypatch.setattr(spelling, "RARE", rare)  # grams of every length
    counts = vocabulary(longest, 300, letters, longest) | {None: 4}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n int, key string, long int").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    assert got == plain_variants(counts)


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    words = [("a" * 5 + "b" * i, 2 ** i) for i in range(40)]
    got = spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.root for r in got} == {words[-1][0]} and all(r.form is None or len(r.form) == len(r.word) + 1 for r in got)


def test_words_one_edit_apart_share_a_rare_gram():
    rng = random.Random(5)
    words = list(vocabulary(1, 4000, "abcde", 12))
    n, keys, times = spelling.count_grams(words)
    assert all(times[n == k].sum() == sum(len(w) + 3 - k for w in words if len(w) + 2 >= k) for k in range(2, 7))
    for least in (0, 5, 50):
        d = spelling.Dictionary(keys[times > least], times[times > least])
        for _ in range(300):
            w = "".join(rng.choice("abcde") for _ in range(rng.randint(2, 11)))
            i, c = rng.randrange(len(w)), rng.choice("abcde")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            index, key, long = spelling.listed(d, [w, v])
            short = set(key[(index == 0) & ~long].tolist())
            other = set(key[(index == 1) & (long if len(v) > len(w) else ~long)].tolist())
            assert short & other, (w, v)


def test_affected_counts_the_grams_over_a_place():
    sizes = np.array([[3, 2, 2, 3, 2], [2, 2, 2, 2, 2]])
    assert spelling.affected(sizes).tolist() == [3, 2]


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "apple Apple APPLE apple's"), (None, "apple maple-maple maple"), (5, "ÉCLAIR éclair ÉCLAIR " * 3)]
    df = spark.createDataFrame([(i, t, "r", "w") for i, t in rows], "doc_id long, text string, source string, n string")
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(0))
    got = {r.word: r.n for r in spelling.word_counts(df, runs).collect()}
    assert got == {"apple": 5, "maple": 3, "Éclair": 6, "éclair": 3}


# -- packing

ODD = [None, "", "a", " ", "a  b \n\n c", "it's  we'll'S don't", "a\xa0 b　 x", "!\x1c ! \x0b b", "x\x85 y. z,\" w", "<|endoftext|> a<|endoftext|>", "漢字 かな。カナ", "3.14, é! ü;ß",
       "​ a​ b", "word " * 3000, "x" * 5000, "\U0001f600 " * 50, " lead", "trail ", "a\tb\r\nc"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.MODEL)
    t.encode_special_tokens = True
    return t


def check_pieces(rows, texts, library, longest=packing.LONGEST):
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert set(of) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        parts, at = sorted(of[i], key=lambda r: r.start), 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(ids) and r.offset == 0 and r.length <= longest and not r.length & (r.length - 1)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            if "ids" in r:
                assert r.ids == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
        lengths = [r.length for r in parts]
        assert lengths == sorted(lengths, reverse=True) and all(n == 1 or k == longest for k, n in Counter(lengths).items())
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_pieces_of_all_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(queries.QUERIES["op13_power_packing"](spark, sf_dir).collect(), texts, library)


def test_pieces_of_odd_texts(spark, library):
    df = docs(spark, [(i, "s", "en", 1, t) for i, t in enumerate(ODD)]).repartition(3)
    check_pieces(packing.pack(df).collect(), dict(enumerate(ODD)), library)
    check_pieces(packing.pack(df, longest=4).collect(), dict(enumerate(ODD)), library, 4)
    assert packing.pack(docs(spark, [])).count() == 0
    twice = packing.pack(docs(spark, [(None, "s", "en", 1, "a b"), (None, "s", "en", 1, "a b"), (3, "s", "en", 1, None)])).collect()
    assert len({r.sequence_id for r in twice}) == len(twice) == 5  # "a b" and the end are 3 ids: 2 + 1
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, longest=1000)


def test_words_are_forgotten_within_their_bound(monkeypatch, library):
    with open(packing.MODEL, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    monkeypatch.setattr(packing, "KNOWN_BYTES", 2000)
    monkeypatch.setattr(packing, "BLOCK", 7)
    monkeypatch.setattr(packing, "WINDOW", 50)
    texts = [*ODD, *(f"word{i} other{i * 7}, done." for i in range(200))]
    ids, sizes = encoder.encode(texts, 1)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_sequences_of_one_length_share_a_folder(spark, tmp_path, library):
    packing.write_buckets(packing.pack(docs(spark, [(i, "s", "en", 1, "word " * i) for i in range(40)])), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").iterdir() if p.is_dir()} == {f"length={1 << k}" for k in range(6)}
    back = spark.read.parquet(str(tmp_path / "b"))
    assert all(len(r.ids) == r.length for r in back.collect())
