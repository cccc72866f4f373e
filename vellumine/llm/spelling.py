"""Spelling variants: words one edit apart, found through an index of variable-length grams.

A gram is as long as it has to be: two characters and, while the gram so far is frequent in
the vocabulary, one more, up to about half a word. From every position of a word, with marks
for its begin and end, one gram starts. Where a gram ends depends on its own characters alone,
so an edit leaves every gram as it is that does not hold the edited place. No place lies in
more grams than ``affected`` counts, so two words one edit apart share all but that many of
each one's grams, at places that differ by the edit at most, and then the ``affected`` + 1
rarest grams of one and of the other have one in common. Only these lists are merged; every
pair that meets in one is verified.

The dictionary of frequent grams is bounded: of each length at most ``KNOWN`` grams can exceed
one ``KNOWN``-th of all grams. It says how long grams are and which are rare; results do not
depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import stored
from vellumine.llm.words import U64, mixed

SHORTEST, LONGEST = 2, 6  # characters of a gram
KNOWN = 1 << 18  # frequent grams of one length, at most
RARE = 16  # grams of a small vocabulary up to this count are not extended
BEGIN, END = 0x110000, 0x110001  # no character has these codes
STEP = U64(0x9E3779B97F4A7C15)


def longest(size: int) -> int:
    """The longest gram for words of ``size`` characters and one more."""
    return min(size, max(3, (size + 2) // 2), LONGEST)


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and code points of the words of each length, with the marks around them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        codes = np.empty((len(at), size + 2), U64)
        codes[:, 0], codes[:, -1] = BEGIN, END
        flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
        codes[:, 1:-1] = np.frombuffer(flat, "<u4").reshape(len(at), size)
        yield at, codes


def hashed(codes: np.ndarray, start: int, upto: int, before: np.ndarray | None) -> np.ndarray:
    """Hash of the gram from ``start`` to ``upto``; ``before`` is that without its last character."""
    if before is None:
        before = np.zeros(len(codes), U64)
        for i in range(start, upto - 1):
            before = mixed(before + codes[:, i] * STEP + U64(1))
    return mixed(before + codes[:, upto - 1] * STEP + U64(1))


def count_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, hash, occurrences) of the distinct grams of ``words``."""
    out = []
    found: dict[int, list[np.ndarray]] = {}
    for _, codes in coded(words):
        width = codes.shape[1]
        for p in range(width - SHORTEST + 1):
            h = None
            for n in range(SHORTEST, min(LONGEST, width - p) + 1):
                h = hashed(codes, p, p + n, h)
                found.setdefault(n, []).append(h)
    for n, parts in found.items():
        keys, times = np.unique(np.concatenate(parts), return_counts=True)
        out.append((np.full(len(keys), n), keys, times))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))


class Dictionary:
    """The frequent grams and their numbers."""

    def __init__(self, keys: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.times = keys[order], times[order]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Occurrences of each gram if it is frequent, else 0."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.times[at], 0)

    def decompose(self, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, length and number of the gram at each place (columns) of each word (rows)."""
        width = codes.shape[1]
        shape = (len(codes), width - SHORTEST + 1)
        grams, sizes, times = np.empty(shape, U64), np.full(shape, SHORTEST), np.empty(shape, np.int64)
        for p in range(shape[1]):
            h = hashed(codes, p, p + SHORTEST, None)
            grams[:, p], times[:, p] = h, self.number(h)
            live = np.flatnonzero(times[:, p] > 0)
            for n in range(SHORTEST + 1, min(most, width - p) + 1):
                if not len(live):
                    break
                h = hashed(codes[live], p, p + n, grams[live, p])
                t = self.number(h)
                grams[live, p], sizes[live, p], times[live, p] = h, n, t
                live = live[t > 0]
        return grams, sizes, times


def affected(sizes: np.ndarray) -> np.ndarray:
    """The most grams that hold one place of the word, of all places between the marks."""
    rows, places = sizes.shape
    change = np.zeros((rows, places + SHORTEST), np.int64)
    change[:, :places] += 1
    row = np.arange(rows)
    for p in range(places):
        change[row, p + sizes[:, p]] -= 1
    return change.cumsum(axis=1)[:, 1 : places + SHORTEST - 2].max(axis=1)


def listed(dictionary: Dictionary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, key, long) entries of the lists to merge.

    Words of ``size`` characters meet their like and, as the shorter ones, words of ``size`` + 1
    under keys of that size. A longer one is entered under a gram's place and the place before,
    where the gram stands in a word without one of the characters left of it.
    """
    index, keys, long = [], [], []
    for at, codes in coded(words):
        size = codes.shape[1] - 2
        known: dict[int, tuple] = {}
        for of, is_long in ((size, False), (size - 1, True)):
            if of < 2:
                continue
            if longest(of) not in known:
                grams, sizes, times = dictionary.decompose(codes, longest(of))
                order = np.lexsort((np.broadcast_to(np.arange(grams.shape[1]), grams.shape), grams, times))
                chosen = np.zeros(grams.shape, bool)
                np.put_along_axis(chosen, order, np.arange(grams.shape[1]) <= affected(sizes)[:, None], axis=1)
                known[longest(of)] = grams, chosen
            grams, chosen = known[longest(of)]
            row, place = np.nonzero(chosen)
            for shift in (0, 1) if is_long else (0,):
                ok = place >= shift
                index.append(at[row[ok]])
                keys.append(mixed(grams[row[ok], place[ok]] + (place[ok] - shift).astype(U64) * STEP + U64(of << 32)))
                long.append(np.full(int(ok.sum()), is_long))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(index), np.concatenate(keys), np.concatenate(long)


def frequent(words: DataFrame) -> Dictionary:
    """The grams above one ``KNOWN``-th of all grams of their length (and above ``RARE``)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, times = count_grams(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], ["length", "gram", "times"])

    counted = stored(words.select("word").mapInArrow(count, "length int, gram long, times long").groupBy("length", "gram").agg(F.sum("times").alias("times")), "grams")
    least = {r.length: max(RARE, r.total // KNOWN) for r in counted.groupBy("length").agg(F.sum("times").alias("total")).collect()}
    keep = F.lit(False)
    for n, t in least.items():
        keep = keep | ((F.col("length") == n) & (F.col("times") > t))
    rows = counted.where(keep).select("gram", "times").toArrow()  # at most KNOWN of each length
    return Dictionary(rows["gram"].to_numpy().view(U64), rows["times"].to_numpy())


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of distinct words that one edit makes equal, once, a < b.

    ``words`` has distinct words (``word``, ``n``). An edit inserts, deletes or replaces one code
    point. Words of fewer than two code points, and nulls, are near nothing.
    """
    words = words.select("word", "n").where(F.char_length("word") >= 2)
    dictionary = words.sparkSession.sparkContext.broadcast(frequent(words))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, keys, long = listed(dictionary.value, batch.column(0).to_pylist())
            at = pa.array(index)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(long)], ["key", "word", "n", "long"])

    lists = words.mapInArrow(enter, "key long, word string, n long, long boolean")
    one, two = lists.where(~F.col("long")).alias("one"), lists.alias("two")
    met = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("two.long") | (F.col("one.word") < F.col("two.word"))))
    near = met.where(F.levenshtein("one.word", "two.word", 1) == 1)
    return near.select(F.least("one.word", "two.word").alias("a"), F.when(F.col("one.word") < F.col("two.word"), F.col("one.n")).otherwise(F.col("two.n")).alias("n_a"),
                       F.greatest("one.word", "two.word").alias("b"), F.when(F.col("one.word") < F.col("two.word"), F.col("two.n")).otherwise(F.col("one.n")).alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to.

    Every round follows each pointer twice as far; as a form is at least twice as frequent as
    its word, no chain has more than 63 steps and six rounds reach its end.
    """
    to = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(to.join(nxt, "root", "left").select("word", "root", "further"), "roots")
        if not step.where("further IS NOT NULL").limit(1).count():
            return step.select("word", "root")
        to = step.select("word", F.coalesce("further", "root").alias("root"))


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """One row per distinct word of ``words`` (``word``, ``n``): word, form, root, n, n_near, form_n.

    ``n_near`` is the number of words one edit away. The form is the most frequent of them (the
    first by code points among equals) where it has at least ``times`` (2 or more) the word's n;
    else null, as is form_n. The root is what forms lead to, the word itself without a form. A
    null word stays, is near nothing and its own (null) root. Words must be distinct; an empty
    table has no rows. Other columns are left out.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    pairs = near_pairs(words)
    # one row per direction out of one run of the join
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("best")),
                             F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("best"))))
    near = pairs.select(ways.alias("way")).select("way.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    joined = words.join(near, "word", "left")
    leads = -F.col("best.less") >= F.lit(times) * F.col("n")
    told = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, runs: Column, alter: Column | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``least`` times.

    ``runs`` is an array of the words of a row (null: none). ``alter``, an expression over the
    column ``run`` and those of ``docs``, changes a word to one of at most its length.
    """
    each = docs.withColumn("run", F.explode(runs)).where(F.char_length("run") >= shortest)
    words = each.select((F.col("run") if alter is None else alter).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
