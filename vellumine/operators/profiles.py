"""Statistical language signal: character n-gram profiles, trained and scored.

Grams of whole texts are cut in Arrow batches, a code each, and combined there before any
shuffle. Log-probabilities are whole numbers (2^20 to one), so sums have no order: results
are the same for any number of partitions, blocks and languages. A profile is read in
blocks of a bounded size, one after the other; there is one plan for all sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

UNIT = 1 << 20  # of a log-probability
BLOCK_GRAMS = 1 << 20  # profile rows that one block is meant to hold (16 bytes each)
CELLS = 1 << 21  # sums (pages x languages) held at once
KEYED_CHARS = 1 << 19  # characters cut into grams at once (about 110 bytes each), one text at least


def gram_codes(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and text number of every run of ``n`` characters inside a text.

    Up to three characters the code is the run itself (21 bits a character), beyond that a
    64-bit hash of it.
    """
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(np.arange(len(chars)) + n <= np.repeat(ends, sizes))
    codes = np.zeros(len(starts), np.uint64)
    for i in range(n):
        if n <= 3:
            codes = (codes << np.uint64(21)) | chars[starts + i]
        else:
            codes = (codes ^ chars[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
            codes ^= codes >> np.uint64(29)
    return codes.view(np.int64), owner[starts]


def _slices(column: pa.Array, most: int | None = None, rows: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column by runs of rows of at most ``most`` characters (``KEYED_CHARS``) and
    ``rows`` rows, one row at least: number of the first row, and the texts. Only these are unpacked."""
    most = most or KEYED_CHARS
    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > first and (held + size > most or (rows and i - first >= rows)):
            yield first, column.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += size
    if first < len(column):
        yield first, column.slice(first).to_pylist()


def gram_counts(df: DataFrame, keys: Sequence[str], text: str = "text", n: int = 3) -> DataFrame:
    """Overlapping character n-grams of the lower-cased texts per key: (keys, gram, n).

    Each batch gives one row per key and gram; these are combined again before the shuffle.
    """
    keys = list(keys)
    rows = df.select(*keys, F.lower(F.col(text)).alias("_text"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, firsts = _groups(batch, len(keys))
            for a, part in _slices(batch.column(len(keys))):
                codes, owner = gram_codes(part, n)
                if not len(codes):
                    continue
                of = group[a + owner]
                order = np.lexsort((codes, of))
                codes, of = codes[order], of[order]
                at = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])])
                # the gram's letters stand where its first run began
                joined = "".join(t for t in part if t)
                size = np.fromiter((len(t) if t else 0 for t in part), np.int64, len(part))
                begins = np.flatnonzero(np.arange(len(joined)) + n <= np.repeat(np.cumsum(size), size))[order[at]]
                grams = [joined[p : p + n] for p in begins.tolist()]
                kept = pa.array(firsts[of[at]])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(kept) for i in range(len(keys))), pa.array(grams, pa.string()),
                                                  pa.array(np.diff(np.r_[at, len(codes)]))], schema.names)

    return rows.mapInArrow(count, schema).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def _groups(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by the first ``keys`` columns, and a row of each group."""
    group = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        values = batch.column(i).dictionary_encode(null_encoding="encode")
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, group = np.unique(group * (len(values.dictionary) + 1) + codes, return_inverse=True)
    _, firsts = np.unique(group, return_index=True)
    return group, firsts


def train_profiles(labelled: DataFrame, language: str = "lang", text: str = "text", n: int = 3) -> DataFrame:
    """Character n-gram profile per language: (language, gram, gain, floor).

    ``gain`` is the log-probability above the language's unseen-gram floor. Rows without a
    language are left out. The result grows with the alphabet, not with the corpus.
    """
    counts = gram_counts(labelled.withColumnRenamed(language, "language").where("language IS NOT NULL"), ["language"], text, n)
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    floor = F.log(F.lit(0.5) / F.col("total"))
    return counts.join(totals, "language").select(
        "language", "gram", (F.log(F.col("n") / F.col("total")) - floor).alias("gain"), floor.alias("floor"))


class _Block:
    """Some grams of the profiles: sorted codes, and for each its languages and gains."""

    def __init__(self, grams: Sequence[str], language: np.ndarray, gain: np.ndarray, n: int) -> None:
        codes = gram_codes(grams, n)[0]
        order = np.argsort(codes, kind="stable")
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.first = np.r_[self.first, len(codes)]
        self.language, self.gain = language[order], gain[order]

    def sums(self, texts: Sequence[str | None], n: int, languages: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of gains per text and language, and the number of grams of each text."""
        codes, owner = gram_codes(texts, n)
        numbers = np.bincount(owner, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        hit = np.flatnonzero(self.codes[at] == codes) if len(self.codes) else np.zeros(0, np.int64)
        at, owner = at[hit], owner[hit]
        many = self.first[at + 1] - self.first[at]
        entry = np.arange(int(many.sum())) + np.repeat(self.first[at] - (np.cumsum(many) - many), many)
        cell = np.repeat(owner, many) * languages + self.language[entry]
        # whole numbers below 2^53: exact in any order
        return np.bincount(cell, self.gain[entry], len(texts) * languages).astype(np.float64).reshape(len(texts), languages), numbers


def score_profiles(df: DataFrame, key: str, profiles: DataFrame, text: str = "text", n: int = 3, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Most likely language per page: (key, stat_language, stat_probability).

    The profiles are a finished table (train, write or checkpoint, then score). They are cut by
    a hash of the gram into blocks of about ``block_grams`` rows, whose number alone depends on
    the size of the profiles. The pages are read once for each block and summed in the task
    that reads them: what is shuffled is one row of sums per page and block, combined before.
    Rows that share a key are one page. Pages without a gram have no row; of equally likely
    languages the last by name wins. The names of the languages and their floors reach the
    driver.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    told = profiles.where("language IS NOT NULL").groupBy("language").agg(F.first("floor").alias("floor"), F.count(F.lit(1)).alias("n")).orderBy("language").collect()
    spark = df.sparkSession
    if not told:
        return df.select(key, F.lit(None).cast("string").alias("stat_language"), F.lit(None).cast("double").alias("stat_probability")).where("false")
    names = [r.language for r in told]
    floors = np.array([round(r.floor * UNIT) for r in told], np.int64)
    number = {name: i for i, name in enumerate(names)}
    blocks = math.ceil(sum(r.n for r in told) / block_grams)
    gains = profiles.where("language IS NOT NULL").select("language", "gram", F.round(F.col("gain") * UNIT).cast("double").alias("gain"), F.pmod(F.xxhash64("gram"), F.lit(blocks)).alias("block"))
    pages = df.select(key, F.lower(F.col(text)).alias("_text"))
    width, schema = len(names), T.StructType([pages.schema[key], T.StructField("_n", T.LongType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def scorer(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, texts in _slices(batch.column(1), rows=max(1, CELLS // width)):
                    sums, numbers = block.value.sums(texts, n, width)
                    some = np.flatnonzero(numbers)
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + a)), pa.array(numbers[some]),
                                                      pa.ListArray.from_arrays(offsets, pa.array(sums[some].ravel()))], schema.names)
        return run

    parts = []
    for i in range(blocks):
        rows = gains.where(F.col("block") == i).toArrow()  # about block_grams rows
        language = np.fromiter((number[x] for x in rows["language"].to_pylist()), np.int64, rows.num_rows)
        block = spark.sparkContext.broadcast(_Block(rows["gram"].to_pylist(), language, rows["gain"].to_numpy(), n))
        part = pages.mapInArrow(scorer(block), schema)
        parts.append(part if i == 0 else part.withColumn("_n", F.lit(0).cast("long")))  # a page's grams count once
    rows = reduce(DataFrame.unionByName, parts)
    summed = rows.groupBy(key).agg(F.sum("_n").alias("_n"), vector_to_array(Summarizer.sum(_vector("_sums"))).alias("_sums"))
    score = F.transform("_sums", lambda s, i: (s + F.col("_n") * F.get(F.lit(floors.tolist()), i)) / F.lit(float(UNIT)))
    scored = summed.select(key, score.alias("_s")).select(key, "_s", F.array_max("_s").alias("_best"))
    at = F.size("_s") - F.array_position(F.reverse("_s"), F.col("_best"))  # the last of equals
    return scored.select(
        key, F.get(F.lit(names), at.cast("int")).alias("stat_language"),
        (F.lit(1.0) / F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("_best")))).alias("stat_probability"))


def _vector(column: str):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(column))
