"""N-gram Jaccard join: subsets for small sets, inverted lists for large ones.

A document is the set of its distinct word n-grams. Two sets of a <= b elements are similar
when they share o >= t (a + b) / (1 + t) of them.

* Small sets (both sizes up to the boundary): o elements in common mean a common subset of
  the fixed size c(a), the least o that the smaller size a allows; each set lists its
  subsets of that size for every a it may meet.
* Large sets (one size above the boundary): inverted lists of n-grams. Any similar pair
  shares one of the first b - ceil(t b) + 1 elements under one common order, so only these
  enter the lists. The order puts frequent n-grams last. Which are frequent is counted over
  all documents; as the order alone depends on it, the links found do not.
* The boundary is the size with the least estimated cost, from the histogram of all sizes:
  subsets listed against list entries times the mean length of the lists they scan.

Lists hold classes of equal sets, not copies. Candidates are compared on whole sets, hub
first: every member with a few pivots of its list (first the one that shares most), then, for members that the links so far
have not joined, with all others in the list. Members already in one component need no
comparison, so a group of near copies costs a multiple of its size, not its square, and no
link between components is lost. The components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import components, give_back, stored, tidy

#: Similarity as a ratio of whole numbers: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
N = 5
#: n-grams that make up more than 1 in 2^22 of all are ordered last: at most 2^22 of them.
FREQUENT_BITS = 22
SALTS = 16
PIVOTS = (2, 4)
LARGEST_BOUNDARY = 24


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def smallest_partner(n: int) -> int:
    return ceil_div(NUM * n, DEN)


def shared_at_least(a: int, b: int) -> int:
    """Fewest common elements of similar sets of these sizes."""
    return ceil_div(NUM * (a + b), NUM + DEN)


def prefix_length(n: int) -> int:
    return n - smallest_partner(n) + 1


def subset_sizes(n: int) -> list[tuple[int, int]]:
    """(size of the smaller set, size of the subsets) for each class a set of n joins."""
    return [(a, shared_at_least(a, a)) for a in range(smallest_partner(n), n + 1)]


def subset_count(n: int) -> int:
    return sum(comb(n, c) for _, c in subset_sizes(n))


def ngram_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct n-gram hashes; fewer words than n are one n-gram, none are none."""
    if not len(words):
        return np.zeros(0, dtype=W.U64)
    return np.unique(W.runs(words, min(n, len(words))))


def frequent_candidates(n: int):
    """Per task: n-grams above their share of the task's n-grams, and the task's total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = total = 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(2, size >> FREQUENT_BITS)
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["h", "n"])

        for batch in batches:
            for _, words, _ in W.documents(batch.column(0), lower=True):
                grams = ngram_set(words, n)
                held.append(grams)
                size, total = size + len(grams), total + len(grams)
                if size >= 1 << 22:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["h", "n"])
    return run


def frequent_ngrams(texts: DataFrame, n: int = N) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes (sorted) and ranks of the frequent n-grams, and the mean list length.

    At most 2^22 n-grams can each be over 1 in 2^22 of all, so what comes to the driver and
    goes out with the tasks is under 64 MB at any scale.
    """
    counts = stored(texts.mapInArrow(tidy(frequent_candidates(n)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    total = counts.where("h IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("h").isNotNull() & (F.col("n") >= max(2, total >> FREQUENT_BITS))).toArrow()
    h, c = rows["h"].to_numpy().astype(np.int64).view(W.U64), rows["n"].to_numpy()
    order = np.lexsort((h, c))
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(1, len(h) + 1)
    by_hash = np.argsort(h)
    found = h[by_hash], rank[by_hash], 1 + float((c.astype(float) ** 2).sum()) / max(1, total)
    del rows, h, c, order, rank, by_hash
    give_back()
    return found


def choose_boundary(histogram: dict[int, int], list_length: float) -> int:
    """Largest size handled by subsets: least estimated cost."""
    def cost(x: int) -> float:
        small = sum(k * subset_count(n) for n, k in histogram.items() if n <= x)
        return small + list_length * sum(k * prefix_length(n) for n, k in histogram.items() if n >= smallest_partner(x + 1))
    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def small_keys(grams: np.ndarray) -> list[int]:
    """Hashes of the fixed-size subsets of a small set."""
    out = []
    for a, c in subset_sizes(len(grams)):
        for chosen in combinations(range(len(grams)), c):
            out.append(hashlib.blake2b(grams[list(chosen)].tobytes() + bytes([a]), digest_size=8).digest())
    return np.frombuffer(b"".join(out), dtype=np.int64).tolist()


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the set over as many hash buckets as a power of two at its size or more.

    Sets differ in at least as many elements as their parities differ in buckets. 64 buckets
    are a number.
    """
    buckets = 1 << max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((grams >> W.U64(20)).astype(np.int64) & (buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_difference(a, b) -> int:
    """Lower bound of the number of elements that only one of the two sets has."""
    x, y = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
    while len(x) != len(y):  # halving the buckets adds parities
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def not_ruled_out() -> Column:
    """``least_difference`` within bounds, as a condition on sketch_a, sketch_b, size_a, size_b."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def halved(c: Column) -> Column:
        half = F.floor(F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), xor)

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w))

    a, b = F.col("sketch_a"), F.col("sketch_b")
    most = F.col("size_a") + F.col("size_b") - 2 * F.ceil((F.col("size_a") + F.col("size_b")) * NUM / (NUM + DEN))
    return F.when(F.size(a) == F.size(b), apart(a, b)).when(F.size(a) > F.size(b), apart(halved(a), b)).otherwise(apart(a, halved(b))) <= most


def described(n: int):
    """Rows (id, size, digest, sketch) of the sets; digest and sketch of an empty set are null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for _, words, _ in W.documents(batch.column(1), lower=True):
                grams = ngram_set(words, n)
                sizes.append(len(grams))
                digests.append(set_digest(grams) if len(grams) else None)
                sketches.append(sketch(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["id", "size", "digest", "sketch"])
    return run


def listed(n: int, boundary: int, frequent, with_digest: bool):
    """Rows (key, node, place): list and subset keys of each set; node is its id, or its digest.

    place is the key's place in the common order of the set, 0 for subsets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, ranks = frequent.value
        for batch in batches:
            ids = batch.column(0)
            keys, rows, places = [], [], []
            for row, words, _ in W.documents(batch.column(1), lower=True):
                grams = ngram_set(words, n)
                size = len(grams)
                if not size or not ids[row].is_valid:
                    continue
                own, place = [], []
                if size >= smallest_partner(boundary + 1):
                    at = np.searchsorted(heavy, grams)
                    at[at == len(heavy)] = 0
                    rank = np.where(heavy[at] == grams, ranks[at], 0) if len(heavy) else np.zeros(size, dtype=np.int64)
                    first = np.argsort(rank, kind="stable")[: prefix_length(size)]
                    own.append(grams[first].view(np.int64))
                    place.append(np.arange(len(first)))
                if size <= boundary:
                    own.append(np.array(small_keys(grams), dtype=np.int64))
                    place.append(np.zeros(len(own[-1]), dtype=np.int64))
                own = np.concatenate(own)
                keys.append(own)
                places.append(np.concatenate(place))
                mark = int.from_bytes(set_digest(grams)[:8], "little", signed=True) if with_digest else row
                rows.append(np.full(len(own), mark, dtype=np.int64))
                if len(keys) >= 512:
                    yield out(keys, rows, places, ids)
                    keys, rows, places = [], [], []
            if keys:
                yield out(keys, rows, places, ids)

    def out(keys, rows, places, ids):
        node = pa.array(np.concatenate(rows))
        if with_digest:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node], ["key", "node"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), ids.take(node), pa.array(np.concatenate(places))], ["key", "node", "place"])
    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, body): the text compressed, as it is moved for the comparisons only."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = W.buffers(batch.column(1))
        for a, b in W.chunks(offsets):
            body = [press.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], ["id", "body"])


def compared(n: int):
    """Rows (a, b) of the pairs whose whole sets are similar; equal b stand together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def grams(body: bytes) -> np.ndarray:
            text = pa.array([press.decompress(body)], pa.binary())
            return ngram_set(next(W.documents(text, lower=True))[1], n)

        last, held = None, None
        for batch in batches:
            keep = []
            bodies_a, bodies_b = batch.column(2), batch.column(3)
            for row in range(batch.num_rows):
                body = bodies_b[row].as_py()
                if body != last:
                    last, held = body, grams(body)
                mine = grams(bodies_a[row].as_py())
                both = len(np.intersect1d(mine, held, assume_unique=True))
                if both and DEN * both >= NUM * (len(mine) + len(held) - both):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])
    return run


def close_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches do not rule out that the sets are similar."""
    for batch in batches:
        _, _, size_a, size_b, one, other = (c.to_pylist() for c in batch.columns)
        keep = [i for i, (m, n, x, y) in enumerate(zip(size_a, size_b, one, other, strict=True)) if least_difference(x, y) <= m + n - 2 * shared_at_least(m, n)]
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"])


def similar(pairs: DataFrame, sketches: DataFrame, bodies: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) that are similar, as edges (u, v): by sketches, then by whole sets."""
    def beside(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        of = lambda c: right.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]).hint("merge")
        return left.join(of("a"), "a").join(of("b"), "b").select("a", "b", *[f"{x}_{c}" for x in columns for c in "ab"])

    near = stored(beside(pairs, sketches, "size", "sketch").mapInArrow(tidy(close_enough), "a long, b long"), "near").distinct()
    return stored(beside(near, bodies, "body").mapInArrow(tidy(compared(n)), "u long, v long"), "links")


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id.

    component_id is the smallest id reachable over links. Texts are lower-cased (A-Z) and
    split at ASCII white space; fewer than n words are one n-gram. Null, empty and blank
    texts have no n-grams and no links; a row without links is its own component. Rows with
    a null id get a null component_id and take no part in links. Rows that repeat an id are
    one document: it is linked by any of its texts. An empty table gives no rows. n-grams
    are compared as 64-bit hashes. Ids are whole numbers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    light = stored(texts.mapInArrow(tidy(described(n)), "id long, size long, digest binary, sketch array<long>"), "sets")
    heavy, ranks, length = frequent_ngrams(texts.select("text"), n)
    histogram = {r["size"]: r["k"] for r in light.where("size > 0").groupBy(F.least("size", F.lit(4 * LARGEST_BOUNDARY)).alias("size")).agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(histogram, length)
    frequent = spark.sparkContext.broadcast((heavy, ranks))
    del heavy, ranks
    give_back()

    # classes of equal sets: the smallest id stands for the others; salted both ways
    own = light.where("digest IS NOT NULL AND id IS NOT NULL").select("id", "size", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    part = own.groupBy("digest", "salt").agg(F.min("id").alias("node"))
    whole = part.groupBy("digest").agg(F.min("node").alias("node"), F.collect_set("salt").alias("salts"))
    classes = whole.select("digest", "node", F.explode("salts").alias("salt"))
    named = stored(own.join(classes, ["digest", "salt"]).select("id", "size", "node"), "classes")

    # keys that two different sets share, then the lists of those keys
    marks = texts.mapInArrow(tidy(listed(n, boundary, frequent, True)), "key long, node long")
    shared = stored(marks.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "keys")
    entries = texts.mapInArrow(tidy(listed(n, boundary, frequent, False)), "key long, node long, place long").select("key", F.col("node").alias("id"), "place")
    lists = stored(entries.join(shared.hint("merge"), "key").join(named, "id").select("key", "node", "size", "place").distinct(), "lists")

    # a set whose list keys are mostly shared is the middle of its copies: it is a pivot first
    degree = lists.groupBy("node").agg((F.count(F.lit(1)) / (F.max("size") * (DEN - NUM) / DEN + 1)).alias("shared"))
    lists = stored(lists.join(stored(degree, "degree").hint("merge"), "node"), "lists")

    wanted = lists.select(F.col("node").alias("id")).distinct()
    bodies = stored(texts.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(tidy(packed), "id long, body binary").join(wanted.hint("merge"), "id").distinct(), "bodies")
    sketches = stored(light.where("digest IS NOT NULL").select("id", "size", "sketch").join(wanted.hint("merge"), "id").distinct(), "sketches")
    # similar sets have this many elements from their first common key on
    need = F.ceil((F.col("size_a") + F.col("size_b")) * NUM / (NUM + DEN))
    near = (F.col("size_a") - F.col("place_a") >= need) & (F.col("size_b") - F.col("place_b") >= need)
    links = spark.createDataFrame([], "u long, v long")
    open_lists = lists.withColumn("component", F.col("node"))
    for turn, pivots in enumerate(PIVOTS):
        rank = lambda p: (-F.col("shared") if turn == p == 0 else F.lit(0.0)).alias("first")  # noqa: B023, E731
        hub = lambda p: F.struct(rank(p), F.xxhash64("node", F.lit(100 * turn + p)).alias("hash"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("component").alias("c"))
        ends = open_lists.groupBy("key").agg(*[F.min(hub(p)).alias(f"p{p}") for p in range(pivots)], F.max(hub(0)).alias("last"), F.count(F.lit(1)).alias("k"))
        ends = stored(ends, "hubs")
        # a list of two is a pair; longer ones are compared with their pivots
        sides = [F.col(f"p0.{x}").alias(y) for x, y in (("b", "a"), ("size_b", "size_a"), ("place_b", "place_a"), ("c", "component"))]
        couples = ends.where("k = 2").select(*sides, *[F.col(f"last.{x}").alias(x) for x in ("b", "size_b", "place_b", "c")])
        hubs = ends.where("k > 2").select("key", F.explode(F.array(*[F.struct(*[F.col(f"p{p}.{x}").alias(x) for x in ("b", "size_b", "place_b", "c")]) for p in range(pivots)])).alias("p")).select("key", "p.*").distinct()
        met = open_lists.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), "component").join(hubs.hint("merge"), "key").drop("key")
        pairs = met.unionByName(couples).where((F.col("component") != F.col("c")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.unionByName(similar(stored(pairs, "pairs"), sketches, bodies, n))
        groups = components(links).select("node", "component")
        joined = lists.join(groups.hint("merge"), "node", "left").select("key", "node", "size", "place", "shared", F.coalesce("component", "node").alias("component"))
        mixed = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        open_lists = stored(joined.join(stored(mixed, "mixed").hint("merge"), "key"), "open")

    # what is still apart: members outside their list's largest component against all of it
    counts = open_lists.groupBy("key", "component").agg(F.count("*").alias("k"))
    major = stored(counts.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major")), "major")
    parities = sketches.groupBy(F.col("id").alias("node")).agg(F.first("sketch").alias("sketch"), (F.count(F.lit(1)) == 1).alias("single"))
    tagged = open_lists.join(major.hint("merge"), "key").join(stored(parities, "parities").hint("merge"), "node")
    tagged = stored(tagged, "tagged")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("size", "place", "sketch", "single")]
    apart = tagged.where("component <> major").select("key", F.col("node").alias("a"), F.col("component").alias("c"), *side("a"))
    rest = apart.join(tagged.select("key", F.col("node").alias("b"), "component", *side("b")).hint("merge"), "key")
    one_text = F.col("single_a") & F.col("single_b")  # an id with several texts has several sketches
    rest = rest.where((F.col("c") != F.col("component")) & near & (~one_text | not_ruled_out())).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(similar(stored(rest, "pairs"), sketches, bodies, n))
    groups = components(links).select("node", "component")
    ids = named.join(groups.hint("merge"), "node", "left").select("id", F.coalesce("component", "node").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    out = light.select("id", "size").join(stored(ids, "ids").hint("merge"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest (and rows with a null id)."""
    groups = ngram_groups(docs, id_col, text_col, n).where(F.col(id_col) != F.col("component_id"))
    gone = stored(groups.select(F.col(id_col).alias("gone_id")).distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[f"`{id_col}`"] == gone["gone_id"], "left_anti")
