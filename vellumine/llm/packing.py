"""Packing by powers of two: documents cut into pieces of binary lengths, in equal buckets.

A document of n ids becomes n // longest pieces of the longest length and, for the rest, one
piece for each bit of its number, the longest first. Every piece is a sequence of its own, so
no sequence crosses documents and none is padded; sequences of one length form a bucket.

Ids come from a byte-level BPE. Its merges never cross from a visible character to white
space, nor from a letter or digit to a mark behind it. Texts are cut there, and the same
word has the same ids everywhere: each worker encodes a word once and gathers ids from there,
within a bound on the bytes it remembers. All this needs one pass over the rows and no shuffle.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = os.environ.get("PACKING_MODEL", "/opt/tokenizers/byte_bpe_50k.json")
LONGEST = 2048
END = 1  # the id that closes a document
KNOWN_BYTES = 96 << 20  # of words and their ids that a worker remembers; then it starts anew
ENTRY_BYTES = 200  # of a remembered word besides its letters and ids
BLOCK = 1 << 16  # words looked up at once
JOINED = 256  # words encoded as one text
WINDOW = 1 << 20  # characters of a text cut at once
#: a plain word before white space or a mark that ends one; else visible characters; else white space
SEGMENT = re.compile(r" ?[A-Za-z0-9À-ÖØ-öø-ÿ]+(?=[ \n\r\t,.;:!?])|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
#: characters besides those four that some library counts as white space
DOUBTFUL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def segments(text: str) -> Iterator[list[str]]:
    """``text`` cut before white space that follows a visible character, and behind plain words."""
    if not DOUBTFUL.search(text):
        if len(text) <= WINDOW:
            yield SEGMENT.findall(text)
            return
        parts = (m.group() for m in SEGMENT.finditer(text))
        while block := list(islice(parts, BLOCK)):
            yield block
        return
    held: list[str] = []
    for m in SEGMENT.finditer(text):
        held.append(m.group())
        if not DOUBTFUL.match(held[-1][-1]):
            yield ["".join(held)]
            held = []
    if held:
        yield ["".join(held)]


class Encoder:
    """Ids of texts; special tokens in a text are ordinary text."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        known = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(known.values()) + 1, np.int64)  # bytes of each id; a character of its name is a byte
        self.widths[list(known.values())] = list(map(len, known))
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.first, self.used, self.bytes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` and remember their ids.

        Words that begin with white space and end with a visible character do not change each
        other's ids, so they are encoded many at once; bytes tell whose an id is.
        """
        alone = [w for w in words if w[0] not in " \n\r\t" or w[-1].isspace() or DOUBTFUL.match(w[-1])]
        words = [*alone, *(set(words).difference(alone) if alone else words)]
        rest = words[len(alone) :]
        runs = ["".join(rest[i : i + JOINED]) for i in range(0, len(rest), JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([*alone, *runs], add_special_tokens=False)]
        fresh = np.fromiter(chain.from_iterable(found), np.int32)
        upto = np.cumsum(self.widths[fresh])
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        last = np.searchsorted(upto, ends) + 1
        have = len(self.slots)
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while have + len(words) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(fresh)] = fresh
        self.first[have + 1 : have + 1 + len(words)] = self.used + last
        self.used += len(fresh)
        self.slots.update(zip(words, range(have, have + len(words)), strict=True))
        self.bytes += 4 * len(fresh) + sum(map(len, words)) + ENTRY_BYTES * len(words)

    def gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` one after the other, and the number of each."""
        if self.bytes > KNOWN_BYTES:
            self.forget()
        new = set(words).difference(self.slots)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        begin, sizes = self.first[at], self.first[at + 1] - self.first[at]
        shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift], sizes

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each closed by ``end``, and their numbers."""
        counts = np.zeros(len(texts), np.int64)
        ids, sizes, block = [], [], []

        def flush() -> None:
            got, size = self.gather(block)
            ids.append(got)
            sizes.append(size)
            block.clear()

        for i, text in enumerate(texts):
            for part in segments(text) if text else ():
                counts[i] += len(part)
                block.extend(part)
                if len(block) >= BLOCK:
                    flush()
        flush()
        ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])
        last = upto[np.cumsum(counts)]
        return np.insert(ids, last, end), np.diff(last, prepend=0) + 1


@lru_cache(maxsize=1)
def encoder_of(model: str) -> Encoder:
    """The worker's encoder; the tasks that a worker runs one after the other share it."""
    return Encoder(model)


def cuts(numbers: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with ``numbers`` ids: (document, start, length), in order.

    ``longest`` is a power of two.
    """
    powers = longest >> np.arange(longest.bit_length())  # longest, ..., 2, 1
    whole = numbers // longest
    has = (numbers[:, None] % longest & powers[None, 1:]) > 0
    many = np.column_stack([whole, has]).astype(np.int64)
    per = many.ravel()
    doc = np.repeat(np.arange(len(numbers)), many.sum(axis=1))
    length = np.repeat(np.tile(powers, len(numbers)), per)
    ends = np.cumsum(length)
    return doc, ends - length - (np.cumsum(numbers) - numbers)[doc], length


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, longest: int = LONGEST, end: int = END, ids_col: str | None = "ids") -> DataFrame:
    """One row per piece: id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is closed by the id ``end``. A null text is empty: a piece that holds
    ``end`` alone. Rows without an id, or that repeat one, are documents of their own. Texts
    of any length are read whole; an empty table has no pieces. Other columns, whatever their
    names, are left out. ``longest`` must be a power of two. ``ids_col`` None leaves the ids
    out. A sequence is one piece and ``offset`` is 0; ``sequence_id`` is unique and ascends with
    the length, then with the place of the row in the table, as ``monotonically_increasing_id``
    does, so reruns over the same files agree.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    with open(model, encoding="utf-8") as f:
        spec = f.read()  # sent to the tasks; its size is that of the file
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    of_id = rows.schema["id"].dataType
    fields = [T.StructField("id", of_id), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    if ids_col:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(spec), TaskContext.get().partitionId()
        done = np.zeros(longest.bit_length(), np.int64)  # sequences of each length so far
        for batch in batches:
            first = 0
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while first < batch.num_rows:
                base = sizes[first - 1] if first else 0
                upto = max(first + 1, int(np.searchsorted(sizes, base + (1 << 22), side="right")))
                part = batch.slice(first, upto - first)
                first = upto
                ids, numbers = encoder.encode(part.column(1).to_pylist(), end)
                doc, start, length = cuts(numbers, longest)
                edges = np.concatenate([[0], np.cumsum(length)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((edges[:-1] * 4).tolist(), (edges[1:] * 4).tolist(), strict=True)), np.int64, len(length))
                bit = np.log2(length).astype(np.int64)
                number = np.zeros(len(length), np.int64)
                for k in np.unique(bit):
                    same = bit == k
                    number[same] = done[k] + np.arange(same.sum())
                    done[k] += same.sum()
                sequence = (bit << 57) | (task << 33) | number
                columns = [part.column(0).take(pa.array(doc)), start, length, crc, numbers[doc], sequence, np.zeros(len(doc), np.int64)]
                if ids_col:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    out = rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("ids", ids_col) if ids_col else out


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder per length, each read as batches without padding."""
    packed.write.partitionBy("length").parquet(path)
