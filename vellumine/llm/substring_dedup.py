"""Substring dedup: words of windows that an earlier document holds too are removed.

A difference cover D of a period v has, for every shift between two documents, a position
that lies in D (mod v) in both. So two equal windows of w words share an anchor, a run of
w - v + 1 words that begins at a cover position in either document, whatever their shift.
Only anchors enter the first shuffle: for w = 50 a fifth of all positions. An anchor found in
two documents is extended: the whole windows around it are hashed (128 bits) and grouped,
and a window goes where a smaller id holds it. Groups are minima, combined before each
shuffle; no pairs of documents are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import stored

WINDOW = 50
#: Perfect difference sets by period: every shift is a difference of two members (fixed values).
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def period_of(window: int) -> int:
    """Largest period that leaves an anchor of a third of the window or more (1 at least)."""
    return max((v for v in COVERS if window - v + 1 >= max(1, window // 3)), default=3)


class Layout:
    """Cover positions, anchors and windows of one window length."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.period = period_of(window)
        self.anchor = window - self.period + 1
        if self.anchor < 1:
            raise ValueError(f"windows of {window} words are too short; 3 is the least")
        self.marked = np.zeros(self.period, dtype=bool)
        self.marked[list(COVERS[self.period])] = True
        # window = overlapping anchors: starts 0, anchor, 2 * anchor, ... and the last one
        self.steps = sorted({*range(0, self.period, self.anchor), self.period - 1})

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of one document."""
        if len(words) < self.window:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=W.U64)
        h = W.runs(words, self.anchor)
        at = np.flatnonzero(np.resize(self.marked, len(h)))
        return at, h[at]

    def windows(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of the windows that hold an anchor beginning at ``at``."""
        n = len(words) - self.window + 1
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(0, at - self.period + 1), 1)
        np.add.at(edge, np.minimum(n, at + 1), -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        out = []
        for kind in (0, 1):
            h = W.runs(words, self.anchor, kind)
            by = W.PLACES[kind].upto(len(self.steps) + 1)
            out.append(W.mixed(sum((h[starts + s] * by[i + 1] for i, s in enumerate(self.steps)), np.zeros(len(starts), dtype=W.U64))))
        return starts, out[0], out[1]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def anchored(window: int):
    """Rows (h, id), an anchor hash once per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(window)
        for batch in batches:
            ids, held, rows = batch.column(0), [], []
            for row, words, _ in W.documents(batch.column(1)):
                h = np.unique(layout.anchors(words)[1])
                held.append(h)
                rows.append(np.full(len(h), row, dtype=np.int64))
                if len(held) == 1024:
                    yield pa.RecordBatch.from_arrays([signed(np.concatenate(held)), ids.take(pa.array(np.concatenate(rows)))], ["h", "id"])
                    held, rows = [], []
            if held:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(held)), ids.take(pa.array(np.concatenate(rows)))], ["h", "id"])
    return run


def packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, k, body): the words, joined by one space and compressed, and their hash."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = W.buffers(batch.column(1))
        for a, b in W.chunks(offsets):
            plain = [b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()) for i in range(a, b)]
            k = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(k, pa.int64()), pa.array([press.compress(x) for x in plain], pa.binary())], ["id", "k", "body"])


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_words, sha) of the texts as they are: no word removed."""
    for batch in batches:
        data, offsets = W.buffers(batch.column(1))
        counts, digests = [], []
        for i in range(batch.num_rows):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["id", "n_words", "sha"])


def extended(window: int):
    """Rows (h1, h2, id, k, start) of the windows around shared anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, press = Layout(window), zstandard.ZstdDecompressor()
        for batch in batches:
            ids, keys, bodies, anchors = batch.columns
            for row in range(batch.num_rows):
                text = press.decompress(bodies[row].as_py())
                words = next(W.documents(pa.array([text], pa.binary())))[1]
                at, h = layout.anchors(words)
                known = anchors[row].values.to_numpy(zero_copy_only=False).view(W.U64)
                starts, h1, h2 = layout.windows(words, at[np.isin(h, known)]) if len(at) else ((), h, h)
                if len(starts):
                    yield pa.RecordBatch.from_arrays([signed(h1), signed(h2), ids.take(where := pa.array(np.full(len(starts), row))), keys.take(where), pa.array(starts, pa.int64())], ["h1", "h2", "id", "k", "start"])
    return run


def cut(window: int):
    """Rows (id, sha, n_removed, kept_sha, kept) of the documents that lose words.

    ``sha`` names the untouched words: with the id it finds the row again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                body = press.decompress(batch.column(1)[i].as_py())
                words = body.split()
                starts = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
                out.append((hashlib.sha256(body).hexdigest(), int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            a, b, c, d = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string())], ["id", "sha", "n_removed", "kept_sha", "kept"])
    return run


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(all rows: id, n_words, sha), (rows that lose words: id, sha, n_removed, kept_sha, kept)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    named = texts.where("id IS NOT NULL")
    anchors = named.mapInArrow(anchored(window), "h long, id long")
    shared = stored(anchors.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h"), "anchors")
    own = anchors.join(shared.hint("merge"), "h").groupBy("id").agg(F.collect_list("h").alias("known"))
    bodies = stored(named.mapInArrow(packed_words, "id long, k long, body binary").join(stored(own, "known").hint("merge"), "id"), "bodies")
    windows = bodies.select("id", "k", "body", "known").mapInArrow(extended(window), "h1 long, h2 long, id long, k long, start long")
    first = stored(windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "windows")
    gone = windows.join(first.hint("merge"), ["h1", "h2"]).where("id > lo").groupBy("id", "k").agg(F.collect_set("start").alias("starts"))
    lost = bodies.select("id", "k", "body").distinct().join(stored(gone, "starts").hint("merge"), ["id", "k"]).select("id", "body", "starts")
    return texts.mapInArrow(whole_rows, "id long, n_words long, sha string"), lost.mapInArrow(cut(window), "id long, sha string, n_removed long, kept_sha string, kept string")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_removed, kept_sha256 and kept_text.

    kept_text is null where no word goes (the text stays as it is). A word goes when a window
    of ``window`` words over it begins in a document with a smaller id too; windows are
    judged on the input. A null text has no words. Rows with a null id neither lose words nor
    take any. Rows that repeat an id are judged each on its own text. An empty table gives
    no rows.
    """
    whole, lost = shortened(docs, id_col, text_col, window)
    out = whole.join(stored(lost, "lost").hint("merge"), ["id", "sha"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.col("kept").alias("kept_text"))
