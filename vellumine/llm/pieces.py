"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The best segmentation of a text is the path of pieces with the largest sum of log scores.
No piece reaches over the start of a run of spaces, nor over a character that only stands
alone in the vocabulary, so the best path of a text is the best paths of its segments between
those places. Each batch finds its distinct segments, and Viterbi runs over all of them at
once: trie walks from every position, then one step per position and piece length. A
character without a piece costs the least score minus 10 and becomes byte pieces.

The vocabulary is read once on the driver and sent to the tasks; its size is that of the
model file, whatever the data. A model of merges has ranks for scores; they become log
scores by Zipf's law, -log(rank + 1) - log(sum of 1/r), since ranks are no log scores.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumine.llm import words as W
from vellumine.llm.common import tidy

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 48  # bytes; longer segments take the path position by position
BLOCK = 1 << 17  # bytes of distinct segments handled at once
SLICE = 1 << 22  # bytes of text, or ids, of the rows handled at once


class DoubleArray:
    """A trie of byte strings: the child of s over byte c is base[s] + c where check is s."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in zip(keys, values, strict=True):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, slot_of, low = bytearray(size), {0: 0}, 1
        used[0] = 1
        todo = [0]
        for node in todo:
            if not children[node]:
                continue
            own = sorted(children[node])
            while used[low]:
                low += 1
            at, tries = max(0, low - own[0]), 0
            while True:
                if at + 256 >= size:
                    grow = size
                    base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                    used.extend(bytes(grow))
                    size += grow
                if at > 0 and not any(used[at + c] for c in own):
                    break
                at, tries = at + 1, tries + 1
            if tries > 32:  # what lies below is nearly full
                low = max(low, at)
            base[slot_of[node]] = at
            for c in own:
                child = children[node][c]
                used[at + c], slot_of[child], check[at + c] = 1, at + c, slot_of[node]
                value[at + c] = ends.get(child, -1)
                todo.append(child)
        pad = 256
        self.base, self.check, self.value = (np.concatenate([x, np.full(pad, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))

    def walk(self, data: np.ndarray, left: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, indices into ``begin``, values) of all keys that start at ``begin``.

        ``left`` has the bytes up to the end of the segment.
        """
        index, state, depth = np.arange(len(begin)), np.zeros(len(begin), np.int32), 0
        while len(index):
            ok = left[index] > depth
            index, state = index[ok], state[ok]
            if not len(index):
                return
            step = self.base[state] + data[begin[index] + depth]
            ok = self.check[step] == state
            index, state, depth = index[ok], step[ok], depth + 1
            found = self.value[state]
            hit = found >= 0
            if hit.any():
                yield depth, index[hit], found[hit]


class Vocabulary:
    """Pieces, log scores and the trie of a model file; spaces stand for the marker."""

    def __init__(self, path: str = MODEL) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.load([(p.piece, p.score, p.type) for p in proto.pieces], ranks=proto.trainer_spec.model_type == pb.TrainerSpec.BPE)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        self.prefix = b" " if spec.add_dummy_prefix else b""

    def load(self, pieces: list[tuple[str, float, int]], ranks: bool) -> None:
        normal, unknown, control, user, unused, byte = 1, 2, 3, 4, 5, 6  # piece types of the format (fixed values)
        self.kinds = np.array([k for _, _, k in pieces])
        plain = [i for i, (_, _, k) in enumerate(pieces) if k in (normal, user)]
        scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        if ranks:  # the k-th best merge has score -k; pieces that no merge makes come last
            order = np.empty(len(plain))
            order[np.argsort(-scores[plain], kind="stable")] = np.arange(1, len(plain) + 1)
            scores = np.zeros(len(pieces))
            scores[plain] = -np.log(order) - np.log((1 / np.arange(1, len(plain) + 1)).sum())
        self.scores = scores
        self.unknown_score = float(scores[plain].min()) - UNKNOWN_PENALTY if plain else -UNKNOWN_PENALTY
        self.bytes = np.full(256, next((i for i, (_, _, k) in enumerate(pieces) if k == unknown), 0), dtype=np.int32)
        text = [b""] * len(pieces)
        for i, (p, _, k) in enumerate(pieces):
            if k == byte:
                self.bytes[int(p[3:5], 16)] = i
                text[i] = bytes([int(p[3:5], 16)])
            elif k in (normal, user, unused):
                text[i] = p.replace(MARK, " ").encode()
        self.trie = DoubleArray([text[i] for i in plain], plain)
        self.alone = np.zeros(256, dtype=bool)  # ASCII bytes that no longer piece holds
        self.alone[:128] = True
        for i in plain:
            if len(text[i]) > 1:
                self.alone[list(set(text[i]))] = False
        self.alone[0x20] = False
        self.lengths = np.array([len(t) for t in text], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(text), dtype=np.uint8)

    # -- encoding

    def segments(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Starts of the segments: row starts, runs of spaces, characters that stand alone."""
        space, alone = data == 0x20, self.alone[data]
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins |= alone
        begins[1:] |= alone[:-1]
        begins[edges[edges < len(data)]] = True
        return np.flatnonzero(begins)

    def best(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over the segments: (ids, first index and number of ids per segment)."""
        size = ends - starts
        first = np.cumsum(size) - size  # the segments, one after the other
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        flat = data[within + np.repeat(starts, size)]
        left = np.repeat(size, size) - within
        begin = np.flatnonzero((flat & 0xC0) != 0x80)  # characters begin here
        width = np.append(begin[1:], len(flat)) - begin
        width = np.minimum(width, left[begin])
        at, length, piece = [], [], []
        single = np.zeros(len(begin), dtype=bool)
        for n, index, found in self.trie.walk(flat, left[begin], begin):
            at.append(begin[index])
            length.append(np.full(len(index), n))
            piece.append(found)
            single[index[width[index] == n]] = True
        lost = ~single
        at.append(begin[lost])
        length.append(width[lost])
        piece.append(np.full(int(lost.sum()), -1, np.int32))
        at, length, piece = np.concatenate(at), np.concatenate(length), np.concatenate(piece)
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        owner = np.repeat(np.arange(len(size)), size)
        node = at + owner[at]  # a segment of n bytes has n + 1 nodes
        count = np.full(len(flat) + len(size), 0, dtype=np.int64)
        total = np.full(len(flat) + len(size), -np.inf)
        back = np.full(len(flat) + len(size), -1, dtype=np.int64)
        total[first + np.arange(len(size))] = 0.0
        grown = np.where(piece >= 0, 1, length)
        offset = within[at]
        short = size[owner[at]] <= LONG
        order = np.flatnonzero(short)
        order = order[np.lexsort((length[order], offset[order]))]
        key = offset[order] * (LONG + 64) + length[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for group in np.split(order, cuts) if len(order) else ():
            a, b = node[group], node[group] + length[group]  # one edge per segment: no two share an end
            reach = total[a] + score[group]
            up = reach > total[b]
            total[b[up]], back[b[up]], count[b[up]] = reach[up], group[up], count[a[up]] + grown[group[up]]
        rest = np.flatnonzero(~short)
        for e in rest[np.lexsort((length[rest], node[rest]))].tolist():
            a, b = node[e], node[e] + length[e]
            if total[a] + score[e] > total[b]:
                total[b], back[b], count[b] = total[a] + score[e], e, count[a] + grown[e]
        last = first + np.arange(len(size)) + size
        number = count[last]
        where = np.cumsum(number) - number
        ids = np.zeros(int(number.sum()), dtype=np.int32)
        cursor, spot = last.copy(), where + number
        live = np.flatnonzero(size > 0)
        while len(live):
            edge = back[cursor[live]]
            spot[live] -= grown[edge]
            known = piece[edge] >= 0
            ids[spot[live[known]]] = piece[edge[known]]
            for e, s in zip(edge[~known].tolist(), spot[live[~known]].tolist(), strict=True):
                ids[s : s + length[e]] = self.bytes[flat[at[e] : at[e] + length[e]]]
            cursor[live] = node[edge]
            live = live[cursor[live] > first[live] + live]
        return ids, where, number

    def encode_column(self, column: pa.Array) -> pa.Array:
        """A list<int32> array of the ids of each text; a null text gives null."""
        data, offsets = W.buffers(column)
        rows = len(offsets) - 1
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = data.tobytes()
        if self.prefix or MARK.encode() in raw:
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [self.prefix + t if t else t for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = self.segments(data, offsets[:-1])
        ends = np.append(starts[1:], len(data))
        hashed, first = [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + W.CHUNK)))
            hashed.append(W.hashes(data, starts[first:last], ends[first:last]))
            first = last
        hashed = np.concatenate(hashed) if hashed else np.zeros(0, W.U64)
        _, rep, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        odd = self.unlike(data, starts, ends, rep[inverse])
        if len(odd):  # another segment under the same hash: each stands for itself
            inverse[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        ids, where, number, base, first = [], [], [], 0, 0
        bulk = np.cumsum(ends[rep] - starts[rep])
        while first < len(rep):
            last = max(first + 1, int(np.searchsorted(bulk, (bulk[first - 1] if first else 0) + BLOCK, side="right")))
            i, w, n = self.best(data, starts[rep[first:last]], ends[rep[first:last]])
            ids.append(i)
            where.append(w + base)
            number.append(n)
            base, first = base + len(i), last
        if not ids:
            ids, where, number = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids, where, number = np.concatenate(ids), np.concatenate(where), np.concatenate(number)
        each = number[inverse]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = np.empty(int(upto[-1]), dtype=np.int32)
        for a in range(0, len(each), 1 << 18):
            n = each[a : a + (1 << 18)]
            local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[upto[a] : upto[a + len(n)]] = ids[local + np.repeat(where[inverse[a : a + (1 << 18)]], n)]
        bounds = upto[np.searchsorted(starts, offsets)]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int32()))
        if not column.null_count:
            return lists
        return pa.array([x if ok else None for x, ok in zip(lists.to_pylist(), column.is_valid().to_pylist(), strict=True)], pa.list_(pa.int32())) if rows else lists

    @staticmethod
    def unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """Segments whose bytes are not those of their representative."""
        size = ends - starts
        bad = [np.flatnonzero(size != size[rep])]
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + W.CHUNK)))
            n = np.minimum(size[first:last], size[rep[first:last]])
            begin = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(begin, n)
            same = data[within + np.repeat(starts[first:last], n)] == data[within + np.repeat(starts[rep[first:last]], n)]
            if not same.all():
                bad.append(first + np.unique(np.searchsorted(begin, np.flatnonzero(~same), side="right") - 1))
            first = last
        return np.unique(np.concatenate(bad))

    # -- decoding

    def decode_column(self, column: pa.Array) -> pa.Array:
        """Texts of the id lists: markers become spaces, byte pieces bytes, the prefix goes.

        Control pieces are silent, bytes that are no UTF-8 become U+FFFD, null stays null.
        """
        valid = column.is_valid().to_pylist()
        out: list[str | None] = []
        for first in range(0, len(column), 512):
            part = column.slice(first, 512)
            counts = np.array([len(x) if x is not None else 0 for x in (part[i].values if part[i].is_valid else None for i in range(len(part)))], dtype=np.int64)
            ids = part.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            n = self.lengths[ids]
            local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            raw = self.data[local + np.repeat(self.starts[ids], n)].tobytes()
            upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
            for i in range(len(part)):
                text = raw[upto[i] : upto[i + 1]]
                out.append(text.removeprefix(self.prefix).decode("utf-8", "replace") if valid[first + i] else None)
        return pa.array(out, pa.string())


def row_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes or ids, one row at least."""
    if pa.types.is_list(column.type):
        upto = column.offsets.to_numpy().astype(np.int64)
    else:
        upto = W.buffers(column)[1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE, side="right")) - 1)
        yield first, last
        first = last


def with_column(df: DataFrame, source: str, name: str, kind: T.DataType, of) -> DataFrame:
    """``df`` with a column made from column ``source``, batch by batch.

    As with ``withColumn``, a column that has the name already is replaced.
    """
    at = df.columns.index(source)
    kept = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of()
        for batch in batches:
            for first, last in row_slices(batch.column(at)):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], make(part.column(at))], [*[batch.schema.names[i] for i in kept], name])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy(run), T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, kind)]))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str | Vocabulary = MODEL) -> DataFrame:
    """``docs`` with the piece ids of each text (array<int>).

    A null text gives null, an empty one no ids. Rows, ties and repeats pass through as they
    are, as does an empty table. A column named ``ids_col`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model) if isinstance(model, str) else model)
    return with_column(docs, text_col, ids_col, T.ArrayType(T.IntegerType()), lambda: sent.value.encode_column)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str | Vocabulary = MODEL) -> DataFrame:
    """``df`` with the text of each id list; null gives null, an empty list an empty text.

    A column named ``text_col`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary(model) if isinstance(model, str) else model)
    return with_column(df, ids_col, text_col, T.StringType(), lambda: sent.value.decode_column)
