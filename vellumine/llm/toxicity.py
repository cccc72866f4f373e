"""Toxicity with noisy-channel deobfuscation: restore disguised words, then score.

A word that may be disguised (signs or digits among letters, signs alone, repeats, letters
or pairs of them set apart) is decoded: its signs span a lattice of letters they may stand for, repeated and
separating signs may vanish, and Viterbi finds the likeliest letters under a character
4-gram model. A run of fragments is a lattice too, in which every space may vanish or part
two words. Work is linear in the signs: at each one the ``BEAM`` likeliest of the states (the
last three letters) go on, so a reading can only be missed whose beginning has that many
likelier ones. What a task remembers is bounded in bytes. The model's counts cover the whole corpus: each task counts its texts, Spark
adds the counts. They are a table of 28^4 numbers, whatever the corpus.

Scores see the restored words only. Which words and beginnings of words speak for a toxic
text is learned from labelled rows: presence per text is counted by Spark on at most about
``fit_rows`` of them, features whose count differs by chance hardly ever (likelihood ratio)
are kept with their log odds, and a logistic curve over a text's hits is fitted. They come
from the bounded sample, which bounds what goes to the tasks.
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm import words as W
from vellumine.llm.common import give_back, stored, tidy

FIT_ROWS = 8_192
THRESHOLD = 0.7
SURE = 16.0  # likelihood ratio (G squared) a feature must reach
SHORT = 4  # signs of a short word: too few to decide how many letters they stand for
PIECE = 2  # characters of a fragment
BEAM = 64  # states that go on from one sign to the next
REMEMBERED = 8 << 20  # bytes of finished work that each memory of a task holds
PREFIXES = (4, 5, 6, 7)

#: What a sign may stand for (fixed values).
MEANS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ν": "v", "ο": "o", "α": "a",
}
#: Signs set between letters, and signs put over a letter (fixed values).
BETWEEN = set(".-_*~'’`^:;,/\\ ·•=#%&\"")
COVER = set("*#%&_-")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGES = "".join(sorted(BETWEEN | set("()[]{}<>?!\"«»„“”‚‘¿¡|+@$&#%*…")))

# classes of bytes for the model: 0 outside a word, 1-26 letters, 27 other letters
CLASS = np.zeros(256, dtype=np.int64)
CLASS[0x61:0x7B] = np.arange(1, 27)
CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = 27
SIGNS = 28
ORDER = 4


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n): character 4-grams of all texts, once per task."""
    total = np.zeros(SIGNS**ORDER, dtype=np.int64)
    for batch in batches:
        data, offsets = W.buffers(batch.column(0))
        for a in range(int(offsets[0]), int(offsets[-1]), W.CHUNK):
            c = CLASS[data[max(int(offsets[0]), a - ORDER + 1) : min(int(offsets[-1]), a + W.CHUNK)]]
            if len(c) >= ORDER:
                code = ((c[:-3] * SIGNS + c[1:-2]) * SIGNS + c[2:-1]) * SIGNS + c[3:]
                total += np.bincount(code, minlength=len(total))
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(total[gram], pa.int64())], ["gram", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities [context of three][next sign], backing off to shorter contexts."""
    rows = stored(texts.mapInArrow(tidy(gram_counts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams").toArrow()
    c = np.zeros(SIGNS**ORDER)
    c[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    c = c.reshape((SIGNS,) * ORDER)
    p = (c.sum(axis=(0, 1, 2)) + 0.5) / (c.sum() + 0.5 * SIGNS)
    for axes in ((0, 1), (0,), ()):
        n = c.sum(axis=axes) if axes else c
        p = (n + 5.0 * p) / (n.sum(axis=-1, keepdims=True) + 5.0)
    return np.log(p).astype(np.float32)


#: A word of letters none of which is followed by itself: never a disguise.
PLAIN = re.compile(r"(?:([a-zß-öø-ÿ])(?!\1))+")


def disguised(word: str) -> bool:
    """Whether a word without its edge signs may be a disguise: signs among letters, or signs alone.

    Letters alone are one when repeated, from four on; digits alone are a number.
    """
    if PLAIN.fullmatch(word):
        return False
    letters = sum(map(str.isalpha, word))
    if len(word) < 2 or ("@" in word and "." in word.rpartition("@")[2]):
        return False
    if not letters:
        return len(word) > 2 and any(ch in MEANS and not ch.isdigit() for ch in word)
    if letters < len(word) or any(ch in MEANS for ch in word):
        return True
    return len(word) > 3 and (any(a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False)) or sum(a == b for a, b in zip(word, word[1:], strict=False)) * 2 >= len(word) - 1)


class Memory(dict):
    """Finished work by key; forgotten as a whole when it holds more than ``REMEMBERED`` bytes."""

    held = 0

    def keep(self, key, value, size: int) -> None:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size + 250


class Decoder:
    """Viterbi over lattices of signs; the state is the last three letters."""

    def __init__(self, model: np.ndarray) -> None:
        self.p = model.ravel().tolist()  # by state * SIGNS + next sign
        self.seen = Memory()
        self.near = Memory()

    @staticmethod
    def code(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else 27

    def __call__(self, word: str) -> str:
        found = self.seen.get(word)
        if found is None:
            found = self.decode(word)
            self.seen.keep(word, found, 2 * len(word))
        return found

    @staticmethod
    def options(word: str, i: int, run: int) -> list[tuple[str, float]]:
        """(what the sign stands for, log probability); empty for nothing.

        ``run`` is the number of equal signs up to this one.
        """
        ch, out = word[i], []
        if ch.isalpha() and ch not in MEANS:
            out.append((ch, -0.05))
            plain = unicodedata.normalize("NFKD", ch)[0]
            if plain != ch and "a" <= plain <= "z":
                out.append((plain, -3.0))
        for to in MEANS.get(ch, ""):
            out.append((to, -0.7))
        if ch in COVER and 0 < i < len(word) - 1:
            out.extend((to, -4.5) for to in LETTERS)
        if run > 1:  # a repeat: once or twice
            out = [("", -0.3 if run > 2 else -1.5)] + ([(t, w - 1.0) for t, w in out] if run == 2 else [])
        elif not ch.isalnum() or not out:
            out.append(("", -0.5 if ch in BETWEEN else -1.5))
        return out or [("", -3.0)]

    def columns(self, word: str) -> Iterator[list[tuple[str, float]]]:
        run = 0
        for i, ch in enumerate(word):
            run = run + 1 if i and ch == word[i - 1] else 1
            yield self.options(word, i, run)

    def through(self, columns: Iterator[list[tuple[str, float]]], beam: int) -> list[tuple[float, tuple | None]]:
        """(log probability, letters) of the best path to each last state.

        A column has what its sign may stand for, a letter or nothing. Letters are a chain from
        the last to the first.
        """
        p, top = self.p, SIGNS**3
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for column in columns:
            coded = [(to, w, self.code(to) if to else 0) for to, w in column]
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, chain) in states.items():
                for to, w, d in coded:
                    if to == "":
                        key, value, made = state, score + w, chain
                    else:
                        key = state * SIGNS + d
                        key, value, made = key % top, score + w + p[key], (chain, to)
                    old = nxt.get(key)
                    if old is None or value > old[0]:
                        nxt[key] = (value, made)
            states = nxt if len(nxt) <= beam else dict(heapq.nlargest(beam, nxt.items(), key=lambda x: x[1][0]))
        return [(score + p[state * SIGNS], chain) for state, (score, chain) in states.items()]

    @staticmethod
    def letters(chain: tuple | None) -> str:
        out = []
        while chain is not None:
            chain, ch = chain
            out.append(ch)
        return "".join(reversed(out))

    def paths(self, word: str) -> list[tuple[float, str]]:
        """(log probability, letters) of the best path to each last state, none without letters if any has some.

        All states go on: for short words.
        """
        ends = [(score, self.letters(chain)) for score, chain in self.through(self.columns(word), SIGNS**3)]
        return [x for x in ends if x[1]] or ends

    def decode(self, word: str) -> str:
        ends = self.through(self.columns(word), BEAM)
        some = [x for x in ends if x[1] is not None] or ends
        best = max(score for score, _ in some)
        return max(self.letters(chain) for score, chain in some if score == best)

    def nearest(self, word: str) -> list[str]:
        """Of a short word the likeliest form of each length, the likeliest first; else the likeliest."""
        if len(word) > SHORT:
            return [self(word)] if disguised(word) else [word]
        found = self.near.get(word)
        if found is None:
            told: dict[int, str] = {}
            for _, text in sorted(self.paths(word), reverse=True) if disguised(word) else [(0.0, word)]:
                told.setdefault(len(text), text)
            found = list(told.values())
            self.near.keep(word, found, 300)
        return found

    def joins(self, run: list[str]) -> list[tuple[int, int, list[str]]]:
        """(first fragment, end, forms) of the words that the likeliest reading of ``run`` joins.

        A reading's probability is that of its words.
        """
        text, p, top = "".join(run), self.p, SIGNS**3
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # the chain has the fragments that begin words
        at = same = 0
        for k, fragment in enumerate(run):
            if k:
                score, chain = max(((score + p[state * SIGNS], chain) for state, (score, chain) in states.items()), key=lambda x: x[0])
                if score > states.get(0, (-np.inf,))[0]:
                    states[0] = score, (chain, k)
            for ch in fragment:
                same = same + 1 if at and ch == text[at - 1] else 1
                options = [(ch, 0.0)] if ch.isalpha() and ch not in MEANS else self.options(text, at, same)
                at += 1
                nxt: dict[int, tuple[float, tuple | None]] = {}
                for to, w in options:
                    d = self.code(to) if to else -1
                    for state, (score, chain) in states.items():
                        key = state if d < 0 else (state * SIGNS + d) % top
                        value = score + w + (0.0 if d < 0 else p[state * SIGNS + d])
                        old = nxt.get(key)
                        if old is None or value > old[0]:
                            nxt[key] = (value, chain)
                states = nxt if len(nxt) <= BEAM else dict(heapq.nlargest(BEAM, nxt.items(), key=lambda x: x[1][0]))
        _, chain = max(((score + p[state * SIGNS], chain) for state, (score, chain) in states.items()), key=lambda x: x[0])
        cuts = [len(run)]
        while chain is not None:
            chain, k = chain
            cuts.append(k)
        cuts.append(0)
        cuts.reverse()
        return [(i, j, self.nearest("".join(run[i:j]))) for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1]


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) >= n]]


class Reader:
    """Distinct words of a batch, restored, with the place of each word of each text."""

    def __init__(self, model: np.ndarray) -> None:
        self.decoder, self.runs = Decoder(model), Memory()

    def restored(self, raw: bytes) -> list[str]:
        word = raw.decode("utf-8", "replace").lower()
        if PLAIN.fullmatch(word):
            return [word] if len(word) > 1 else []
        bare = word.strip(EDGES)
        out = [bare] if bare else []
        if disguised(bare):
            out.extend(self.decoder.nearest(bare))
        if len(word) != len(bare):
            core = word.strip(".,;:")
            if bare != core and (not bare or len(core) <= len(bare) + 2) and disguised(core):
                out.extend(self.decoder.nearest(core))  # a sign at the edge may be a letter
        return [w for w in dict.fromkeys(out) if len(w) > 1] if len(out) > 1 else out if len(bare) > 1 else []

    def read(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[list[str]], list[tuple[list[str], str]]]]:
        """(row, numbers of its words, restored forms by number, restored spaced-out words)."""
        numbers: dict[int, int] = {}
        forms: list[list[str]] = []
        held = 0
        for row, h, (part, starts, ends) in W.documents(column):
            if held > 4 * REMEMBERED:  # only a memory of finished work
                numbers, forms, held = {}, [], 0
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            own = np.fromiter(map(numbers.get, u.tolist(), itertools.repeat(-1)), np.int64, len(u))
            fresh = np.flatnonzero(own < 0).tolist()
            if fresh:
                low = int(starts[0])
                text = part[low : int(ends[-1])].tobytes()
                begins, upto = starts - low, ends - low
                for k in fresh:
                    own[k] = numbers[int(u[k])] = len(forms)
                    raw = text[begins[first[k]] : upto[first[k]]]
                    forms.append(self.restored(raw))
                    held += 250 + 2 * len(raw)
            yield row, own[inverse], forms, self.spaced(part, starts, ends)

    def spaced(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[list[str], str]]:
        """Words written in fragments of one or two characters with spaces between.

        The likeliest cut of a run of fragments into words says which are joined. Three or
        more single characters in a row are joined in any case. (forms, run): of a joined run
        of single characters every later beginning counts as well.
        """
        if len(starts) < 2:
            return []
        low = int(starts[0])
        size = ends - starts
        if (part[low : int(ends[-1])] & 0x80).any():  # code points, not bytes
            count = np.zeros(int(ends[-1]) - low + 1, dtype=np.int64)
            np.cumsum((part[low : int(ends[-1])] & 0xC0) != 0x80, out=count[1:])
            size = count[ends - low] - count[starts - low]
        short = np.flatnonzero(size <= PIECE)
        if not len(short):
            return []
        cut = np.flatnonzero(np.diff(short) > 1) + 1
        first, last = short[np.r_[0, cut]], short[np.r_[cut - 1, len(short) - 1]]
        out = []
        for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
            out.extend(self.joined(BLANKS.split(part[starts[a] : ends[b]].tobytes().decode("utf-8", "replace").lower())))
        return out

    def joined(self, run: list[str]) -> list[tuple[list[str], str]]:
        if len(run) > SHORT:
            return self.read_run(run)
        key = " ".join(run)
        found = self.runs.get(key)
        if found is None:
            found = self.read_run(run)
            self.runs.keep(key, found, 300)
        return found

    def read_run(self, run: list[str]) -> list[tuple[list[str], str]]:
        out = [[i, j, list(forms), ""] for i, j, forms in self.decoder.joins(run) if sum(map(len, run[i:j])) > 2]
        at = near = 0
        for single, group in itertools.groupby(run, lambda x: len(x) == 1):
            n = len(list(group))
            if single and n >= 3:
                word = "".join(run[at : at + n])
                made = self.decoder(word) if disguised(word) else word
                while near < len(out) and out[near][1] <= at:
                    near += 1
                over = out[near] if near < len(out) and out[near][0] < at + n else None
                if over is None:
                    out.insert(near, [at, at + n, [made], made])
                else:
                    over[2][:0] = [made] if n >= over[1] - over[0] else []
                    over[2].extend([made] if n < over[1] - over[0] else [])
                    over[3] = max(over[3], made, key=len)
            at += n
        return [(forms, tail) for _, _, forms, tail in out]


def presence(sent):
    """Rows (feature, toxic, n): in how many of the task's texts a feature is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        count: dict[tuple[str, int], int] = {}
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for row, own, forms, spaced in reader.read(batch.column(1)):
                present = {f for k in np.unique(own).tolist() for w in forms[k] for f in features(w)}
                present.update(f for group, _ in spaced for f in features(group[0]))
                present.add("")  # counts the texts
                for f in present:
                    count[f, toxic[row]] = count.get((f, toxic[row]), 0) + 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()), pa.array(list(count.values()), pa.int64())], ["feature", "toxic", "n"])
    return run


def hits(sent, weights, at: int | None = None):
    """Rows (..., x1, x2, x3): sum of weights, distinct hits and hits per word of each text.

    The text is column ``at``, which stays; by default it is the last column, which goes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weight = Reader(sent.value), weights.value
        starts = {f[: PREFIXES[0]] for f in weight if f[0] != "="}
        longest = max(map(len, weight), default=0)

        def of(word: str) -> float:
            best = weight.get(f"={word}", 0.0)
            if word[: PREFIXES[0]] in starts:
                best = max(best, *(weight.get(word[:n], 0.0) for n in PREFIXES if n <= len(word)))
            return best

        def within(run: str) -> float:
            """The best of the words that begin inside ``run`` and go to its end."""
            best = 0.0
            for i in range(1, len(run) - 3):
                if run[i : i + PREFIXES[0]] in starts or len(run) - i < longest:
                    best = max(best, of(run[i:]))
            return best

        for batch in batches:
            out = np.zeros((batch.num_rows, 3))
            known: list[float] = []
            last = None
            for row, own, forms, spaced in reader.read(batch.column(batch.num_columns - 1 if at is None else at)):
                if forms is not last:
                    known, last = [], forms
                known.extend(max((of(w) for w in ws), default=0.0) for ws in forms[len(known) :])
                w = np.array([known[k] for k in own.tolist()]) if len(own) else np.zeros(0)
                more = np.array([max(*map(of, group), within(tail)) for group, tail in spaced]) if spaced else np.zeros(0)
                strong = w > 0
                out[row] = w.sum() + more.sum(), len(np.unique(own[strong])) + int((more > 0).sum()), (strong.sum() + (more > 0).sum()) / max(1, len(own))
            kept = batch.num_columns - (at is None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.array(out[:, i]) for i in range(3)]], [*batch.schema.names[:kept], "x1", "x2", "x3"])
            pa.default_memory_pool().release_unused()
    return run


def spread(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.sqrt(x[:, 2]), np.ones(len(x))])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; hits never lower a score."""
    if not len(y) or y.min() == y.max():
        return np.array([0.0, 0.0, 0.0, -4.0 if not len(y) or y.max() == 0 else 4.0])
    z, keep = spread(x), [0, 1, 2, 3]
    while True:
        w = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + np.array([0.5, 0.5, 0.5, 0.01]) * w
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.5, 0.5, 0.5, 0.01])
            step = np.zeros(4)
            step[keep] = np.linalg.solve(hess[np.ix_(keep, keep)], grad[keep])
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        wrong = [i for i in keep if i < 3 and w[i] < 0]
        if not wrong:
            return w
        keep.remove(wrong[0])


class Scorer:
    """A fitted model: sent to the tasks, it turns texts into scores."""

    def __init__(self, grams, weights, curve: np.ndarray) -> None:
        self.grams, self.weights, self.curve = grams, weights, curve


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Scorer:
    """Learn from ``labelled`` (text, toxic) with a character model of all ``docs``.

    The texts used are those whose hash falls under a share that makes about ``fit_rows`` of
    the rows, each once per label; rows with a null label are not used. Without labels of both kinds every text
    gets the same score.
    """
    spark = docs.sparkSession
    text = lambda df: F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    grams = spark.sparkContext.broadcast(language_model(docs.select(text(docs))))
    known = labelled.where(F.col(f"`{toxic_col}`").isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    some = known.select((F.col(f"`{toxic_col}`") > 0).cast("int").alias("toxic"), text(known))
    some = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1).distinct()
    some = stored(some, "labelled").repartition(8, F.xxhash64("text"))
    counts = some.mapInArrow(tidy(presence(grams)), "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    counts = stored(counts.where("t > 0 OR feature = ''"), "features")
    total = counts.where("feature = ''").first()
    t_all, c_all = (total["t"], total["c"]) if total else (0, 0)
    weights: dict[str, float] = {}
    if t_all and c_all:
        t, c = F.col("t"), F.col("c")
        share_t = t_all / (t_all + c_all)
        g2 = 2 * (t * F.log(t / ((t + c) * share_t)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share_t)))).otherwise(0.0))
        odds = F.log((t + 0.5) / (t_all + 1.0)) - F.log((c + 0.5) / (c_all + 1.0))
        kept = counts.where("feature <> ''").select("feature", g2.alias("g2"), odds.alias("w")).where((F.col("g2") >= SURE) & (F.col("w") > 2))
        weights = {r["feature"]: float(r["w"]) for r in kept.collect()}  # features of the sample
    sent = spark.sparkContext.broadcast(weights)
    seen = some.select("toxic", "text").mapInArrow(tidy(hits(grams, sent)), "toxic int, x1 double, x2 double, x3 double").toArrow()
    x = np.column_stack([seen[c].to_numpy() for c in ("x1", "x2", "x3")]) if seen.num_rows else np.zeros((0, 3))
    curve = logistic(x, seen["toxic"].to_numpy().astype(float))
    del seen, x, weights
    give_back()
    return Scorer(grams, sent, curve)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of all ``docs``, 0 to 1; a null text is scored as an empty one.

    Rows pass one by one: ties, repeated rows and null ids get a score each, an empty table
    none.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(hits(scorer.grams, scorer.weights)), f"id {kind}, x1 double, x2 double, x3 double").select(F.col("id").alias(id_col), chance(scorer.curve).alias("score"))


def chance(curve: np.ndarray):
    a, b, c, d = (F.lit(float(w)) for w in curve)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(a * F.log1p("x1") + b * F.log1p("x2") + c * F.sqrt("x3") + d)))


def drop_toxic(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""
    body = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    fields = T.StructType([*body.schema.fields, *[T.StructField(x, T.DoubleType()) for x in ("x1", "x2", "x3")]])
    scored = body.mapInArrow(tidy(hits(scorer.grams, scorer.weights, docs.columns.index(text_col))), fields)
    return scored.where(chance(scorer.curve) < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
