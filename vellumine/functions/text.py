"""Text expressions: tokens, character classes, normal form, word counts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from vellumine.functions import fixed

# What counts as white space (the ASCII-only ``\s`` of Java is too
# narrow), what separates words, and what a script census skips: white space, digits,
# punctuation and symbols. Superscript one, two and three are digits; fractions are
# not. These spellings are understood by every regular-expression engine.
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SKIPPED = r"[" + SPACE + r"\p{P}\p{S}\p{Nd}\p{Z}\x{b2}\x{b3}\x{b9}]+"
PORTABLE_SEPARATORS = r"[" + SPACE + r"।॥,.!?;:\-—–\x{200c}\x{200d}]+"
PORTABLE_GAP = r"[" + SPACE + r"]+"
# The same classes for the JVM: members above Latin-1 sit behind one range test, so a
# letter is rejected by two comparisons instead of fifteen.
_LOW = r"\t-\r\x1c-\x20\x{85}\x{a0}"
_HIGH = r"[\x{964}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}%s]]"
SEPARATORS = "[" + _LOW + r",.!?;:\-" + _HIGH % r"\x{964}\x{965}\x{2013}\x{2014}\x{200c}\x{200d}" + "]+"
WORD_GAP = "[" + _LOW + _HIGH % "" + "]+"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def char_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in ranges) + "]"


def tokens(text: Column, separators: str = SEPARATORS) -> Column:
    """Words between separators, blanks dropped (array of strings)."""
    return F.array_remove(F.split(text, separators), "")


def plain_words(text: Column) -> Column:
    """Words between white space, as ``str.split()`` gives them."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(plain_words(text)), F.lit(0))


def char_count(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"[^{SPACE}]")


# Every code point below U+0300 is in normal form and takes nothing from what stands before it.
# What may change is a run of higher ones with the character before the run.
UNSETTLED = r"[^\x{00}-\x{2FF}]+"
NFC_RUNS = 1 << 16  # runs normalised at once


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfc_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The runs of each text in normal form; null where every run of a text is already."""
    for runs in batches:
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes)
        first = 0
        while first < len(runs):  # a bounded number of runs at once, one text at least
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + NFC_RUNS, side="right")))
            some = runs.slice(first, last - first).to_pylist()
            done = [x if x is None else [unicodedata.normalize("NFC", r) for r in x] for x in some]
            yield pa.array([None if x == y else y for x, y in zip(some, done)], pa.list_(pa.string()))
            first = last


def nfc(text: Column) -> Column:
    """Unicode NFC.

    Only runs of code points from U+0300 on, each with the character before it, cross to Python,
    and only runs of texts that change come back; the rest of a text stays where it is.
    """
    gaps = F.split(text, UNSETTLED, -1)
    runs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(UNSETTLED), F.lit(0)), lambda gap, run: F.concat(F.right(gap, F.lit(1)), run))
    changed = _nfc_runs(F.when(text.rlike(UNSETTLED), F.array_compact(runs)))
    whole = F.zip_with(gaps, changed, lambda gap, run: F.when(run.isNull(), gap).otherwise(F.concat(F.left(gap, F.char_length(gap) - 1), run)))
    return F.when(changed.isNull(), text).otherwise(F.array_join(whole, ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two token arrays (0 when both are empty)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def abbreviate(digest: Column, head: int = 8, tail: int = 8) -> Column:
    """``head`` characters, an ellipsis and the last ``tail`` once longer than 16."""
    short = F.concat(F.substring(digest, 1, head), F.lit("..."), F.right(digest, F.lit(tail)))
    return F.when(F.char_length(digest) > 16, short).otherwise(digest)


def contains_any(query: str, *columns: Column) -> Column:
    """Case-insensitive substring test over several columns; a blank query keeps all."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c.cast("string")).contains(needle), F.lit(False))
    return hit


def script_pattern(script: str) -> str:
    return char_class(fixed.SCRIPT_BLOCKS[script])


@cache
def counted_ranges(script: str) -> tuple[tuple[int, int], ...]:
    """Code points of a script that a census counts, as ranges.

    Skips white space, digits, punctuation and symbols. Spelled-out ranges are tested
    by the regular-expression engine several times faster than category classes.
    """
    out: list[list[int]] = []
    for low, high in fixed.SCRIPT_BLOCKS[script]:
        for cp in range(low, high + 1):
            ch = chr(cp)
            if ch.isspace() or ch.isdigit() or unicodedata.category(ch)[0] in "PS":
                continue
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return tuple((a, b) for a, b in out)


def counted_class(script: str) -> str:
    return char_class(list(counted_ranges(script)))
