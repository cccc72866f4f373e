"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Each node's density is its characters per tag,
weighed down by the share of them in links; a node's density sum adds its children's
densities. The node with the largest sum is the core of the article, and the least density
on the path from the body to it is the threshold by which further nodes join: in each branch
that reaches it, the subtree with the largest sum; an article or main element on that path
is returned whole. Elements that are menu, header, footer or aside by their tag or role are
not counted and not returned. Names (classes, ids) of such parts, and forms, weigh on density;
they are left out like the others unless the core lies in them.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# element names of the HTML standard by the part they play (fixed values)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noframes xmp iframe noembed".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}}
SILENT = set("head script style noscript template svg math iframe object embed canvas audio video select button textarea input nav footer aside menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification newsletter subscribe sidebar sidebars related recommended share sharing social comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs menu nav navbar navigation masthead footer header popup modal overlay pagination pager widget widgets toolbar skip".split())
WHOLE = set("html body main article".split())
BESIDE = set("has with no without is".split())
FORM = "<form>"
WEIGHTS = (0.25, 0.05)  # of a name that mentions a part or a form, and of one that begins with it


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def silent(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether an element and all in it is no main text. ``inside``: within an article."""
    if tag in SILENT or tag == "header" and not inside or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return a.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()))


def named(tag: str, a: dict[str, str], inside: bool) -> dict[str, set[str]]:
    """Classes and ids of an element that name a part besides the main text, with their telling parts."""
    if tag == "form":
        return {FORM: {FORM}}
    if tag in WHOLE and tag != "article" or inside and tag in ("h1", "h2", "h3", "header"):
        return {}
    out = {}
    for word in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", word)
        if tag == "article" and parts[0] not in ("comment", "comments", "reply", "ad", "advert", "sponsored"):
            continue
        said = set(itertools.takewhile(lambda x: x not in BESIDE, parts)) & NAMED  # what follows "with" is another part's name
        if said:
            out[word] = said
    return out


def weight_of(word: str) -> float:
    """Weight of the density under a name: little where it begins with the part, some where it only mentions it."""
    return WEIGHTS[re.split(r"[-_]+", word)[0] in NAMED]


class Page:
    """Elements in page order: parents come before their children."""

    def __init__(self, text: str) -> None:
        self.tag, self.parent, self.mute, self.inside = ["#"], [-1], [False], [False]
        self.named: dict[int, dict[str, set[str]]] = {}
        self.parts: list[tuple[int, str]] = []  # (element, characters)
        stack, at, lowered = [0], 0, None
        end = text.rfind(">") + 1  # after it no tag ends: an open one is dropped
        broken = re.compile("<[a-zA-Z/!?]").search(text, end)
        text = text[: broken.start()] if broken else text
        for m in TOKEN.finditer(text, 0, max(end, 0)):
            if m.start() < at:
                continue
            if m.start() > at:
                self.parts.append((stack[-1], text[at : m.start()]))
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self.parts.append((stack[-1], entities.escape(m[0][9:].removesuffix("]]>"))))
            over, start = m[1], m[2] or m[4]
            if over:
                self.close(stack, over.lower())
            elif start:
                tag, rest = start.lower(), m[3] if m[2] else m[5]
                self.imply(stack, tag)
                node = self.add(tag, stack[-1], rest)
                if tag in VOID:
                    self.parts.append((node, "\n"))
                elif tag in RAW:
                    lowered = text.lower() if lowered is None else lowered
                    stop = lowered.find(f"</{tag}", at) if len(lowered) == len(text) else -1
                    if stop < 0:
                        found = re.compile(f"</{tag}", re.IGNORECASE).search(text, at)
                        stop = found.start() if found else len(text)
                    if tag not in ("script", "style", "title"):
                        self.parts.append((node, text[at:stop]))
                    close = text.find(">", stop)
                    at = len(text) if close < 0 else close + 1
                elif not (rest or "").rstrip().endswith("/") or tag in BLOCK:
                    stack.append(node)
        if at < len(text):
            self.parts.append((stack[-1], text[at:]))

    def add(self, tag: str, parent: int, rest: str | None) -> int:
        inside = self.inside[parent] or tag in ("article", "main")
        self.tag.append(tag)
        self.parent.append(parent)
        self.inside.append(inside)
        a = attributes(rest) if rest and ("=" in rest or "hidden" in rest) else {}
        self.mute.append(self.mute[parent] or silent(tag, a, self.inside[parent]))
        names = {} if self.mute[-1] else named(tag, a, self.inside[parent])
        if names:
            self.named[len(self.tag) - 1] = names
        return len(self.tag) - 1

    def close(self, stack: list[int], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                del stack[i:]
                return

    def imply(self, stack: list[int], tag: str) -> None:
        """End the elements that the start of ``tag`` ends."""
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == "p":
                    del stack[i:]
                    break
                if self.tag[stack[i]] in BLOCK:
                    break
        ends = SAME.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in WALLS[tag]:
                    break
                if self.tag[stack[i]] in ends:
                    del stack[i:]
                    if self.tag[stack[-1]] not in ends:
                        break

    def weigh(self, mute: list[bool], weight: list[float] | None = None) -> tuple[list[int], list[float], list[float], list[int], list[int]]:
        """(characters, densities, density sums, largest sum in each subtree, path from the core to the body)."""
        n = len(self.tag)
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.parts:
            if not mute[node]:
                chars[node] += sum(map(len, text.split()))
        for i in range(n - 1, 0, -1):
            if mute[i]:
                continue
            p = self.parent[i]
            if self.tag[i] == "a":
                linked[i], links[i] = chars[i], links[i] + 1
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            linked[p] += linked[i]
            links[p] += links[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        if not chars[body]:
            body = 0
        share = linked[body] / max(1, chars[body])

        def density(i: int) -> float:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            if not c or mute[i]:
                return 0.0
            base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
            return max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / max(base, 1e-9))

        dense = [density(i) for i in range(n)]
        if weight:
            dense = [d * w for d, w in zip(dense, weight, strict=True)]
        sums, best = [0.0] * n, list(range(n))
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += dense[i]
        for i in range(n - 1, 0, -1):  # best: largest sum in each subtree, the outermost of equals
            p = self.parent[i]
            if sums[best[i]] > sums[best[p]]:
                best[p] = best[i]
        core = best[body]
        path, at = [core], core
        while at not in (body, 0):
            at = self.parent[at]
            path.append(at)
        return chars, dense, sums, best, path

    def muted(self) -> list[bool]:
        """Elements that are not counted: silent ones, and named ones that do not hold the main text.

        A name weighs densities down. The core under these weights lies in no named part:
        names on its path, other elements with the same names, and names under which the
        core has its text are the page's frame and mute nothing.
        """
        if not self.named:
            return self.mute
        n = len(self.tag)
        weight = [1.0] * n
        for i in range(1, n):
            weight[i] = min([weight[self.parent[i]], *map(weight_of, self.named.get(i, ()))])
        path = self.weigh(self.mute, weight)[4]
        frame, at = set(path), path[-1]
        while at > 0:
            at = self.parent[at]
            frame.add(at)
        opened = {w for i in frame for w in self.named.get(i, ())}
        sizes, within = [0] * n, [i == path[0] for i in range(n)]
        for node, text in self.parts:
            sizes[node] += sum(map(len, text.split()))
        for i in range(1, n):
            within[i] = within[i] or within[self.parent[i]]
        while True:
            under: list[frozenset[str]] = [frozenset()] * n  # names around an element that still mute
            held, rest = Counter(), 0
            for i in range(1, n):
                under[i] = under[self.parent[i]]
                if i in self.named and i not in frame:
                    known = set().union(*[said for w, said in self.named[i].items() if w in opened and w != FORM])
                    under[i] = under[i].union(w for w, said in self.named[i].items() if said - known)
            for i in range(n):
                if within[i] and sizes[i] and not self.mute[i]:
                    held.update(dict.fromkeys(under[i], sizes[i]))
                    rest += 0 if under[i] else sizes[i]
            most, word = max(((weight_of(w) * size, w) for w, size in held.items() if w != FORM), default=(0.0, ""))
            if most <= rest:
                return [m or bool(u) for m, u in zip(self.mute, under, strict=True)]
            opened.add(word)

    def chosen(self) -> list[bool]:
        """Elements of the main text."""
        n, mute = len(self.tag), self.muted()
        _, dense, sums, best, path = self.weigh(mute)
        core = path[0]
        least = min((dense[i] for i in path), default=0.0)
        roots = {core}
        for i in path:  # an article holds all of itself
            if self.tag[i] in ("article", "main"):
                roots.add(i)
        taken = [False] * n
        for i in range(n):
            p = self.parent[i]
            taken[i] = p >= 0 and taken[p] or i in roots
            if i not in path and not mute[i] and p >= 0 and not taken[i] and (p in path or taken[p]) and dense[i] >= least > 0 and not sums[best[i]] and self.tag[i] != "a":
                taken[i] = True
            elif p in path and not taken[i] and not mute[i] and dense[i] >= least > 0:
                roots.add(best[i])
                taken[i] = i in roots
        return [t and not m for t, m in zip(taken, mute, strict=True)]

    def text(self) -> str:
        taken = self.chosen()
        block = [0] * len(self.tag)  # nearest block element
        for i in range(1, len(self.tag)):
            block[i] = i if self.tag[i] in BLOCK else block[self.parent[i]]
        out: list[str] = []
        held: list[str] = []
        last = None
        for node, text in self.parts:
            if not taken[node]:
                continue
            if block[node] != last:
                out.append(" ".join("".join(held).split()))
                held, last = [], block[node]
            held.append(entities.unescape(text))
        out.append(" ".join("".join(held).split()))
        return "\n".join(x for x in out if x)


def main_text(page: str | None) -> str:
    """Main text of one page; empty where there is none or the page is null."""
    return Page(page).text() if page else ""


def with_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each row, one block a line.

    Character references are decoded, white space inside a block is one space, nothing else
    is cut. A null or empty page, or one without main text, gives an empty text. Rows, ties
    and repeats pass through one by one; a column named ``text_col`` is replaced.
    """
    at = pages.columns.index(html_col)
    kept = [i for i, c in enumerate(pages.columns) if c.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(texts, pa.string())], [*[batch.schema.names[i] for i in kept], text_col])

    schema = "".join(f"`{pages.schema.fields[i].name}` {pages.schema.fields[i].dataType.simpleString()}, " for i in kept)
    return pages.mapInArrow(run, f"{schema}`{text_col}` string")


def page_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of all pages."""
    out = with_main_text(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), "html", "text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
