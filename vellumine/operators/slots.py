"""Slots for user-supplied recognisers and analyses.

A slot is a function over an iterator of pandas batches: it can load its model once per
task and then stream rows. None ships with the library.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.functions import fixed

Batches = Iterator[pd.DataFrame]
BATCH_BYTES = 4 << 20  # content in one batch that an engine gets; a larger page is a batch of its own
RECOGNITION_DDL = ("page_key string, text string, confidence double, word_confidences array<double>, "
                   "engine string, lang_code string, error string")


@dataclass(frozen=True)
class Recogniser:
    """A text recogniser: its languages and ``recognise(batches) -> batches``.

    Input batches have ``page_key``, ``content`` and ``lang_code``; output batches
    follow ``RECOGNITION_DDL`` without ``engine``. Confidence is 0-100.
    """

    name: str
    recognise: Callable[[Batches], Batches]
    languages: Mapping[str, str]
    version: str = "Unknown"
    available: bool = True
    fallbacks: Mapping[str, str] = field(default_factory=dict)

    def status(self) -> str:
        if not self.available:
            return f"{self.name} — not installed or not available"
        return f"{self.name} v{self.version} — {len(self.languages)} languages available"


def _serves(engine: Recogniser, language: Column) -> Column:
    known = [*engine.languages, *engine.fallbacks]
    return language.isin(known or [""])


def assign_engine(pages: DataFrame, engines: Sequence[Recogniser], language: str = "language") -> DataFrame:
    """First capable engine of each page, the first available one when none is capable.

    Adds ``engine`` and ``lang_code``.
    """
    usable = [e for e in engines if e.available]
    lang = F.col(language)
    engine, code = F.lit(usable[0].name if usable else None).cast("string"), F.lit("").cast("string")
    for e in reversed(usable):
        codes = {**dict(e.fallbacks), **dict(e.languages)}
        mapped = F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), lang) if codes else F.lit("")
        engine = F.when(_serves(e, lang), e.name).otherwise(engine)
        code = F.when(_serves(e, lang), mapped).otherwise(code)
    return pages.withColumns({"engine": engine, "lang_code": code})


FIELDS = ["page_key", "text", "confidence", "word_confidences", "engine", "lang_code", "error"]


def _failed(pages: pd.DataFrame, engine: Recogniser, problem: Exception) -> pd.DataFrame:
    return pd.DataFrame({
        "page_key": pages["page_key"], "text": "", "confidence": 0.0, "word_confidences": [[] for _ in range(len(pages))],
        "engine": engine.name, "lang_code": pages["lang_code"], "error": f"{engine.name} error: {problem}"})[FIELDS]


def _whole(out: pd.DataFrame, engine: Recogniser) -> pd.DataFrame:
    out = out.assign(engine=engine.name)
    for column in ("error", "lang_code"):
        if column not in out:
            out[column] = ""
    return out[FIELDS]


class _Owed:
    """Pages that an engine has taken and not returned, by key, in the order taken.

    A page is its batch and its place there; it is cut out only if the engine leaves it behind.
    """

    def __init__(self) -> None:
        self.pages: dict[object, deque[tuple[pd.DataFrame, int]]] = {}
        self.taken = 0

    def take(self, batch: pd.DataFrame) -> None:
        self.taken += len(batch)
        for at, key in enumerate(batch["page_key"].tolist()):
            self.pages.setdefault(key, deque()).append((batch, at))

    def settle(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows that answer an owed page; each page is answered once."""
        answers = []
        for key in rows["page_key"].tolist():
            waiting = self.pages.get(key)
            answers.append(waiting is not None)
            if waiting is not None:
                waiting.popleft()
                if not waiting:
                    del self.pages[key]
        return rows[answers]

    def drain(self) -> list[pd.DataFrame]:
        left, self.pages = [batch.iloc[at : at + 1] for waiting in self.pages.values() for batch, at in waiting], {}
        return left


def _run_engine(engine: Recogniser, batches: Batches) -> Batches:
    """Exactly one row per page of ``batches``. The engine gets the iterator as a whole.

    When it raises or stops early, the pages it had taken and not returned are given to it one
    by one, so only pages that fail by themselves become error rows; then it goes on with the
    rest. An attempt that takes no page shows an engine that cannot start: all pages left become
    error rows and it is not called again. Rows for pages it was not given are dropped.
    """
    owed, over = _Owed(), False

    def feed() -> Batches:
        nonlocal over
        for batch in batches:
            owed.take(batch)
            yield batch
        over = True

    while not over:
        before = owed.taken
        try:
            for out in engine.recognise(feed()):
                rows = owed.settle(_whole(out, engine))
                if len(rows):
                    yield rows
            problem: Exception = ValueError("no result")
        except Exception as raised:  # noqa: BLE001 - reported as data
            problem = raised
        for page in owed.drain():
            yield _alone(engine, page, problem)
        if owed.taken == before:
            for batch in batches:
                yield _failed(batch, engine, problem)
            return


def _alone(engine: Recogniser, page: pd.DataFrame, problem: Exception) -> pd.DataFrame:
    """The row of one page that the engine left behind; ``problem`` where it returns none."""
    try:
        one = _Owed()
        one.take(page)
        found = [one.settle(_whole(out, engine)) for out in engine.recognise(iter([page]))]
        rows = pd.concat(found) if found else None
        return rows if rows is not None and len(rows) == 1 else _failed(page, engine, problem)
    except Exception as raised:  # noqa: BLE001 - reported as data
        return _failed(page, engine, raised)


def recognise(pages: DataFrame, engines: Sequence[Recogniser]) -> DataFrame:
    """Run each page through its assigned engine: exactly one row per page, one scan.

    Pages are sorted by engine inside each task, and every engine gets all its pages of the
    task as one iterator, so a model is loaded once per task. Its batches hold at most about
    ``BATCH_BYTES`` of content, one page at least. A failing page becomes an error row; pages
    without any engine get an error instead of text.
    """
    known = {e.name: e for e in engines if e.available}

    def run(batches: Batches) -> Batches:
        pieces = ((name, part) for batch in batches for name, part in batch.groupby(batch["engine"].fillna(""), sort=True))
        for name, group in itertools.groupby(pieces, key=lambda p: p[0]):
            parts = (part[["page_key", "content", "lang_code"]] for _, part in group)
            if name in known:
                yield from _run_engine(known[name], parts)
                continue
            for part in parts:
                yield pd.DataFrame({
                    "page_key": part["page_key"], "text": "", "confidence": 0.0, "word_confidences": [[] for _ in range(len(part))],
                    "engine": "None", "lang_code": "", "error": "No OCR engines available."})[FIELDS]

    rows = pages.select("page_key", "content", "lang_code", "engine").sortWithinPartitions("engine")
    schema = to_arrow_schema(T.StructType.fromDDL(RECOGNITION_DDL))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(part.to_pandas() for batch in batches for part in bounded(batch)):
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return rows.mapInArrow(arrow, RECOGNITION_DDL)


def bounded(batch: pa.RecordBatch, column: str = "content") -> Iterator[pa.RecordBatch]:
    """A batch by runs of rows with at most ``BATCH_BYTES`` in a column, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BATCH_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


@dataclass(frozen=True)
class Analysis:
    """An analysis module; ``run`` is None while its engine is not connected.

    ``run(batches)`` takes evidence batches and yields ``evidence_id``, ``confidence``
    and ``evidence_strength``.
    """

    module: str
    run: Callable[[Batches], Batches] | None = None

    @property
    def connected(self) -> bool:
        return self.run is not None


def run_analyses(evidence: DataFrame, modules: Sequence[Analysis]) -> DataFrame:
    """Results of the connected modules: (evidence_id, module, status, confidence, evidence_strength).

    Unconnected modules contribute nothing here, so the fusion matrix shows them pending.
    """
    ddl = "evidence_id string, confidence double, evidence_strength string"
    out = None
    for m in modules:
        if m.run is None:
            continue
        one = evidence.mapInPandas(m.run, ddl).select(
            "evidence_id", F.lit(m.module).alias("module"), F.lit("Complete").alias("status"), "confidence", "evidence_strength")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return evidence.sparkSession.createDataFrame(
            [], "evidence_id string, module string, status string, confidence double, evidence_strength string")
    return out


def module_status(modules: Sequence[Analysis]) -> Column:
    """Connection state per module as a map column, for reports."""
    pairs = [x for m in modules for x in (F.lit(m.module), F.lit("Engine connected" if m.connected else "Analysis engine not connected"))]
    return F.create_map(*pairs)


def default_modules() -> list[Analysis]:
    return [Analysis(m) for m in fixed.FUSION_MODULES]
