"""Streaming intake, audit log, current state and audit rate."""

import os
import shutil
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.make_files import png
from vellumine.sources.tables import EvidenceTables
from vellumine.streaming import jobs


def intake(spark, root, tables, checkpoint):
    q = jobs.run_intake(spark, str(root), tables, str(checkpoint), lambda b: F.lit("CASE-1"))
    q.awaitTermination()
    assert q.exception() is None


def test_intake_registers_each_file_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.png").write_bytes(png(2, 2, lambda y, x: (1, 2, 3)))
    (root / "b.jpg").write_bytes(png(2, 2, lambda y, x: (4, 5, 6)))
    (root / "c.txt").write_text("ignored")
    tables = EvidenceTables(spark, str(tmp_path / "db"), buckets=2)
    intake(spark, root, tables, tmp_path / "cp1")
    rows = tables.read("evidence_items").collect()
    assert {r.name for r in rows} == {"a.png", "b.jpg"} and {r.evidence_id for r in rows} == {"EVD-000001", "EVD-000002"}
    assert tables.read("processing_history").count() == 2
    (root / "d.png").write_bytes(png(2, 2, lambda y, x: (7, 8, 9)))
    intake(spark, root, tables, tmp_path / "cp1")
    assert tables.read("evidence_items").where("evidence_id = 'EVD-000003'").count() == 1
    # a replay from the start (lost checkpoint) registers nothing twice
    intake(spark, root, tables, tmp_path / "cp2")
    assert tables.read("evidence_items").count() == 3 and tables.read("processing_history").count() == 3
    # content that changed since is reported
    (root / "a.png").write_bytes(png(2, 2, lambda y, x: (9, 9, 9)))
    intake(spark, root, tables, tmp_path / "cp3")
    assert [r.event_type for r in tables.read("case_events").collect()] == ["INTEGRITY CHANGED"]


def test_files_overwritten_in_place_are_seen(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "er").mkdir(parents=True)
    for name, value in (("a.png", 1), ("deep/b.png", 2), ("deep/er/c.png", 3)):
        (root / name).write_bytes(png(2, 2, lambda y, x, v=value: (v, v, v)))
    tables = EvidenceTables(spark, str(tmp_path / "db"), buckets=2)
    intake(spark, root, tables, tmp_path / "cp")
    assert tables.read("case_events").count() == 0
    old = (root / "a.png").stat()
    (root / "a.png").write_bytes(png(2, 2, lambda y, x: (9, 9, 9)))
    (root / "deep/er/c.png").write_bytes((root / "deep/er/c.png").read_bytes())  # same content, new time
    os.utime(root / "a.png", ns=(old.st_atime_ns, old.st_mtime_ns - 10**9))  # older than what was taken
    for _ in range(2):  # the second run has nothing to do
        intake(spark, root, tables, tmp_path / "cp")
    assert [r.description.split(", Rec")[0] for r in tables.read("case_events").collect()] == ["SHA-256 mismatch! File: a.png"]
    (root / "a.png").write_bytes(png(2, 2, lambda y, x: (1, 1, 1)))  # the recorded content is back
    intake(spark, root, tables, tmp_path / "cp")
    assert tables.read("case_events").count() == 1 and tables.read("evidence_items").count() == tables.read("processing_history").count() == 3


@pytest.mark.parametrize("broken", [0, 1, 2])
def test_a_batch_that_failed_is_completed(spark, tmp_path, monkeypatch, broken):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.png").write_bytes(png(2, 2, lambda y, x: (1, 2, 3)))
    tables = EvidenceTables(spark, str(tmp_path / "db"), buckets=2)
    intake(spark, root, tables, tmp_path / "cp")
    (root / "a.png").write_bytes(png(3, 3, lambda y, x: (1, 2, 3)))
    (root / "b.png").write_bytes(png(2, 2, lambda y, x: (4, 5, 6)))
    append, calls = EvidenceTables.append, []

    def fail(self, name, df):
        calls.append(name)
        if len(calls) == broken + 1:
            raise RuntimeError("lost")
        append(self, name, df)

    monkeypatch.setattr(EvidenceTables, "append", fail)
    q = jobs.run_intake(spark, str(root), tables, str(tmp_path / "cp"), lambda b: F.lit("CASE-1"))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()
    monkeypatch.setattr(EvidenceTables, "append", append)
    (root / "c.png").write_bytes(png(2, 2, lambda y, x: (7, 8, 9)))
    for _ in range(2):
        intake(spark, root, tables, tmp_path / "cp")
    assert sorted(r.name for r in tables.read("evidence_items").collect()) == ["a.png", "b.png", "c.png"]
    assert tables.read("processing_history").count() == 3
    assert [r.event_type for r in tables.read("case_events").collect()] == ["INTEGRITY CHANGED"]


def test_states_of_files(spark):
    at = "path string, modificationTime timestamp, length bigint"
    stamp = datetime(2026, 1, 1).replace
    listing = spark.createDataFrame([("a", stamp(), 1), ("b", stamp(), 2), ("c", stamp(day=2), 3), ("d", None, 4), ("e", stamp(), 9)], at)
    before = spark.createDataFrame([("a", stamp(), 1, 0), ("b", stamp(), 2, 0), ("b", stamp(), 3, 1), ("c", stamp(), 3, 0), ("d", None, 4, 2), ("z", stamp(), 1, 0)], at + ", batch bigint")
    assert sorted(r.path for r in jobs.changed_files(listing, before).collect()) == ["b", "c", "e"]


def events_stream(spark, sf_dir, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", src / "events.parquet")
    schema = spark.read.parquet(str(src)).schema
    return spark.readStream.schema(schema).parquet(str(src))


def test_audit_log_appends_once(spark, sf_dir, tmp_path):
    stream = events_stream(spark, sf_dir, tmp_path)
    for _ in range(2):
        jobs.audit_append(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_current_state(spark, sf_dir, tmp_path):
    seen = {}

    def publish(batch, _):
        for r in batch.collect():
            seen[r.user_id] = r.event_id

    stream = events_stream(spark, sf_dir, tmp_path).select("user_id", "event_id", "ts")
    jobs.current_state(stream, ["user_id"], ["ts", "event_id"], publish, str(tmp_path / "cp"), once=True).awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert seen == {r.user_id: r.e for r in batch.collect()}


def test_audit_rate_stream_equals_batch(spark, sf_dir, tmp_path):
    stream = jobs.audit_rate(events_stream(spark, sf_dir, tmp_path))
    q = stream.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = jobs.audit_rate(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert sorted(map(tuple, spark.table("rate").collect())) == sorted(map(tuple, batch.collect()))
