"""Streaming forms of intake, audit log, current state and audit rate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.functions.numbering import hash_order
from vellumine.operators import integrity, metadata, records
from vellumine.sources.files import evidence_scan, read_files
from vellumine.sources.tables import EvidenceTables, exists

SNAPSHOT_DDL = "path string, modificationTime timestamp, length bigint, batch bigint"


def seen_files(files: DataFrame) -> DataFrame:
    """Supported files with digests and container signature, without their content."""
    from vellumine.functions import files as fx

    seen = integrity.digests(metadata.signature(files.where(fx.is_supported(F.col("path")))))
    return seen.select("path", "modificationTime", "length", "sha256", "md5", "declared_ext", "detected_format",
                       "is_consistent", "warning")


def changed_files(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Listed files that are new or differ from their last state: (path, modificationTime, length).

    ``snapshot`` has every state taken so far with its ``batch``. A file counts as changed when
    its time or its length is not that of its last state, so a file that is overwritten in
    place, or put back with an older time, is found.
    """
    last = snapshot.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length"), "batch").alias("was"))
    now = listing.select("path", "modificationTime", "length").alias("now")
    same = ((F.col("now.path") == F.col("last.path")) & F.col("now.modificationTime").eqNullSafe(F.col("last.was.modificationTime"))
            & F.col("now.length").eqNullSafe(F.col("last.was.length")))
    return now.join(last.alias("last"), same, "left_anti")


def register_files(scan: DataFrame, tables: EvidenceTables, case_of: Callable[[DataFrame], Column]) -> DataFrame:
    """Scanned files with case, evidence id, re-import status and recorded digest.

    The look-up opens only the folders of the scan's cases; nothing is written.
    """
    scan = scan.withColumn("case_id", case_of(scan)).withColumnRenamed("path", "file_path").dropDuplicates(["case_id", "file_path"])
    registry = tables.read_buckets("evidence_items", scan).select("case_id", "file_path", "evidence_id", "sha256")
    return records.register_or_reuse(scan, registry, [hash_order("file_path"), F.col("file_path")])


def write_registered(done: DataFrame, tables: EvidenceTables, check: bool) -> None:
    """Append the evidence, history and change events of registered files.

    With ``check``, rows that an earlier, broken attempt has written are left out; without it
    no table is read.
    """
    from vellumine.functions import files as fx

    def add(name: str, rows: DataFrame, keys: list[str]) -> None:
        tables.append(name, rows.join(tables.read_buckets(name, done).select(keys), keys, "left_anti") if check else rows)

    fresh, now = done.where(~F.col("known")), F.current_timestamp()
    add("evidence_items", fresh.select(
        "case_id", "evidence_id", fx.base_name(F.col("file_path")).alias("name"), F.col("file_path").alias("source"), "file_path",
        "sha256", "md5", "status", F.lit(True).alias("relevant"), now.alias("created_at"), now.alias("imported_at"),
        F.upper("declared_ext").alias("file_type"), F.col("length").alias("file_size"), fx.mime_type(F.col("file_path")).alias("mime_type")),
        ["case_id", "evidence_id"])
    add("processing_history", records.import_history(fresh.withColumns({"file_type": F.upper("declared_ext"), "file_size": F.col("length")})),
        ["case_id", "evidence_id", "operation"])
    # whole digests and the file's time: a change back and forth is three events
    text = F.concat(F.lit("SHA-256 mismatch! File: "), fx.base_name(F.col("file_path")), F.lit(", Recorded: "), F.col("recorded_sha256"),
                    F.lit(", Current: "), F.col("sha256"), F.lit(", Modified: "), F.col("modificationTime").cast("string"))
    add("case_events", records.audit_rows(done.where(F.col("status") == "INTEGRITY CHANGED"), F.col("case_id"), F.col("evidence_id"), F.col("status"), text),
        ["case_id", "evidence_id", "event_type", "description"])


class Intake:
    """``foreachBatch`` writer that lists a folder, compares it with what was taken, and registers.

    What a batch takes and decides is stored under ``outcomes/batch=N`` before any table is
    written. A batch that is run again finds its outcome there and completes the tables; the
    outcomes of all batches are the snapshot that the next listing is compared with. Tables
    are searched for rows already written only in a batch that is run again and in the first
    batch of a checkpoint (whose predecessor may be lost), so history and events are never
    read in the normal course.
    """

    def __init__(self, spark: SparkSession, root: str, tables: EvidenceTables, outcomes: str, case_of: Callable[[DataFrame], Column]):
        self.spark, self.root, self.tables, self.outcomes, self.case_of = spark, root, tables, outcomes, case_of

    def __call__(self, _clock: DataFrame, batch_id: int) -> None:
        from vellumine.session import cut_lineage

        path = f"{self.outcomes}/batch={batch_id}"
        first, again = not exists(self.spark, self.outcomes), exists(self.spark, f"{path}/_SUCCESS")
        if not again:
            changed = cut_lineage(changed_files(evidence_scan(self.spark, self.root), self.snapshot(batch_id)))
            if changed.isEmpty():
                return
            taken = cut_lineage(seen_files(read_files(changed)))
            done = register_files(taken, self.tables, self.case_of)
            done.withColumn("path", F.col("file_path")).write.mode("overwrite").parquet(path)
        write_registered(self.spark.read.parquet(path), self.tables, check=first or again)

    def snapshot(self, before: int) -> DataFrame:
        """Every file state taken by the batches before ``before``."""
        if not exists(self.spark, self.outcomes):
            return self.spark.createDataFrame([], SNAPSHOT_DDL)
        return self.spark.read.schema(SNAPSHOT_DDL).parquet(self.outcomes).where(F.col("batch") < before)


def run_intake(spark: SparkSession, root: str, tables: EvidenceTables, checkpoint: str,
               case_of: Callable[[DataFrame], Column], once: bool = True, interval: str = "2 seconds") -> StreamingQuery:
    """Start the intake; ``once`` takes what is there and stops.

    The stream is a clock: each trigger lists the folder and takes the files that are new or
    were changed in place since they were taken. A file that changes once it is read is taken again
    by the next trigger. A changed file that is on record raises INTEGRITY CHANGED.
    """
    for name in ("evidence_items", "processing_history", "case_events"):
        if not tables._exists(name):
            tables.append(name, spark.createDataFrame([], "case_id string"))
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = (clock.writeStream.foreachBatch(Intake(spark, root, tables, f"{checkpoint.rstrip('/')}/outcomes", case_of))
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def audit_append(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append-only audit log; the file sink's commit log makes each batch appear once."""
    writer = events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_state(updates: DataFrame, keys: Sequence[str], order: Sequence[str], publish: Callable[[DataFrame, int], None],
                  checkpoint: str, interval: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Latest row per key, refreshed at an interval.

    State is one row per key. ``publish(changed_rows, batch_id)`` receives the rows that
    changed in the interval.
    """
    state = records.latest_by(updates, keys, order)
    writer = state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def audit_rate(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour",
               watermark: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window. The watermark bounds the open windows of a
    stream and has no effect on a batch."""
    kind_of_time = dict(events.dtypes)[at]
    if events.isStreaming:  # watermarks need an instant
        events = events.withColumn(at, F.col(at).cast("timestamp"))
    w = F.window(F.col(at), window)
    return (events.withWatermark(at, watermark).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast(kind_of_time).alias("window_start"), kind, "n"))
