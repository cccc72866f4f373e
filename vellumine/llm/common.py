"""Helpers of the corpus operators: stored intermediates, column names, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)  # then there is nothing else to lower
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, a temporary folder is used on a local master only; on a cluster a
    machine-local folder would lose rows, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(shared_folder, "local", None) is None:
        shared_folder.local = tempfile.mkdtemp(prefix="spark-")
    return shared_folder.local


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker gives freed memory back to the system.

    Workers outlive their tasks; without this the peaks of all operators of a session stay with
    them while other operators run.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
        give_back()

    return tidied


def give_back() -> None:
    """Return this process's freed memory to the system; also after tables came to the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, component), the smallest node.

    Alternating large-star and small-star steps. Each is a minimum per node (combined before
    the shuffle) joined back to the edges, so a hub never meets its neighbours in one task
    beyond what adaptive execution splits. Every round is stored, which ends lineage, and
    the rounds stop when the edge set repeats. Null ends and loops are ignored.
    """
    e = stored(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).select(F.col("u").alias("hub"), F.least("u", "lo").alias("lo"))
        big = e.select(F.col("v").alias("hub"), F.col("u").alias("far")).join(low, "hub").select(F.col("far").alias("u"), F.col("lo").alias("v"))
        kept = e.select(F.col("u").alias("hub")).distinct().join(low, "hub").where("hub <> lo").select(F.col("hub").alias("u"), F.col("lo").alias("v"))
        large = big.unionByName(kept).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(low2, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v")).unionByName(low2.select("u", F.col("lo").alias("v")))
        e = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        seen = state
    node = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
