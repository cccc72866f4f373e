"""Durable tables on Parquet, one folder per table."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vellumine.schemas import DEFAULTS, TABLES
from vellumine.session import cut_lineage

BUCKETS = 256
FOLDER_ROWS = 1 << 22  # rows of a bucket from which it has more than one part
MOST_SPLITS = 20  # a bucket has at most 2^20 parts
SMALL_FOLDER = 1 << 12  # rows a folder below which a write is spread by its folders, not by its bytes
FOLDERS_A_TASK = 16  # folders that one task writes then
MOVES_A_TASK = 256  # folders or files that one task moves or deletes


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill columns that older rows lack, adding the column where it is absent."""
    out = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(out)


def case_bucket(case_id: Column | str, buckets: int = BUCKETS) -> Column:
    """Hash bucket of a case: a keyed read opens the folders of one bucket."""
    return F.pmod(F.xxhash64(case_id), F.lit(buckets)).cast("int")


def _spread(key: Column | str) -> Column:
    """A number below 2^20 by which the rows of a bucket are dealt to its parts."""
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(1 << MOST_SPLITS)).cast("int")


def parts_of(spread: Column) -> Column:
    """Every part that a row may be in, one for each number of parts its bucket ever had.

    Parts are numbered like a binary heap: a bucket of 2^k parts has numbers 2^k to 2^(k+1) - 1,
    and a row goes to 2^k + (spread mod 2^k). A bucket that grows is cut finer for new rows
    only, and a number tells how fine the cut was.
    """
    return F.transform(F.lit([1 << k for k in range(MOST_SPLITS + 1)]), lambda size: size + F.pmod(spread, size))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# --- files of a rewrite, by the file system that tasks open themselves
def _drop_file(root: str, name: str) -> None:
    from pyarrow import fs

    from vellumine.sources.files import file_system

    system, at = file_system(f"{root}/{name}")
    folder, _, last = at.rpartition("/")
    for path in [at, f"{folder}/.{last}.crc"] if isinstance(system, fs.LocalFileSystem) else [at]:
        try:
            system.delete_file(path)
        except FileNotFoundError:  # an earlier attempt took it
            pass


def _move_folder(root: str, aside: str, name: str) -> None:
    """Data files of a folder aside to the same folder of the table, checksums with them."""
    from pyarrow import fs

    from vellumine.sources.files import file_system

    system, source = file_system(f"{aside}/{name}".rstrip("/"))
    _, target = file_system(f"{root}/{name}".rstrip("/"))
    found = system.get_file_info(fs.FileSelector(source, recursive=False, allow_not_found=True))
    system.create_dir(target, recursive=True)
    # the checksum first: no reader meets a file whose checksum is still aside
    for file in sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.startswith(("part-", ".part-"))):
        try:
            system.move(f"{source}/{file}", f"{target}/{file}")
        except FileNotFoundError:  # another attempt moved it
            pass


def _drop_empty(root: str, name: str) -> None:
    from pyarrow import fs

    from vellumine.sources.files import file_system

    system, at = file_system(f"{root}/{name}")
    if system.get_file_info(at).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(at, recursive=False)):
        system.delete_dir(at)


class EvidenceTables:
    """Reads and writes of the case tables under one root path.

    Folders are ``case_bucket=B + (P - 1) * buckets``, part P of bucket B. A bucket of up to ``folder_rows`` rows has one part;
    beyond, new rows are dealt to 2, 4, 8 ... parts by their evidence, so a case that holds a
    large share of all rows fills many folders, a case is still read from one bucket, and an
    evidence item from one folder for each size the bucket has had. The rows of each bucket are
    counted where they are written, in ``_rows``; the counts steer new rows only.

    Rewrites touch the files that hold a key and no others. The new files are finished aside, a
    journal names the old ones, and only then are the old files deleted and the new moved in; rows
    are appended in the same way. Whoever opens the table next ends a rewrite that was broken off.
    Files are written, listed, deleted and moved by tasks.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, folder_rows: int = FOLDER_ROWS):
        self.spark, self.root, self.buckets, self.folder_rows = spark, root.rstrip("/"), buckets, folder_rows

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _partitioning(self, name: str) -> list[str]:
        return ["case_bucket"] if "case_id" in TABLES[name].fieldNames() else []

    def _spread_key(self, name: str) -> str:
        return "evidence_id" if "evidence_id" in TABLES[name].fieldNames() else "case_id"

    def _shape(self, name: str, df: DataFrame) -> DataFrame:
        """The table's columns in order and type, defaults filled in."""
        schema = TABLES[name]
        full = with_defaults(df, {f: None for f in schema.fieldNames() if f not in df.columns})
        full = with_defaults(full, DEFAULTS.get(name, {}))
        return full.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    # -- layout

    def _counts(self, name: str) -> DataFrame:
        ddl = "case_bucket int, n long"
        at = f"{self.root}/_rows/{name}"
        rows = self.spark.read.schema(ddl).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], ddl)
        return rows.groupBy("case_bucket").agg(F.sum("n").alias("n"))

    def _laid_out(self, name: str, rows: DataFrame, counted: DataFrame | None) -> tuple[DataFrame, int, int]:
        """Finished rows with their folders, the number of folders they may fill and of the rows.

        The rows of ``counted`` are added to the counts; rows that only move are in them already.
        """
        def per_bucket(df: DataFrame) -> list:  # at most ``buckets`` rows
            return df.groupBy(case_bucket("case_id", self.buckets).alias("case_bucket")).agg(F.count(F.lit(1)).alias("n")).collect()

        fresh = per_bucket(rows)
        if counted is not None:
            new = fresh if counted is rows else per_bucket(counted)
            self.spark.createDataFrame(new, "case_bucket int, n long").coalesce(1).write.mode("append").parquet(f"{self.root}/_rows/{name}")
        cuts = {r.case_bucket: min(math.ceil(math.log2(max(1.0, r.n / self.folder_rows))), MOST_SPLITS) for r in self._counts(name).collect()}
        cut = F.coalesce(F.get(F.lit([cuts.get(b, 0) for b in range(self.buckets)]), F.col("case_bucket")), F.lit(0))
        placed = rows.withColumn("case_bucket", case_bucket("case_id", self.buckets))
        folder = F.col("case_bucket") + (F.get(parts_of(_spread(self._spread_key(name))), cut) - 1) * self.buckets
        return placed.withColumn("case_bucket", folder.cast("int")), sum(1 << cuts.get(r.case_bucket, 0) for r in fresh), sum(r.n for r in fresh)

    def _write_aside(self, name: str, rows: DataFrame, path: str, counted: DataFrame | None) -> None:
        """Finished rows as files below ``path``, which nobody reads before its journal is there."""
        parts = self._partitioning(name)
        if not parts:
            return rows.write.mode("append").parquet(path)
        # gather each folder's rows into few files
        rows, folders, n = self._laid_out(name, rows, counted)
        if n < folders * SMALL_FOLDER:  # few bytes in many files: files take the time
            rows = rows.repartition(max(1, min(folders, n) // FOLDERS_A_TASK), *parts)
        else:  # a hot folder is split by AQE
            rows = rows.hint("rebalance", *parts)
        # tasks commit their own files; the journal, not the job's commit, makes them part of the table
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*parts).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        self.recover(name)
        shaped = self._shape(name, df)
        if not self._partitioning(name):
            shaped.write.mode("append").parquet(self.path(name))
            return
        # counted, then written: evaluated once
        rows = cut_lineage(shaped)
        self._exchange(name, [], rows, rows)

    # -- reads

    def read(self, name: str) -> DataFrame:
        """The table under its current schema: columns older files lack get defaults."""
        self.recover(name)
        return with_defaults(self._files(name, self.path(name)), DEFAULTS.get(name, {}))

    def _files(self, name: str, *paths: str) -> DataFrame:
        folder = [T.StructField(c, T.IntegerType()) for c in self._partitioning(name)]
        reader = self.spark.read.schema(T.StructType([*TABLES[name].fields, *folder])).option("basePath", self.path(name))
        # Spark lists many folders in a task each; a share of them each takes far less
        setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        usual = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(min(int(usual), 4 * self.spark.sparkContext.defaultParallelism)))
        try:
            return reader.parquet(*paths)
        finally:
            self.spark.conf.set(setting, usual)

    def read_buckets(self, name: str, cases: DataFrame) -> DataFrame:
        """Rows in the buckets the given cases fall into; other folders are pruned at run time."""
        few = cases.select(case_bucket("case_id", self.buckets).alias("_bucket")).distinct()
        # at most ``buckets`` rows of one integer: safe to broadcast whatever the data
        return self.read(name).join(F.broadcast(few), self._bucket() == F.col("_bucket"), "left_semi")

    def _bucket(self) -> Column:
        return F.pmod("case_bucket", F.lit(self.buckets))

    def read_case(self, name: str, case_id: str, evidence_id: str | None = None) -> DataFrame:
        """Rows of one case, or of one evidence item of it; only its folders are opened."""
        at = self.spark.range(1).select(case_bucket(F.lit(case_id), self.buckets), parts_of(_spread(F.lit(evidence_id)))).first()
        rows = self.read(name).where((self._bucket() == at[0]) & (F.col("case_id") == case_id))
        if evidence_id is None:
            return rows
        return rows.where(F.col("case_bucket").isin([at[0] + (p - 1) * self.buckets for p in at[1]]) & (F.col("evidence_id") == evidence_id))

    # -- rewrites

    def replace(self, name: str, rows: DataFrame, key: Sequence[str]) -> None:
        """Replace the rows of every key in ``rows``; only files that hold one are rewritten."""
        rows = cut_lineage(self._shape(name, rows))
        self._rewrite(name, rows.select(*key).distinct(), key, rows)

    def delete_cases(self, doomed: DataFrame, names: Sequence[str] = tuple(TABLES)) -> None:
        """Delete cases everywhere; pass ``names`` without the history to keep it."""
        keys = cut_lineage(doomed.select("case_id").distinct())
        for name in names:
            if self._partitioning(name) and self._exists(name):
                self._rewrite(name, keys, ["case_id"], None)

    def touched_files(self, name: str, keys: DataFrame, key: Sequence[str]) -> list[str]:
        """Files, relative to the table, with a row of one of the keys."""
        current = self.read_buckets(name, keys) if "case_id" in key and self._partitioning(name) else self.read(name)
        found = current.select(*key, F.col("_metadata.file_path").alias("_file")).join(keys, list(key), "left_semi").select("_file").distinct()
        depth = len(self._partitioning(name)) + 1
        return sorted("/".join(r[0].split("/")[-depth:]) for r in found.collect())  # paths of this table's files only

    def _rewrite(self, name: str, keys: DataFrame, key: Sequence[str], added: DataFrame | None) -> None:
        old = self.touched_files(name, keys, key)
        rows = added
        if old:
            held = self._files(name, *[f"{self.path(name)}/{f}" for f in old])
            kept = self._shape(name, held.join(keys, list(key), "left_anti"))
            if self._partitioning(name):
                kept = cut_lineage(kept)
            # one file of a folder holds what stays and what is new
            rows = kept if added is None else kept.unionByName(added)
        self._exchange(name, old, rows, added)

    def _exchange(self, name: str, old: list[str], rows: DataFrame | None, counted: DataFrame | None) -> None:
        """Put ``rows`` in the place of the files ``old``."""
        label = uuid.uuid4().hex
        if rows is not None:
            self._write_aside(name, rows, f"{self.root}/_aside/{name}/{label}", counted)
        self.spark.createDataFrame([(f,) for f in old], "file string").coalesce(1).write.parquet(f"{self.root}/_journal/{name}/{label}")
        self._finish(name, label)

    def _exists(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def recover(self, name: str) -> None:
        """End rewrites that a lost driver has left between journal and move."""
        at = f"{self.root}/_journal/{name}"
        if not exists(self.spark, at):
            return
        fs, path = self._fs(at)
        for status in fs.listStatus(path):
            label = status.getPath().getName()
            if exists(self.spark, f"{at}/{label}/_SUCCESS"):
                self._finish(name, label)

    def _finish(self, name: str, label: str) -> None:
        """Delete the files of a journal, move the new ones in, drop the journal; may be repeated."""
        aside, journal = f"{self.root}/_aside/{name}/{label}", f"{self.root}/_journal/{name}/{label}"
        old = [row[0] for row in self.spark.read.schema("file string").parquet(journal).collect()]
        fs, top = self._fs(aside)
        fs.mkdirs(self._fs(self.path(name))[1])  # a table without rows is a folder too
        new = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        new = [f for f in new if f.startswith("case_bucket=")] if self._partitioning(name) else [""] * bool(new)
        if self._tasks_reach():
            root = self.path(name)
            self._each(old, lambda f: _drop_file(root, f))
            self._each(new, lambda f: _move_folder(root, aside, f))
            self._each(sorted({f.rpartition("/")[0] for f in old} - {"", *new}), lambda f: _drop_empty(root, f))
        else:
            self._by_driver(name, aside, old)
        if fs.exists(top):
            fs.delete(top, True)
        fs.delete(self._fs(journal)[1], True)
        # Spark may hold an older listing of the table
        self.spark.catalog.refreshByPath(self.path(name))

    def _tasks_reach(self) -> bool:
        """Whether tasks can open the folder of the tables themselves."""
        from pyarrow import fs

        from vellumine.sources.files import file_system

        try:
            system, at = file_system(self.root)
            return system.get_file_info(at).type == fs.FileType.Directory
        except Exception:  # noqa: BLE001 - a scheme, library or right that only Spark has
            return False

    def _each(self, names: list[str], do: Callable[[str], None]) -> None:
        """``do`` for every name, by tasks where there are many; all may be repeated."""
        if len(names) <= MOVES_A_TASK:
            for name in names:
                do(name)
            return

        def work(batches: Iterator) -> Iterator:
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    do(name)
            yield from ()

        tasks = -(-len(names) // MOVES_A_TASK)
        self.spark.createDataFrame([(n,) for n in names], "name string").repartition(tasks, "name").mapInArrow(work, "name string").count()

    def _by_driver(self, name: str, aside: str, old: list[str]) -> None:
        """The same for stores that only Spark reaches."""
        left = set()
        for file in old:
            fs, path = self._fs(f"{self.path(name)}/{file}")
            fs.delete(path, False)
            left.add(file.rpartition("/")[0])
        fs, top = self._fs(aside)
        if fs.exists(top):
            found = fs.listFiles(top, True)
            while found.hasNext():
                file = found.next().getPath()
                if file.getName().startswith("part-"):
                    below = "/".join(file.toString().split("/")[-len(self._partitioning(name)) - 1 :])
                    _, target = self._fs(f"{self.path(name)}/{below}")
                    fs.mkdirs(target.getParent())
                    fs.rename(file, target)
        for folder in left - {""}:
            fs, path = self._fs(f"{self.path(name)}/{folder}")
            if fs.exists(path) and not fs.listStatus(path):
                fs.delete(path, False)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at
