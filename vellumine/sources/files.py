"""Scans of evidence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellumine.functions import files as fx


def spread(df: DataFrame, least: int = 8) -> DataFrame:
    """Deal out a scan of fewer than ``least`` partitions, whatever the cluster's size.

    Only a few small files with one row group each are worth the exchange; a table of
    ``least`` splits or more is returned unchanged.
    """
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


LIST_DDL = "path string, modificationTime timestamp, length bigint, folder boolean"
SCAN_DDL = "path string, modificationTime timestamp, length bigint, content binary"
BATCH_BYTES = 8 << 20  # content in one Arrow batch; a longer file is a batch of its own
TASK_BYTES = 128 << 20  # listed bytes that one task reads


def file_system(uri: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _anchor(root: str) -> tuple[str, str]:
    """Scheme and authority of ``root`` as Spark writes them, and the path below."""
    if "://" in root and not root.startswith("file:"):
        scheme, rest = root.split("://", 1)
        host, _, path = rest.partition("/")
        return f"{scheme}://{host}", f"/{path}".rstrip("/")
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return "file:", root.rstrip("/")


def _millis(info) -> int | None:
    """Modification time in microseconds, cut to milliseconds as Spark's file source has it."""
    return None if info.mtime_ns is None else info.mtime_ns // 1_000_000 * 1000


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, zero-byte and hidden ones too: (path, modificationTime, length).

    Folders of one depth are listed by tasks, round after round, each folder once; a round's
    findings are stored before the next begins. The driver lists nothing and holds no path,
    so the number of files and folders is bounded by the cluster alone. A folder that is gone
    by its round, or cannot be read, has no files; a root that is missing raises.
    """
    from pyarrow import fs

    from vellumine.session import cut_lineage

    anchor, top = _anchor(root)
    system, at = file_system(f"{anchor}{top}")
    if system.get_file_info(at).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    def listing(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, at = file_system(folder)
                try:
                    found = system.get_file_info(fs.FileSelector(at, recursive=False))
                except OSError:
                    continue
                for first in range(0, len(found), 10_000):
                    some = [f for f in found[first : first + 10_000] if f.type in (fs.FileType.File, fs.FileType.Directory)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([folder.rstrip("/") + "/" + f.base_name for f in some], pa.string()),
                        pa.array([_millis(f) for f in some], pa.timestamp("us", "UTC")), pa.array([f.size or 0 for f in some], pa.int64()),
                        pa.array([f.type == fs.FileType.Directory for f in some], pa.bool_())], ["path", "modificationTime", "length", "folder"])

    folders, files, n = spark.createDataFrame([(f"{anchor}{top}",)], "path string"), None, 1
    while n:
        # few folders a task: listing is waiting, not work
        found = cut_lineage(folders.repartition(min(n, 4096), "path").mapInArrow(listing, LIST_DDL))
        here = found.where("NOT folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        folders = found.where("folder").select("path")
        n = folders.count()
    return files


def read_files(files: DataFrame) -> DataFrame:
    """Listed files with their ``content``: (path, modificationTime, length, content).

    Tasks open the files; each reads about ``TASK_BYTES``, dealt by path, so a folder of any size
    is spread. Time and length are those found after reading. A file that is gone is left out.
    """
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ["path", "modificationTime", "length", "content"]
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = file_system(path)
                try:
                    with system.open_input_stream(at) as f:
                        content = f.read()
                    state = system.get_file_info(at)
                except FileNotFoundError:
                    continue
                if state.type != fs.FileType.File:
                    continue
                if rows and held + len(content) > BATCH_BYTES:
                    yield pack(rows)
                    rows, held = [], 0
                rows.append((path, _millis(state), len(content), content))
                held += len(content) + 100
        if rows:
            yield pack(rows)

    total = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = min(total.n, max((total.bytes or 0) // TASK_BYTES, files.sparkSession.sparkContext.defaultParallelism))
    return files.select("path").repartition(max(int(tasks), 1), "path").mapInArrow(read, SCAN_DDL)


def evidence_scan(spark: SparkSession, root: str, content: bool = False, include_empty: bool = True, listing: str = "tasks") -> DataFrame:
    """Supported files below a folder: (path, modificationTime, length[, content]).

    Without ``content`` only the listing is read; files are never opened. Zero-byte files are
    evidence too; ``include_empty`` leaves them out. ``listing`` "tasks" lists and reads in tasks
    (``list_files``, ``read_files``); "driver" uses Spark's file source, for stores that only Spark
    reaches: its listing is held by the driver and leaves out zero-byte and hidden files.
    """
    if listing == "driver":
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(fx.is_supported(F.col("path")))
        return df if content else df.drop("content")
    df = list_files(spark, root).where(fx.is_supported(F.col("path")))
    if not include_empty:
        df = df.where("length > 0")
    return read_files(df) if content else df


def file_facts(df: DataFrame) -> DataFrame:
    """Name, type, size, MIME type and modification time of scanned files."""
    p = F.col("path")
    return df.select(
        "path", fx.base_name(p).alias("file_name"), F.upper(fx.extension(p)).alias("file_type"),
        F.col("length").alias("file_size"), fx.human_size(F.col("length")).alias("size_text"),
        fx.mime_type(p).alias("mime_type"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


BATCH_SAMPLES = 1 << 25  # samples in one Arrow batch of rasters; a larger image is a batch of its own

# Channel order of decoded images by channel count.
CHANNELS = {1: ["GRAY"], 3: ["B", "G", "R"], 4: ["B", "G", "R", "A"]}


def decoded_images(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Decoded images as raster rows: image_id (path), height, width, channels, px.

    Decoding is the JVM's image source; the byte-to-number step runs over Arrow buffers
    without a copy per sample. An image that does not decode stays as a row of height and
    width -1 without channels or samples.
    """
    img = (spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
           .select(F.col("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data"))
    return samples_from_bytes(img)


def samples_from_bytes(img: DataFrame) -> DataFrame:
    """Raster rows from (image_id, height, width, nChannels, data)."""
    import numpy as np
    import pyarrow as pa

    def unpack(batches):
        for whole in batches:
            upto = np.cumsum([0, *[len(v.as_buffer()) if v.is_valid else 0 for v in whole.column("data")]])
            first = 0
            while first < whole.num_rows:  # a bounded number of samples at once, one image at least
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + BATCH_SAMPLES, side="right")) - 1)
                b = whole.slice(first, last - first)
                data = [np.frombuffer(v.as_buffer(), dtype=np.uint8) if v.is_valid else np.empty(0, np.uint8) for v in b.column("data")]
                offsets = (upto[first : last + 1] - upto[first]).astype(np.int32)
                px = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(data).astype(np.int16)))
                kept = [b.column(c) for c in ("image_id", "height", "width", "nChannels")]
                yield pa.RecordBatch.from_arrays([*kept, px], names=["image_id", "height", "width", "nChannels", "px"])
                first = last

    flat = img.select("image_id", "height", "width", "nChannels", "data").mapInArrow(
        unpack, "image_id string, height int, width int, nChannels int, px array<smallint>")
    names = F.create_map(*[x for n, cs in CHANNELS.items() for x in (F.lit(n), F.array(*[F.lit(c) for c in cs]))])
    return flat.select("image_id", "height", "width", F.try_element_at(names, F.col("nChannels")).alias("channels"), "px")
