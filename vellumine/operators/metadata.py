"""Metadata examination of evidence files.

The working shape is the property row ``(evidence_id, property, value, source)``. File
facts, signature and digests come from one projection over one binary scan; only the
XML packet, nested JSON and the container walk need Python, as small Arrow-batched
generators that turn one file's bytes into rows for Spark to group.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import xml.etree.ElementTree as ET
from array import array
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from vellumine.functions import files as fx, fixed, text as tx, times
from vellumine.functions.numbering import number_rows
from vellumine.functions.once import compute_once

ROW = ["evidence_id", "property", "value", "source"]


def _rows(df: DataFrame, entries: Sequence[tuple[str, Column, str]], key: str = "evidence_id") -> DataFrame:
    """Unpivot expressions to property rows; absent values give no row."""
    items = F.array(*[F.struct(F.lit(p).alias("property"), v.cast("string").alias("value"), F.lit(s).alias("source")) for p, v, s in entries])
    return df.select(F.col(key).alias("evidence_id"), F.inline(items)).where(F.col("value").isNotNull())


# --- signature and file facts ------------------------------------------------
def signature(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Container by leading bytes, and whether the declared extension agrees.

    Adds ``declared_ext``, ``detected_format``, ``magic_hex``, ``is_consistent`` and
    ``warning``. An unknown container never disagrees.
    """
    df = df.withColumns({
        "declared_ext": F.upper(fx.extension(F.col(path))),
        "detected_format": fx.container_type(F.col(content)),
        "magic_hex": fx.magic_hex(F.col(content)),
    })
    base = F.split_part(F.col("detected_format"), F.lit(" "), F.lit(1))
    expected = fx.expected_container(F.col("declared_ext"))
    disagrees = ~base.isin("UNKNOWN", "MISSING_FILE") & (expected != "") & (expected != base)
    warning = F.concat(F.lit("FORMAT MISMATCH: Declared extension '."), F.col("declared_ext"),
                       F.lit("' disagrees with detected container '"), F.col("detected_format"),
                       F.lit("' (Magic: "), F.substring("magic_hex", 1, 8), F.lit(")."))
    missing = F.col("detected_format") == "MISSING_FILE"
    return df.withColumns({
        "is_consistent": ~disagrees & ~missing,
        "warning": F.when(missing, "Evidence file does not exist on disk.").when(disagrees, warning).otherwise(""),
    })


def byte_order_rows(df: DataFrame) -> DataFrame:
    """Header facts of TIFF and WebP containers as property rows."""
    fmt = F.col("detected_format")
    return _rows(df, [
        ("TIFF Byte Order", F.when(fmt == "TIFF (Little Endian)", "Little Endian (Intel 'II')")
         .when(fmt == "TIFF (Big Endian)", "Big Endian (Motorola 'MM')"), "TIFF Header"),
        ("Container", F.when(fmt == "WEBP", "Google WebP (RIFF)"), "WebP Header"),
    ])


def filesystem_rows(df: DataFrame, path: str = "path", length: str = "length", modified: str = "modificationTime") -> DataFrame:
    """Filesystem facts. Needs no content, so the scan does not open the files."""
    p = F.col(path)
    ext = fx.extension(p)
    return _rows(df, [
        ("File Name", fx.base_name(p), "Filesystem"),
        ("File Extension", F.when(ext == "", "None").otherwise(F.concat(F.lit("."), ext)), "Filesystem"),
        ("Absolute Path", p, "Filesystem"),
        ("File Size", fx.exact_size(F.col(length)), "Filesystem"),
        ("File Modified Time", times.shown_local(F.col(modified), naive=False), "Filesystem"),
    ])


# --- XMP ---------------------------------------------------------------------
def with_xmp_packet(df: DataFrame, content: str = "content", out: str = "packet", window: int | None = None) -> DataFrame:
    """Add the first XMP packet of each file, null when none.

    ``window`` limits the search to the leading bytes; by default the whole file is
    searched. The pattern runs once per file, whatever is filtered on its result.
    """
    raw = f"`{content}`" if window is None else f"substring(`{content}`, 1, {int(window)})"
    df = compute_once(df, {"_x": f"regexp_extract(decode({raw}, 'ISO-8859-1'), r'(?s)<x:xmpmeta.*?</x:xmpmeta>', 0)"})
    df = compute_once(df, {"_x": f"CASE WHEN _x = '' THEN regexp_extract(decode({raw}, 'ISO-8859-1'), r'(?s)<xmpmeta.*?</xmpmeta>', 0) ELSE _x END"})
    return compute_once(df, {out: "CASE WHEN _x <> '' THEN make_valid_utf8(CAST(encode(_x, 'ISO-8859-1') AS STRING)) END"}, drop=("_x",))


# Words in the namespaces whose properties keep a prefix.
QUALIFIED = ("adobe", "photoshop", "dc", "xmp", "rights")


def _elements(packet: str) -> list[tuple[str, str | None, dict[str, str]]]:
    """(qualified tag, text, attributes) of every element; none when it does not parse."""
    try:
        return [(e.tag, e.text, dict(e.attrib)) for e in ET.fromstring(packet).iter()]
    except ET.ParseError:
        return []


def xmp_rows(packets: DataFrame, key: str = "evidence_id", packet: str = "packet", longest: int | None = None) -> DataFrame:
    """Packets to property rows; the first occurrence of a property wins.

    The parser only lists the elements; names, prefixes and the choice are set operations.
    ``longest`` leaves out element texts of that many characters or more; the default keeps
    texts of any length.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, n, *e) for k, xml in zip(batch["evidence_id"], batch["packet"]) for n, e in enumerate(_elements(xml))]
            yield pd.DataFrame(out, columns=["evidence_id", "n", "tag", "text", "attributes"])

    ready = packets.select(F.col(key).cast("string").alias("evidence_id"), F.col(packet).alias("packet")).where("packet IS NOT NULL")
    parsed = ready.mapInPandas(parse, "evidence_id string, n int, tag string, text string, attributes map<string,string>")
    name, space = F.regexp_extract("tag", r"([^}]*)$", 1), F.regexp_extract("tag", r"^\{(.*)\}", 1)
    kept_prefix = F.lower(space).rlike("|".join(QUALIFIED))
    owner = F.when(space.contains("/"), F.split_part(space, F.lit("/"), F.lit(-2))).otherwise(space)
    text = tx.strip(F.col("text"))
    own = F.struct(F.lit(0).alias("i"), F.concat(F.when(kept_prefix, F.concat(owner, F.lit(":"))).otherwise(""), name).alias("property"), text.alias("value"))
    attribute = lambda e, i: F.struct(
        (i + 1).alias("i"), F.concat(name, F.lit("@"), F.regexp_extract(e["key"], r"([^}]*)$", 1)).alias("property"), e["value"].alias("value"))
    found = parsed.select("evidence_id", "n", F.explode(F.concat(F.array(own), F.transform(F.map_entries("attributes"), attribute))).alias("p"))
    found = found.select("evidence_id", F.struct("n", "p.i").alias("at"), "p.i", "p.property", "p.value").where(
        (F.col("value") != "") & ~(F.col("property").rlike("@xmlns[^@]*$") & (F.col("i") > 0)))
    if longest is not None:
        found = found.where((F.col("i") > 0) | (F.length("value") < longest))
    first = found.groupBy("evidence_id", "property").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    return first.select("evidence_id", "property", "value", F.lit("XMP").alias("source"), (F.col("at.n") * 4096 + F.col("at.i")).alias("n"))


_JSON_TOKEN = re.compile(r'"(?:[^"\\]+|\\.)*"|[\[\]{}]|[^\s\[\]{}",:]+', re.S)


def _json_leaves(text: str) -> Iterator[tuple[str, str]]:
    """(path, token) of every leaf of a valid JSON text, in order, in one pass of any depth."""
    open_at: list[list] = []  # [is an object, path, key or index to come]
    for token in _JSON_TOKEN.finditer(text):
        t = token.group()
        if t in "]}":
            open_at.pop()
        else:
            path = ""
            if open_at:
                inside = open_at[-1]
                if inside[0] and inside[2] is None:
                    inside[2] = json.loads(t).encode("utf-8", "replace").decode()
                    continue
                if inside[0]:
                    path, inside[2] = (f"{inside[1]}:{inside[2]}" if inside[1] else inside[2]), None
                else:
                    path, inside[2] = f"{inside[1]}[{inside[2]}]", inside[2] + 1
            if t in "[{":
                open_at.append([t == "{", path, None if t == "{" else 0])
            else:
                yield path, t
        if not open_at:
            return


def flatten_json(df: DataFrame, key: str, column: str, source: str = "XMP") -> DataFrame:
    """Nested JSON to property rows named ``a:b[0]``; blank leaves are dropped.

    One walk over each text in the row that was read: the plan does not depend on the data and
    a text nested hundreds of levels deep makes no other row slower. Texts that are no JSON,
    or that name a key twice in one object, give no rows; neither do nulls, ``{}`` and ``[]``.
    Only brackets and names are read in the walk; values are decoded by the JSON parser.
    """
    ready = df.select(F.col(key).alias("evidence_id"), F.col(f"`{column}`").alias("_json")).where(F.expr("try_parse_json(_json) IS NOT NULL"))
    schema = T.StructType([ready.schema["evidence_id"], T.StructField("property", T.StringType()), T.StructField("token", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((i, *leaf) for i, text in enumerate(batch.column(1).to_pylist()) for leaf in _json_leaves(text))
            while some := list(itertools.islice(found, 10_000)):
                at, paths, tokens = zip(*some)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(paths, pa.string()), pa.array(tokens, pa.string())], schema.names)

    leaf = ready.mapInArrow(walk, schema).select(
        "evidence_id", "property", tx.strip(F.expr("CAST(try_parse_json(token) AS STRING)")).alias("value"), F.lit(source).alias("source"))
    return leaf.where("value <> ''")


# --- container segments ------------------------------------------------------
_MARKER = re.compile(rb"\xff+([\x01-\xfe])")  # fill bytes may stand before the code


class _JpegReader:
    """Marker segments of a JPEG stream by their declared lengths (ITU-T T.81, annex B).

    All markers but a few are followed by a segment whose first two bytes are its length. What
    follows a start of scan is entropy-coded and left unread. Bytes that are no marker where
    one is due are passed over, as decoders do. Reading ends with the image or at a segment
    cut off by the end of the file, of which the part that is there is returned.
    """

    BARE = {0x01, *range(0xD0, 0xDA)}  # TEM, restarts, start and end of image have no segment
    LAST = {0xD9, 0xDA}

    def __init__(self, stream: bytes) -> None:
        self.stream = stream

    def __iter__(self) -> Iterator[tuple[str, int, bytes]]:
        behind = 0
        while marker := _MARKER.search(self.stream, behind):
            code, body = marker[1][0], marker.end()
            declared = 0 if code in self.BARE else int.from_bytes(self.stream[body : body + 2], "big")
            behind = body + declared
            if code not in self.BARE and body + 2 > len(self.stream):
                return
            yield _marker_name(code), declared, self.stream[body + 2 : behind]
            if code in self.LAST:
                return


def _marker_name(code: int) -> str:
    if code in fixed.JPEG_MARKERS:
        return fixed.JPEG_MARKERS[code]
    return f"APP{code & 0x0F}" if code >> 4 == 0xE else f"0xFF{code:02X}"


def _png_segments(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    at = 8
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4:at + 8].decode("latin-1")
        yield kind, size, data[at + 8:at + 8 + size] if kind != "IDAT" else b""
        if kind == "IEND":
            return
        at += 12 + size


def _numbered_segments(data: bytes) -> list[dict]:
    """Segments of one JPEG or PNG file."""
    container, found = ("JPEG", _JpegReader(data)) if data.startswith(b"\xff\xd8") else ("PNG", _png_segments(data))
    return [{"container": container, "segment_no": n, "kind": kind, "length": size, "payload": payload} for n, (kind, size, payload) in enumerate(found)]


_SEGMENTS = T.ArrayType(T.StructType([
    T.StructField("container", T.StringType()), T.StructField("segment_no", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("length", T.IntegerType()), T.StructField("payload", T.BinaryType())]))


@F.pandas_udf(_SEGMENTS)
def _segments(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else _numbered_segments(bytes(data)))


def segment_array(content: Column) -> Column:
    """Segments of a file as an array, for use inside a larger projection.

    Only JPEG and PNG files cross to Python; pixel data does not come back.
    """
    return _segments(F.when(fx.container_type(content).isin("JPEG", "PNG"), content))


def segment_relation(df: DataFrame, segments: str = "segments", key: str = "evidence_id") -> DataFrame:
    """Segment rows (evidence_id, container, segment_no, kind, length, payload) of an array column."""
    return df.select(F.col(key).cast("string").alias("evidence_id"), F.inline_outer(segments)).where("kind IS NOT NULL")


def container_segments(files: DataFrame, key: str = "evidence_id", content: str = "content") -> DataFrame:
    """JPEG markers and PNG chunks of scanned files, one row each.

    Each file is walked once where it was read.
    """
    return segment_relation(files.select(F.col(key), segment_array(F.col(content)).alias("segments")), "segments", key)


def marker_summary(segments: DataFrame, shown: int = 12) -> DataFrame:
    """Marker count and the sequence of the first ``shown`` JPEG markers per file."""
    # number 0 is the opening marker, implied by the container and not counted
    early = F.when(F.col("segment_no").between(1, shown), F.struct("segment_no", "kind"))
    counts = segments.where(F.col("container") == "JPEG").groupBy("evidence_id").agg(
        (F.count(F.lit(1)) - 1).alias("marker_count"), F.count_if(F.col("kind") == "DQT").alias("dqt_segments"),
        F.array_sort(F.collect_list(early)).alias("_s"))  # at most ``shown`` entries
    return counts.select(
        "evidence_id", "marker_count", "dqt_segments",
        F.array_join(F.transform("_s", lambda s: s["kind"]), " → ").alias("marker_sequence"))


def quantiser_tables(segments: DataFrame) -> DataFrame:
    """Quantiser tables of the DQT segments: (evidence_id, segment_no, table_no, table_id, bits, entries).

    A DQT payload is a run of tables, each a byte of precision and id and 64 numbers of one or
    two bytes: the first byte tells where the next table begins. A table that is cut off, and
    what follows it, is left out.
    """
    byte = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("int")
    wide = lambda at: byte(at + 1, F.lit(1)) >= 16
    behind = lambda at: at + F.when(wide(at), 129).otherwise(65)
    size = F.octet_length("payload")
    # the shortest tables bound how many there can be
    starts = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(size / 65).cast("int"))), F.array(F.lit(0)),
                         lambda found, _: F.when((F.element_at(found, -1) < size) & (behind(F.element_at(found, -1)) < size), F.array_append(found, behind(F.element_at(found, -1)))).otherwise(found))
    tables = segments.where(F.col("kind") == "DQT").select("evidence_id", "segment_no", "payload", F.posexplode(starts).alias("table_no", "at")).where(
        (F.col("at") < size) & (behind(F.col("at")) <= size))
    head, width = byte(F.col("at") + 1, F.lit(1)), F.when(wide(F.col("at")), 2).otherwise(1)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: byte(F.col("at") + 2 + i * width, width))
    return tables.select("evidence_id", "segment_no", "table_no", F.pmod(head, F.lit(16)).alias("table_id"), (width * 8).alias("bits"), numbers.alias("entries"))


def _split_zero(payload: Column, part: int, charset: str) -> Column:
    """Text before (1) or after (2) the first zero byte."""
    return F.regexp_extract(F.decode(payload, charset), r"(?s)^([^\x00]*)\x00(.*)$", part)


def segment_rows(segments: DataFrame) -> DataFrame:
    """Container facts, comments, text entries and header facts as property rows.

    Segments are read several times here: finish them first.
    """
    return chunk_rows(segments).unionByName(comment_rows(segments)).unionByName(container_rows(segments))


def comment_rows(segments: DataFrame) -> DataFrame:
    """The comments of each JPEG file, numbered in order."""
    number = F.row_number().over(W.partitionBy("evidence_id").orderBy("segment_no"))
    text = tx.strip(F.make_valid_utf8(F.col("payload").cast("string")))
    found = segments.where((F.col("container") == "JPEG") & (F.col("kind") == "COM"))
    return found.select("evidence_id", F.concat(F.lit("JPEG Comment #"), number).alias("property"), text.alias("value"), F.lit("JPEG COM").alias("source"))


def container_rows(segments: DataFrame) -> DataFrame:
    """Type, markers, quantiser tables and estimated quality of each JPEG file."""
    tables = quantiser_tables(segments)
    each = tables.select(
        "evidence_id", F.concat(F.lit("Quantization Table #"), "table_id").alias("property"),
        F.format_string("Precision: %d-bit, Entries: 64", "bits").alias("value"), F.lit("JPEG DQT").alias("source"))
    n_tables = tables.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_tables"))
    comments = segments.where(F.col("kind") == "COM").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_comments"))
    files = marker_summary(segments).join(n_tables, "evidence_id", "left").join(comments, "evidence_id", "left").join(jpeg_quality(segments), "evidence_id", "left")
    known = F.col("estimated_quality").isNotNull()
    rows = [
        ("Container Type", F.lit("JPEG (ISO/IEC 10918-1)"), F.lit("JPEG Container")),
        ("Marker Count", F.col("marker_count").cast("string"), F.lit("JPEG Container")),
        ("Marker Sequence", F.col("marker_sequence"), F.lit("JPEG Container")),
        ("Quantization Tables Count", F.coalesce("n_tables", F.lit(0)).cast("string"), F.lit("JPEG Container")),
        ("Estimated Quality", F.when(known, F.concat(F.col("estimated_quality").cast("string"), F.lit("% (Estimated Property: Independent JPEG Group standard table comparison)")))
         .otherwise("Not Available (Standard luminance table not matched)"), F.when(known, "JPEG DQT (Estimation)").otherwise("JPEG DQT")),
        ("JPEG Comment", F.when(F.col("n_comments").isNull(), fixed.NOT_AVAILABLE), F.lit("JPEG COM"))]
    items = F.array(*[F.struct(F.lit(p).alias("property"), v.alias("value"), source.alias("source")) for p, v, source in rows])
    return files.select("evidence_id", F.inline(items)).where("value IS NOT NULL").unionByName(each)


def frame_sizes(segments: DataFrame) -> DataFrame:
    """Decoded size of JPEG and PNG files: (evidence_id, decoded_width, decoded_height).

    From the first frame header of a JPEG (SOF0 to SOF15 without the tables DHT, JPG and DAC)
    or the header chunk of a PNG. A JPEG whose height follows in the scan has none here.
    """
    number = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("int")
    frames = [fixed.JPEG_MARKERS.get(c, f"0xFF{c:02X}") for c in range(0xC0, 0xD0) if c not in (0xC4, 0xC8, 0xCC)]
    jpeg = (F.col("container") == "JPEG") & F.col("kind").isin(frames) & (F.octet_length("payload") >= 5)
    png = (F.col("container") == "PNG") & (F.col("kind") == "IHDR") & (F.octet_length("payload") >= 8)
    size = F.when(jpeg, F.struct(number(4, 2).alias("w"), number(2, 2).alias("h"))).when(png, F.struct(number(1, 4).alias("w"), number(5, 4).alias("h")))
    first = segments.select("evidence_id", "segment_no", size.alias("size")).where("size IS NOT NULL").groupBy("evidence_id").agg(F.min_by("size", "segment_no").alias("size"))
    return first.select("evidence_id", F.nullif("size.w", F.lit(0)).alias("decoded_width"), F.nullif("size.h", F.lit(0)).alias("decoded_height"))


def chunk_rows(segments: DataFrame) -> DataFrame:
    """Text entries and header facts of single segments; each row yields what its kind has."""
    kind, body, size = F.col("kind"), F.col("payload"), F.col("length")
    number = lambda at, n: F.conv(F.hex(F.substring(body, at, n)), 16, 10)
    colour = F.create_map(*[x for k, v in fixed.PNG_COLOUR_TYPES.items() for x in (F.lit(k), F.lit(v))])
    ctype = number(10, 1).cast("int")
    head, density = (kind == "IHDR") & (size >= 13), (kind == "pHYs") & (size >= 9)
    international = F.regexp_extract(F.decode(body, "ISO-8859-1"), r"(?s)^[^\x00]*\x00..[^\x00]*\x00[^\x00]*\x00(.*)$", 1)
    marker = F.decode(F.substring(body, 1, 5), "ISO-8859-1")
    zero_split = kind.isin("tEXt", "iTXt") & F.decode(body, "ISO-8859-1").contains("\x00")

    def row(prop: Column | str, when: Column, value: Column, source: Column | str) -> Column:
        text = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(text(prop).alias("property"), F.when(when, value).alias("value"), text(source).alias("source"))

    items = F.array(
        row(F.when(zero_split, _split_zero(body, 1, "ISO-8859-1")), zero_split,
            F.when(kind == "tEXt", _split_zero(body, 2, "ISO-8859-1"))
            .otherwise(F.make_valid_utf8(F.encode(international, "ISO-8859-1").cast("string"))), F.concat(F.lit("PNG "), kind)),
        row("Dimensions", head, F.concat(number(1, 4), F.lit(" × "), number(5, 4), F.lit(" px")), "PNG IHDR"),
        row("Bit Depth", head, F.concat(number(9, 1), F.lit("-bit")), "PNG IHDR"),
        row("Color Type", head, F.coalesce(F.try_element_at(colour, ctype), F.concat(F.lit("Type "), ctype)), "PNG IHDR"),
        row("Physical Pixel Dimensions", density, F.concat(
            number(1, 4), F.lit(" × "), number(5, 4), F.lit(" per "), F.when(number(9, 1) == "1", "meters").otherwise("unknown unit")), "PNG pHYs"),
        row("Encoding Characteristic", (kind == "APP0") & marker.startswith("JFIF"),
            F.concat(F.lit("JFIF Version "), number(6, 1), F.lit("."), F.lpad(number(7, 1), 2, "0")), "JPEG APP Marker"),
        row("Encoding Characteristic", (kind == "APP14") & (marker == "Adobe"), F.lit("Adobe APP14 Marker Present"), "JPEG APP Marker"),
    )
    return segments.select("evidence_id", F.inline(items)).where("value IS NOT NULL")


def zigzag_order() -> list[int]:
    """Natural index of each zigzag position of an 8 x 8 block."""
    return [r * 8 + c for r, c in sorted(
        ((r, c) for r in range(8) for c in range(8)),
        key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


def jpeg_quality(segments: DataFrame, reference: Sequence[int] = tuple(fixed.LUMINANCE_QUANTISER)) -> DataFrame:
    """Quality 1-100 from the luminance quantiser: (evidence_id, estimated_quality).

    The entries, stored in zigzag order, are compared with the standard table brought
    into the same order; the mean scale is inverted by the standard rule. 16-bit tables
    are read as 16-bit numbers.
    """
    first = quantiser_tables(segments.where(F.col("container") == "JPEG")).where("table_id = 0").groupBy("evidence_id").agg(F.min_by("entries", F.struct("segment_no", "table_no")).alias("t"))
    ordered = ", ".join(str(reference[i]) for i in zigzag_order())
    scaled = first.selectExpr("evidence_id", f"aggregate(zip_with(t, array({ordered}), (e, r) -> e * 100D / r), 0D, (acc, x) -> acc + x) / 64D AS scale")
    return scaled.selectExpr("evidence_id", "CAST(greatest(1D, least(100D, rint(CASE WHEN scale <= 100D THEN (200D - scale) / 2D ELSE 5000D / scale END))) AS INT) AS estimated_quality")


# --- consistency -------------------------------------------------------------
SEEN = 4 << 20  # characters of rows that a task remembers to combine equal ones


class _Held:
    """Whether a text is part of one kept so far, by an index of the runs of ``RUN`` characters.

    A text can only be part of one that has all its runs; the runs with the fewest holders
    name the candidates, which are compared in full. Texts shorter than a run have runs of
    their own length.
    """

    RUN = 4

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.holders: dict[str, array] = {}

    def keep(self, text: str) -> None:
        for size in range(1, self.RUN + 1):
            for run in {text[i : i + size] for i in range(len(text) - size + 1)}:
                held = self.holders.setdefault(run, array("q"))
                if size == self.RUN or not held:  # one holder answers for a short text
                    held.append(len(self.texts))
        self.texts.append(text)

    def __contains__(self, text: str) -> bool:
        size = min(len(text), self.RUN)
        runs = {text[i : i + size] for i in range(len(text) - size + 1)} or {""}
        rarest = min((self.holders.get(run, ()) for run in runs), key=len)
        return any(text in self.texts[i] for i in rarest)


def software_indicator_rows(props: DataFrame) -> DataFrame:
    """Software named in a file, a row each: (evidence_id, indicator_no, indicator).

    The EXIF software, the PDF creator and producer, then XMP properties whose name mentions
    creator, software or history and whose value is not already part of an earlier indicator.
    Equal rows that stand within ``SEEN`` characters of others are combined before the shuffle, as
    they come. A task reads its files' rows in order and folds them as they come; of a file it
    keeps only the indicators found. Nothing is gathered before the one shuffle, whose parts
    Spark bounds by their bytes.
    """
    p, s, v = F.col("property"), F.col("source"), F.col("value")
    rank = (F.when((s == "EXIF") & (p == "Software"), 0).when((s == "PDF Info") & (F.lower(p) == "creator"), 1)
            .when((s == "PDF Info") & (F.lower(p) == "producer"), 2)
            .when((s == "XMP") & F.lower(p).rlike("creator|software|history"), 3))
    label = (F.when(rank == 0, F.concat(F.lit("EXIF: "), v)).when(rank == 1, F.concat(F.lit("PDF Creator: "), v))
             .when(rank == 2, F.concat(F.lit("PDF Producer: "), v)).otherwise(F.concat(F.lit("XMP "), p, F.lit(": "), v)))
    named = props.where(rank.isNotNull() & (v != fixed.NOT_AVAILABLE)).select("evidence_id", rank.alias("rank"), p.alias("p"), v.alias("v"), label.alias("label"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        for batch in batches:
            new = []
            for at, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("evidence_id", "rank", "p", "v")))):
                if row not in seen:
                    new.append(at)
                    seen.add(row)
                    held += len(row[2]) + len(row[3]) + 100
                    if held > SEEN:
                        seen, held = set(), 0
            yield batch.take(pa.array(new, pa.int64()))

    ordered = named.mapInArrow(combine, named.schema).repartition("evidence_id").sortWithinPartitions("evidence_id", "rank", "p", "v")
    schema = T.StructType([props.schema["evidence_id"], T.StructField("indicator_no", T.IntegerType()), T.StructField("indicator", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, own = object(), _Held(), set()
        for batch in batches:
            out = []
            for at, (key, rank, value, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("evidence_id", "rank", "v", "label")))):
                if key != file:
                    file, held, own = key, _Held(), set()
                if label not in own if rank < 3 else value not in held:
                    out.append((at, len(held.texts), label))
                    held.keep(label)
                    if rank < 3:
                        own.add(label)
            at, numbers, labels = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("evidence_id").take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(labels, pa.string())], schema.names)

    return ordered.mapInArrow(fold, schema)


def software_indicators(props: DataFrame) -> DataFrame:
    """The indicators of each file in order: (evidence_id, software_indicators)."""
    rows = software_indicator_rows(props)
    gathered = rows.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("indicator_no", "indicator"))).alias("_all"))
    return gathered.select("evidence_id", F.col("_all.indicator").alias("software_indicators"))


def consistency(facts: DataFrame) -> DataFrame:
    """Compare what a file's sources say: adds ``flags`` and ``inconsistencies``.

    ``facts`` has one row per file: signature columns, ``exif_width``, ``exif_height``,
    ``decoded_width``, ``decoded_height``, ``exif_present``, ``gps_present``,
    ``has_thumbnail``, ``xmp_present``, ``is_pdf``, ``security_flags`` (an array) and
    ``software_indicators``, an array or the number of them.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    listed = isinstance(facts.schema["software_indicators"].dataType, T.ArrayType)
    software = F.size("software_indicators") if listed else F.col("software_indicators")
    size_differs = F.coalesce((F.col("exif_width") > 0) & (F.col("decoded_width") > 0) & (
        (F.col("exif_width") != F.col("decoded_width")) | (F.col("exif_height") != F.col("decoded_height"))), F.lit(False))
    mismatch = ~F.coalesce(F.col("is_consistent"), F.lit(True))
    flag = lambda cond, text: F.when(cond, text)
    some = yes("exif_present") | yes("xmp_present") | yes("is_pdf")
    flags = F.array(
        flag(mismatch, "FORMAT MISMATCH"), flag(size_differs, "DIMENSION DISCREPANCY"),
        flag(F.coalesce(software, F.lit(0)) > 1, "MULTIPLE SOFTWARE INDICATORS"),
        flag(yes("exif_present"), "EXIF PRESENT"), flag(yes("gps_present"), "GPS PRESENT"),
        flag(yes("has_thumbnail"), "EMBEDDED THUMBNAIL PRESENT"), flag(yes("xmp_present"), "XMP PRESENT"),
        F.when(some, "METADATA PRESENT").otherwise("NO METADATA"))
    security = F.when(yes("is_pdf"), F.coalesce("security_flags", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    dims = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" × "), F.col(b).cast("string"), F.lit(" px"))

    def issue(when, field, seen, against, source, reason):
        return F.when(when, F.struct(F.lit(field).alias("field"), seen.alias("observed_value"), against.alias("comparison_value"),
                                     F.lit(source).alias("source"), reason.alias("reason")))

    issues = F.array(
        issue(mismatch, "File Format", F.col("detected_format"), F.concat(F.lit("."), F.col("declared_ext")), "Magic Bytes vs File Extension", F.col("warning")),
        issue(size_differs, "Image Dimensions", dims("exif_width", "exif_height"), dims("decoded_width", "decoded_height"),
              "EXIF Header vs Decoded Image Stream", F.lit("EXIF recorded dimensions differ from the actual decoded raster dimensions.")))
    return facts.withColumns({
        "flags": F.array_sort(F.array_distinct(F.concat(F.array_compact(flags), security))),
        "inconsistencies": F.array_compact(issues)})


def anomalies(df: DataFrame, software: str = "software", creator: str = "creator", producer: str = "producer",
              file_type: str = "file_type", tools: Sequence[str] = tuple(fixed.EDITING_TOOLS)) -> DataFrame:
    """One row per anomaly of a file: severity, finding, tag.

    Inconsistencies (when present), the first editing tool named in the software field,
    and a PDF whose creator and producer differ.
    """
    found = F.when(F.lower(software).rlike("|".join(tools)), F.struct(
        F.lit("Medium").alias("severity"), F.concat(F.lit("Document contains editing tool signature in metadata: "), F.col(software)).alias("finding"),
        F.lit("Software").alias("tag")))
    both = (F.col(creator) != "") & (F.col(producer) != "") & (F.col(creator) != fixed.NOT_AVAILABLE)
    differ = F.when((F.col(file_type) == "PDF") & both & (F.col(creator) != F.col(producer)), F.struct(
        F.lit("Low").alias("severity"), F.concat(F.lit("PDF Creator ("), F.col(creator), F.lit(") and Producer ("), F.col(producer), F.lit(") differ.")).alias("finding"),
        F.lit("Creator/Producer").alias("tag")))
    parts = F.array(found, differ)
    if "inconsistencies" in df.columns:
        parts = F.concat(F.transform("inconsistencies", lambda i: F.struct(
            F.when(i["reason"].contains("FORMAT") | i["reason"].contains("DIMENSION"), "High").otherwise("Medium").alias("severity"),
            F.concat(i["field"], F.lit(": "), i["reason"]).alias("finding"), i["source"].alias("tag"))), parts)
    kept = [c for c in df.columns if c != "inconsistencies"]
    return df.select(*kept, F.inline(F.array_compact(parts)))


def observed_timeline(props: DataFrame) -> DataFrame:
    """Every timestamp of a file in source order, numbered: filesystem, EXIF, PDF, XMP."""
    p, s = F.col("property"), F.col("source")
    exif = p.isin("DateTime", "DateTimeOriginal", "DateTimeDigitized")
    rank = (F.when((s == "Filesystem") & p.contains("Time"), 0).when((s == "EXIF") & exif, 1)
            .when((s == "PDF Info") & p.isin("CreationDate", "ModDate"), 2)
            .when((s == "XMP") & F.lower(p).rlike("date|time"), 3))
    shown = F.when(rank == 1, F.concat(F.col("value"), F.lit(" (Timezone: Not encoded / Unknown)"))).otherwise(F.col("value"))
    marks = props.select("evidence_id", s.alias("source"), p.alias("event"), shown.alias("timestamp_str"), rank.alias("_rank")).where("_rank IS NOT NULL")
    return number_rows(marks, ["evidence_id"], ["_rank", "event", "timestamp_str"]).drop("_rank")


def examination_summary(props: DataFrame) -> DataFrame:
    """Status and presence of each metadata source per file, from its property rows.

    Rows that only report an absence (property ending in "Status") do not count.
    """
    real = ~F.col("property").endswith("Status")
    has = lambda *sources: F.coalesce(F.bool_or(real & F.col("source").isin(*sources)), F.lit(False))
    word = lambda c: F.when(F.col(c), "Present").otherwise(fixed.NOT_AVAILABLE).alias(f"{c}_present")
    seen = props.groupBy("evidence_id").agg(
        has("EXIF").alias("exif"), has("XMP").alias("xmp"), has("IPTC / IIM").alias("iptc"), has("PDF Info").alias("pdf"),
        F.coalesce(F.bool_or((F.col("source") == "EXIF GPS") & (F.col("property") == "GPS Present") & (F.col("value") == "YES")), F.lit(False)).alias("gps"))
    status = F.when(F.col("exif") | F.col("xmp") | F.col("pdf"), "PRESENT").otherwise("LIMITED")
    return seen.select("evidence_id", status.alias("metadata_status"), word("exif"), word("xmp"), word("iptc"), word("gps"))


# --- pages -------------------------------------------------------------------
def classify_pages(pages: DataFrame, text: str = "text", images: str = "image_count") -> DataFrame:
    """Content class of each page: BOTH, TEXT, IMAGE or BLANK."""
    has_text, has_image = ~tx.is_blank(F.col(text)), F.col(images) > 0
    return pages.withColumn("classification", F.when(has_text & has_image, "BOTH").when(has_text, "TEXT").when(has_image, "IMAGE").otherwise("BLANK"))


def page_class_counts(classified: DataFrame, keys: Sequence[str], page: str = "page_number", max_pages: int | None = None) -> DataFrame:
    """Text and raster pages per document; ``max_pages`` looks at the leading ones only."""
    use = classified if max_pages is None else classified.where(F.col(page) <= max_pages)
    c = F.col("classification")
    return use.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages_examined"), F.count_if(c.isin("TEXT", "BOTH")).alias("text_pages"),
                                  F.count_if(c.isin("IMAGE", "BOTH")).alias("raster_pages"))


def native_text(pages: DataFrame, keys: Sequence[str], page: str = "page_number", text: str = "text") -> DataFrame:
    """Document text with a caption line before each page that has text."""
    from vellumine.operators.runs import assemble_documents

    body = tx.strip(F.col(text))
    caption = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" Native Text ---\n"))
    captioned = pages.select(*keys, page, F.when(body != "", F.concat(caption, body)).otherwise("").alias(text))
    return assemble_documents(captioned, keys, page, text, separator="\n\n").select(*keys, F.col("total_text").alias("native_text"))


def active_content(content: Column, attachments: str = r"/EmbeddedFiles?\b", scripts: str = r"/(JavaScript|JS)\b") -> Column:
    """Flags for attachments and scripts found as byte patterns (array of strings).

    Sees uncompressed objects only.
    """
    body = fx.latin1(content.cast("binary"))
    return F.array_compact(F.array(F.when(body.rlike(attachments), "EMBEDDED FILE PRESENT"), F.when(body.rlike(scripts), "PDF JAVASCRIPT PRESENT")))


# --- routing and derivatives -------------------------------------------------
def route_rows(props: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Category of each property row: EXIF, XMP, IPTC, PDF, FILE, CONTAINER.

    With ``formats`` (evidence_id, detected_format) container rows of another format
    than the detected one are left out.
    """
    s = F.col("source")
    family = F.split_part(s, F.lit(" "), F.lit(1))
    container = family.isin("JPEG", "PNG", "TIFF", "WebP")
    category = (F.when(s.startswith("EXIF"), "EXIF").when(s == "XMP", "XMP").when(s.startswith("IPTC"), "IPTC")
                .when(s.startswith("PDF"), "PDF").when(container, "CONTAINER").otherwise("FILE"))
    out = props.withColumn("category", category)
    if formats is None:
        return out
    matched = out.join(formats.select("evidence_id", "detected_format"), "evidence_id", "left")
    right = F.upper(F.col("detected_format")).startswith(F.upper(family))
    return matched.where((F.col("category") != "CONTAINER") | F.coalesce(right, F.lit(False))).drop("detected_format")


def sanitise(props: DataFrame, descriptive: Sequence[str] = tuple(fixed.DESCRIPTIVE_PROPERTIES)) -> DataFrame:
    """Property rows of a sanitised derivative: descriptive properties removed."""
    return props.where(~F.col("property").isin(list(descriptive)) & ~F.col("source").isin("XMP", "EXIF GPS", "IPTC / IIM"))


def write_sanitised(props: DataFrame, source_path: str, target_path: str) -> None:
    """Write the derivative beside the original; the original is never rewritten."""
    if source_path.rstrip("/") == target_path.rstrip("/"):
        raise ValueError("Refusing to sanitise in place: original evidence must remain immutable.")
    sanitise(props).write.mode("errorifexists").parquet(target_path)


# Which property supplies a fact, most trusted first.
FACT_PRIORITY = {
    "creation_date": ["DateTime", "DateTimeOriginal", "DateTimeDigitized", "CreationDate", "File Modified Time"],
    "author": ["Artist", "Copyright", "Author"],
    "software": ["Software", "Producer", "Creator"],
    "exif_width": ["PixelXDimension", "ImageWidth"],
    "exif_height": ["PixelYDimension", "ImageLength"],
    "camera_make": ["Make"],
    "camera_model": ["Model"],
}


def file_facts(props: DataFrame, priority: dict[str, list[str]] | None = None) -> DataFrame:
    """One facts row per file, each fact from its most trusted property.

    The pivot keeps one value per file and property (the least), combined map-side.
    """
    wanted = FACT_PRIORITY if priority is None else priority
    names = list(dict.fromkeys(p for ps in wanted.values() for p in ps))
    wide = props.where(F.col("property").isin(names)).groupBy("evidence_id").agg(
        *[F.min(F.when(F.col("property") == p, F.nullif("value", F.lit(fixed.NOT_AVAILABLE)))).alias(f"_{i}") for i, p in enumerate(names)])
    at = {p: F.col(f"_{i}") for i, p in enumerate(names)}
    return wide.select("evidence_id", *[F.coalesce(*[at[p] for p in ps]).alias(fact) for fact, ps in wanted.items()])


def examine(files: DataFrame) -> DataFrame:
    """Signature, digests, packet and active content of every file in one projection."""
    from vellumine.operators.integrity import digests

    seen = digests(signature(files))
    return with_xmp_packet(seen).withColumns({
        "security_flags": active_content(F.col("content")), "is_pdf": F.col("detected_format") == "PDF"})
