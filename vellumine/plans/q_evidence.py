"""Files, metadata, sinks, findings, audit rate and slots over the test tables.

Web pages and documents play the part of evidence files: paths, sizes, container bytes
and XMP packets are built from their columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import files as fx, fixed
from vellumine.functions.once import compute_once
from vellumine.operators import findings as fi, metadata as md, raster as ra, runs as rn, slots
from vellumine.plans.q_raster import ALL_COLOUR, TILES_SQL, colour_samples, tiles
from vellumine.plans.registry import query, table
from vellumine.session import cut_lineage
from vellumine.sources import files as sf, sinks
from vellumine.streaming.jobs import audit_rate

EXT = ["jpg", "JPEG", "png", "tiff", "tif", "bmp", "webp", "pdf", "docx", "txt"]
EXT_SPARK = "get(array(" + ", ".join(f"'{e}'" for e in EXT) + "), CAST(doc_id % 10 AS INT))"
EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXT) + "][doc_id % 10 + 1]"


def files(spark, d):
    """Documents as listed files: path, length and modification time."""
    return table(spark, d, "documents").selectExpr(
        "doc_id", f"concat('/evidence/', source, '/item.', doc_id, '.', {EXT_SPARK}) AS path", "CAST(octet_length(text) AS BIGINT) AS length",
        "timestamp_seconds(1700000000 + doc_id) AS modificationTime", "lang", "text")


FILES_SQL = f"""files AS (SELECT doc_id, source, '/evidence/' || source || '/item.' || doc_id || '.' || {EXT_SQL} AS path, {EXT_SQL} AS ext,
  strlen(text)::BIGINT AS length, lang, text FROM documents)"""
SUPPORTED = "lower(ext) IN ('jpg', 'jpeg', 'png', 'tiff', 'tif', 'bmp', 'webp', 'pdf')"
SIZE_SQL = """CASE WHEN length < 1024 THEN printf('%d B', length) WHEN length < 1048576 THEN printf('%.1f KB', length / 1024.0::DOUBLE) ELSE printf('%.2f MB', length / 1048576.0::DOUBLE) END"""
EXACT_SQL = """CASE WHEN length >= 1048576 THEN printf('%.2f MB', length / 1048576.0::DOUBLE) || ' (' || format('{:,}', length) || ' bytes)'
  WHEN length >= 1024 THEN printf('%.2f KB', length / 1024.0::DOUBLE) || ' (' || format('{:,}', length) || ' bytes)' ELSE printf('%d bytes', length) END"""
SHOWN_SQL = "strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' IST (UTC+05:30)'"


@query("s01_supported_scan", f"WITH {FILES_SQL} SELECT path, length FROM files WHERE {SUPPORTED}")
def s01(spark, d):
    return files(spark, d).where(fx.is_supported(F.col("path"))).select("path", "length")


@query("s02_file_facts", f"""WITH {FILES_SQL} SELECT path, 'item.' || doc_id || '.' || ext AS file_name, upper(ext) AS file_type, length AS file_size,
  CASE lower(ext) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'tiff' THEN 'image/tiff' WHEN 'tif' THEN 'image/tiff'
    WHEN 'bmp' THEN 'image/bmp' WHEN 'webp' THEN 'image/webp' WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' ELSE 'Unknown' END AS mime_type FROM files""")
def s02(spark, d):
    return sf.file_facts(files(spark, d)).select("path", "file_name", "file_type", "file_size", "mime_type")


@query("s04_sample_scan", f"WITH {TILES_SQL} SELECT image_id::VARCHAR AS image_id, y, x, v FROM px")
def s04(spark, d):
    """Bytes to samples: the tile is packed to bytes as an image source delivers them."""
    packed = tiles(spark, d).selectExpr(
        "CAST(image_id AS STRING) AS image_id", "height", "width", "1 AS nChannels",
        "unhex(array_join(transform(px, v -> lpad(hex(v), 2, '0')), '')) AS data")
    return ra.pixels(sf.samples_from_bytes(packed)).select("image_id", "y", "x", "v")


@query("s05_evidence_table", """SELECT 'CASE-' || source AS case_id, printf('EVD-%06d', doc_id) AS evidence_id, n_chars AS file_size, 'Pending' AS status, 1 AS page_count FROM documents""")
def s05(spark, d):
    from vellumine.schemas import EVIDENCE, DEFAULTS
    from vellumine.sources.tables import with_defaults
    raw = table(spark, d, "documents").select(F.concat(F.lit("CASE-"), "source").alias("case_id"), F.format_string("EVD-%06d", "doc_id").alias("evidence_id"),
                                              F.col("n_chars").alias("file_size"))
    full = with_defaults(raw, {f: None for f in EVIDENCE.fieldNames() if f not in raw.columns})
    shaped = with_defaults(full, DEFAULTS["evidence_items"]).select(*[F.col(f.name).cast(f.dataType) for f in EVIDENCE.fields])
    return shaped.select("case_id", "evidence_id", "file_size", "status", "page_count")


@query("s05_rewritten_table", """SELECT 'CASE-' || source AS case_id, printf('EVD-%06d', doc_id) AS evidence_id, n_chars + (doc_id % 10 = 0)::INT AS file_size,
  CASE WHEN doc_id % 10 = 0 THEN 'REVIEWED' ELSE 'Pending' END AS status FROM documents WHERE lang IS DISTINCT FROM 'fr' OR doc_id % 10 = 0
UNION ALL SELECT 'CASE-new', printf('EVD-%06d', doc_id), 0, 'Pending' FROM documents WHERE lang = 'fr' AND doc_id % 10 <> 0""")
def s05_rewritten(spark, d):
    """Appended in two batches to folders that split as they grow; a tenth of the items is
    replaced by key, a case is deleted and its other items registered anew."""
    import uuid

    from vellumine.session import ensure_checkpoint_dir
    from vellumine.sources.tables import EvidenceTables

    docs = table(spark, d, "documents").select(
        F.concat(F.lit("CASE-"), F.when((F.col("lang") == "fr") & (F.col("doc_id") % 10 != 0), "gone").otherwise(F.col("source"))).alias("case_id"),
        F.format_string("EVD-%06d", "doc_id").alias("evidence_id"), F.col("n_chars").alias("file_size"), "doc_id")
    t = EvidenceTables(spark, f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", buckets=8, folder_rows=64)
    t.append("evidence_items", docs.where("doc_id % 2 = 0"))
    t.append("evidence_items", docs.where("doc_id % 2 = 1"))
    t.replace("evidence_items", docs.where("doc_id % 10 = 0").withColumns({"file_size": F.col("file_size") + 1, "status": F.lit("REVIEWED")}), ["case_id", "evidence_id"])
    gone = t.read_case("evidence_items", "CASE-gone").select("evidence_id").withColumn("case_id", F.lit("CASE-new"))
    t.append("evidence_items", gone)
    t.delete_cases(spark.createDataFrame([("CASE-gone",)], "case_id string"), ["evidence_items"])
    return t.read("evidence_items").select("case_id", "evidence_id", "file_size", "status")


@query("s07_histogram_csv", f"""WITH {ALL_COLOUR}
SELECT image_id, v AS "Intensity", count(*) FILTER (ch = 'R') AS "Red_Count", count(*) FILTER (ch = 'G') AS "Green_Count",
  count(*) FILTER (ch = 'B') AS "Blue_Count", count(*) FILTER (ch = 'GRAY') AS "Grayscale_Count" FROM allpx GROUP BY 1, 2""")
def s07(spark, d):
    return sinks.histogram_table(colour_samples(spark, d).selectExpr("image_id", "ch", "v AS bin", "1L AS n"))


@query("s08_result_json", """
SELECT conv_id, '{"conv_id":' || conv_id || ',"n_pages":' || count(*) || ',"pages":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","n_chars":' || length(text) || '}', ',' ORDER BY turn) || ']}' AS record
FROM conversations GROUP BY conv_id""")
def s08(spark, d):
    c = table(spark, d, "conversations")
    pages = c.select("conv_id", "turn", "role", F.char_length("text").alias("n_chars"), F.col("text").cast("binary").alias("thumbnail"))
    docs = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pages"))
    out = sinks.document_json(docs, pages, "conv_id", "turn")
    return out.select("conv_id", F.to_json(F.struct("conv_id", "n_pages", "pages")).alias("record"))


RULE_SQL, THIN_SQL = f"'{sinks.RULE}'", f"'{sinks.THIN}'"


@query("s09_text_report", f"""WITH d AS (SELECT conv_id, CASE WHEN conv_id % 5 > 0 THEN (sum(length(text)) % 100)::DOUBLE END AS conf, count(*) AS n,
  ['INTEGRITY VERIFIED', 'INTEGRITY CHANGED', NULL][conv_id % 3 + 1] AS state, conv_id % 4 = 0 AS agreed FROM conversations GROUP BY 1),
l AS (SELECT conv_id, list_filter([{RULE_SQL}, '                    FORENSIC REPORT', {RULE_SQL}, '', '1. CASE DETAILS', {THIN_SQL}, 'Case ID:        C' || conv_id % 7, 'Case Name:      Name', 'Status:         OPEN', 'Examiner:       Examiner',
  'Organization:   Lab ' || conv_id % 2, 'Date:           Not Available', CASE WHEN conv_id % 2 = 0 THEN 'Created (IST): ' || strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(conv_id) + INTERVAL 330 MINUTE, ' %Y-%m-%d %H:%M:%S') || ' IST (UTC+05:30)' END,
  'Ref Number:     R-' || conv_id, '', '2. EVIDENCE DETAILS', {THIN_SQL}, 'Evidence ID:    ' || conv_id, 'Name:           item', 'File Path:      /f', 'SHA-256 Hash:   ab', 'Type:           PDF', '', '3. ANALYSIS COVERAGE', {THIN_SQL},
  'OCR:            ' || CASE WHEN conf IS NULL THEN 'Not Performed' ELSE 'Completed' END, 'Image Quality:  ' || CASE WHEN conf IS NULL THEN 'Not Performed' ELSE 'Checked' END,
  'Hash:           ' || CASE state WHEN 'INTEGRITY VERIFIED' THEN 'Verified' WHEN 'INTEGRITY CHANGED' THEN 'Changed' ELSE 'Not Verified' END, '', '4. FORENSIC EXAMINATION MATRIX', {THIN_SQL},
  CASE WHEN conf IS NULL THEN 'No OCR or Examination Data available for this evidence.' END, CASE WHEN conf >= 0 THEN 'Analysis             | Status     | Result' END, CASE WHEN conf >= 0 THEN repeat('-', 65) END,
  CASE WHEN conf >= 0 THEN 'Evidence Integrity   | ' || CASE state WHEN 'INTEGRITY VERIFIED' THEN 'CONFIRMED  | SHA-256 verified' WHEN 'INTEGRITY CHANGED' THEN 'FAILED     | SHA-256 differs from the record' ELSE 'UNCERTAIN  | Not verified' END END,
  CASE WHEN conf >= 0 THEN 'Script Detection     | LIKELY     | Latin' END, CASE WHEN conf >= 0 THEN 'Language ID          | LIKELY     | English' END, CASE WHEN conf >= 0 THEN 'Primary OCR          | COMPLETED  | ' || printf('%.1f%%', conf) END,
  CASE WHEN conf >= 0 THEN 'Engine Disagreement  | ' || CASE WHEN agreed THEN 'CONFIRMED  | Runs agree' ELSE 'UNCERTAIN  | Review Required' END END, CASE WHEN conf >= 0 THEN 'OCR Regions          | COMPLETED  | ' || n || ' words' END, '',
  '5. CONCLUSION', {THIN_SQL}, CASE WHEN conf IS NULL THEN '{rn.CONCLUSION_NONE}' WHEN conf < 50 THEN '{rn.CONCLUSION_LOW}' ELSE '{rn.CONCLUSION_OK}' END, '', {RULE_SQL}, 'Report Generated At: 2026-01-02 03:04:05', {RULE_SQL}], lambda t: t IS NOT NULL) AS lines FROM d)
SELECT conv_id AS evidence_id, unnest(range(len(lines)))::INT AS line_no, unnest(lines) AS text FROM l""")
def s09(spark, d):
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("evidence_id")).agg(
        (F.sum(F.char_length("text")) % 100).cast("double").alias("overall_confidence"), F.count(F.lit(1)).alias("total_words"))
    n = F.col("evidence_id")
    full = docs.withColumns({
        "overall_confidence": F.when(n % 5 > 0, F.col("overall_confidence")), "case_id": F.concat(F.lit("C"), n % 7), "case_name": F.lit("Name"), "case_status": F.lit("OPEN"), "examiner": F.lit("Examiner"),
        "organization": F.concat(F.lit("Lab "), n % 2), "date": F.lit(None).cast("string"), "created_at": F.when(n % 2 == 0, F.timestamp_seconds(F.lit(1700000000) + n)),
        "reference_number": F.concat(F.lit("R-"), n), "name": F.lit("item"), "file_path": F.lit("/f"), "sha256": F.lit("ab"), "evidence_type": F.lit("PDF"), "overall_script": F.lit("Latin"), "overall_language": F.lit("English"),
        "integrity_status": F.get(F.array(F.lit("INTEGRITY VERIFIED"), F.lit("INTEGRITY CHANGED"), F.lit(None)), (n % 3).cast("int")), "manual_review": F.when(n % 4 == 0, "Not Required").otherwise("Required")})
    return sinks.case_report(full, generated_at=F.to_timestamp(F.lit("2026-01-02 03:04:05")))


@query("s09_metadata_report", """
WITH d AS (SELECT doc_id, doc_id % 4 = 1 AS exif, lang = 'fr' AS odd, doc_id || CASE lang WHEN 'fr' THEN '.jpg' ELSE '.png' END AS path, n_chars, n_chars <> 7 AND doc_id % 4 = 1 AS differs FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT path AS evidence_id, 45 + 6 * (exif::INT) + 2 + 3 * ((odd OR differs)::INT) + 6 * (odd::INT + differs::INT) + 5 * (exif::INT) AS n_lines,
  concat_ws(', ', CASE WHEN differs THEN 'DIMENSION DISCREPANCY' END, CASE WHEN exif THEN 'EXIF PRESENT' END, CASE WHEN odd THEN 'FORMAT MISMATCH' END, CASE WHEN exif THEN 'METADATA PRESENT' ELSE 'NO METADATA' END) AS flags,
  odd AS told_format, differs AS told_size FROM d""")
def s09_metadata(spark, d):
    from vellumine.plans import flows

    docs = sf.spread(table(spark, d, "documents")).where("lang IS NOT NULL AND source IS NOT NULL")
    made = compute_once(docs, {
        "path": "concat(doc_id, CASE lang WHEN 'fr' THEN '.jpg' ELSE '.png' END)", "content": PNG_SPARK, "length": "CAST(n_chars AS BIGINT)", "modificationTime": "timestamp_seconds(1700000000 + doc_id)"})
    exif = made.where("doc_id % 4 = 1").select(F.col("path").alias("evidence_id"), F.inline(F.array(*[
        F.struct(F.lit(p).alias("property"), F.lit(v).alias("value"), F.lit("EXIF").alias("source")) for p, v in (("PixelXDimension", "7"), ("PixelYDimension", "16"), ("Make", "x"), ("Model", "y"), ("Orientation", "1"))])))
    found = flows.metadata_examination(made.select("path", "content", "length", "modificationTime"), exif)
    lines = sinks.examination_report(found["properties"], found["facts"], found["summary"])
    return lines.groupBy("evidence_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_lines"), F.max(F.regexp_extract("text", "^Forensic Flags: (.*)$", 1)).alias("flags"),
        F.bool_or(F.col("text") == "• Field: File Format").alias("told_format"), F.bool_or(F.col("text") == "• Field: Image Dimensions").alias("told_size"))


# --- metadata ----------------------------------------------------------------
MAGIC = [("FFD8FFE0", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("255044462D", "PDF"), ("49492A00", "TIFF (Little Endian)"), ("4D4D002A", "TIFF (Big Endian)"),
         ("524946460000000057454250", "WEBP"), ("424D", "BMP"), ("474946383961", "GIF"), ("", "UNKNOWN")]
MAGIC_SPARK = "unhex(get(array(" + ", ".join(f"'{m}'" for m, _ in MAGIC) + "), CAST(doc_id % 9 AS INT)))"
FORMAT_SQL = "[" + ", ".join(f"'{f}'" for _, f in MAGIC) + "][doc_id % 9 + 1]"
MAGIC_SQL = "[" + ", ".join(f"'{m}'" for m, _ in MAGIC) + "][doc_id % 9 + 1]"


def carriers(spark, d):
    """Documents behind the leading bytes of nine containers."""
    named = files(spark, d).selectExpr("doc_id", "CAST(doc_id AS STRING) AS evidence_id", "path", "text")
    return compute_once(named, {"content": f"concat({MAGIC_SPARK}, CAST(concat('|', text) AS BINARY))"}, drop=("text",))


CARRIER_SQL = f"""{FILES_SQL}, carried AS (SELECT doc_id, upper(ext) AS declared_ext, {FORMAT_SQL} AS detected_format,
  substr({MAGIC_SQL} || hex(encode('|' || text)), 1, 16) AS magic_hex FROM files),
signed AS (SELECT *, detected_format = 'UNKNOWN' OR split_part(detected_format, ' ', 1) = CASE declared_ext WHEN 'JPG' THEN 'JPEG' WHEN 'TIF' THEN 'TIFF' ELSE declared_ext END AS is_consistent FROM carried)"""


@query("m01_signature", f"WITH {CARRIER_SQL} SELECT doc_id, detected_format, magic_hex FROM signed")
def m01(spark, d):
    return md.signature(carriers(spark, d)).select("doc_id", "detected_format", "magic_hex")


@query("m02_declared_format", f"""WITH {CARRIER_SQL} SELECT doc_id, declared_ext, is_consistent, CASE WHEN is_consistent THEN '' ELSE
  'FORMAT MISMATCH: Declared extension ''.' || declared_ext || ''' disagrees with detected container ''' || detected_format || ''' (Magic: ' || substr(magic_hex, 1, 8) || ').' END AS warning FROM signed""")
def m02(spark, d):
    return md.signature(carriers(spark, d)).select("doc_id", "declared_ext", "is_consistent", "warning")


@query("m03_filesystem_rows", f"""WITH {FILES_SQL}
SELECT doc_id AS evidence_id, 'File Name' AS property, 'item.' || doc_id || '.' || ext AS value FROM files UNION ALL SELECT doc_id, 'File Extension', '.' || ext FROM files
UNION ALL SELECT doc_id, 'Absolute Path', path FROM files UNION ALL SELECT doc_id, 'File Size', {EXACT_SQL} FROM files UNION ALL SELECT doc_id, 'File Modified Time', {SHOWN_SQL} FROM files""")
def m03(spark, d):
    listed = files(spark, d).withColumnRenamed("doc_id", "evidence_id")
    return md.filesystem_rows(listed).select("evidence_id", "property", "value")


PACKET_SPARK = """concat('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf xmlns:dc="http://purl.org/dc/elements/1.1/" about="', doc_id, '"><dc:language>', lang,
  '</dc:language><dc:title>Ünit ', doc_id, '</dc:title><dc:title>again</dc:title><CreatorTool>Tool ', n_chars, '</CreatorTool></rdf></x:xmpmeta>')"""
PACKET_SQL = """'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf xmlns:dc="http://purl.org/dc/elements/1.1/" about="' || doc_id || '"><dc:language>' || lang ||
  '</dc:language><dc:title>Ünit ' || doc_id || '</dc:title><dc:title>again</dc:title><CreatorTool>Tool ' || n_chars || '</CreatorTool></rdf></x:xmpmeta>'"""


def xmp_carriers(spark, d):
    docs = table(spark, d, "documents")
    named = sf.spread(docs.selectExpr("doc_id", "CAST(doc_id AS STRING) AS evidence_id", "lang", "n_chars", "text"))
    return compute_once(named, {"content": f"CAST(concat(text, {PACKET_SPARK}, text) AS BINARY)"}, drop=("text", "lang", "n_chars"))


@query("m04_xmp_packet", f"SELECT doc_id, {PACKET_SQL} AS packet FROM documents")
def m04(spark, d):
    return md.with_xmp_packet(xmp_carriers(spark, d)).select("doc_id", "packet")


@query("m05_xmp_rows", """
SELECT doc_id::VARCHAR AS evidence_id, 'elements:language' AS property, lang AS value FROM documents WHERE false
UNION ALL SELECT doc_id::VARCHAR, '1.1:language', lang FROM documents UNION ALL SELECT doc_id::VARCHAR, '1.1:title', 'Ünit ' || doc_id FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'CreatorTool', 'Tool ' || n_chars FROM documents UNION ALL SELECT doc_id::VARCHAR, 'rdf@about', doc_id::VARCHAR FROM documents""")
def m05(spark, d):
    return md.xmp_rows(md.with_xmp_packet(xmp_carriers(spark, d))).select("evidence_id", "property", "value")


@query("m06_flatten_json", """
SELECT event_id AS evidence_id, 'a:k' AS property, (props->>'$.k') AS value FROM events
UNION ALL SELECT event_id, 'list[0]', event_type FROM events UNION ALL SELECT event_id, 'list[1]:v', user_id::VARCHAR FROM events
UNION ALL SELECT event_id, 'list[1]:w[0]', 'x' FROM events""")
def m06(spark, d):
    nested = table(spark, d, "events").selectExpr(
        "event_id", """concat('{"a":', props, ',"list":["', event_type, '",{"v":', user_id, ',"w":["x"]}],"blank":" "}') AS j""")
    return md.flatten_json(nested, "event_id", "j").select("evidence_id", "property", "value")


def png_chunk(kind, body):
    """SQL: one PNG chunk around a binary expression (a checksum of zero is fine: it is not read)."""
    return f"unhex(lpad(hex(length({body})), 8, '0')), CAST('{kind}' AS BINARY), {body}, unhex('00000000')"


PNG_SPARK = ("concat(unhex('89504E470D0A1A0A'), " + png_chunk("IHDR", "unhex(concat(lpad(hex(n_chars), 8, '0'), '00000010', '0802000000'))") + ", "
             + png_chunk("tEXt", "CAST(concat('Description', chr(0), lang, ' ', source) AS BINARY)") + ", "
             + png_chunk("IDAT", "CAST(text AS BINARY)") + ", " + png_chunk("tEXt", "CAST(concat('Author', chr(0), doc_id) AS BINARY)") + ", "
             + png_chunk("IEND", "unhex('')") + ")")


def pngs(spark, d):
    docs = sf.spread(table(spark, d, "documents")).withColumn("evidence_id", F.col("doc_id").cast("string"))
    return compute_once(docs, {"content": PNG_SPARK}).select("evidence_id", "content")


@query("m07_png_chunks", """
SELECT doc_id::VARCHAR AS evidence_id, unnest([0, 1, 2, 3, 4]) AS segment_no, unnest(['IHDR', 'tEXt', 'IDAT', 'tEXt', 'IEND']) AS kind,
  unnest([13, 12 + strlen(lang) + 1 + strlen(source), strlen(text), 7 + length(doc_id::VARCHAR), 0])::INT AS length FROM documents""")
def m07(spark, d):
    return md.container_segments(pngs(spark, d)).select("evidence_id", "segment_no", "kind", "length")


@query("m07_png_properties", """
SELECT doc_id::VARCHAR AS evidence_id, 'Dimensions' AS property, n_chars || ' × 16 px' AS value, 'PNG IHDR' AS source FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'Bit Depth', '8-bit', 'PNG IHDR' FROM documents UNION ALL SELECT doc_id::VARCHAR, 'Color Type', 'RGB', 'PNG IHDR' FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'Description', lang || ' ' || source, 'PNG tEXt' FROM documents UNION ALL SELECT doc_id::VARCHAR, 'Author', doc_id::VARCHAR, 'PNG tEXt' FROM documents""")
def m07_properties(spark, d):
    return md.segment_rows(md.container_segments(pngs(spark, d)))


# A JPEG head per tile: comment and a luminance quantiser scaled from the standard one.
def jpegs(spark, d):
    zig = ", ".join(str(fixed.LUMINANCE_QUANTISER[i]) for i in md.zigzag_order())
    scaled = f"transform(array({zig}), q -> least(255, greatest(1, (q * (10 + label * 15) + 50) DIV 100)))"
    body = f"array_join(transform({scaled}, v -> lpad(hex(v), 2, '0')), '')"
    named = tiles(spark, d).selectExpr("image_id", "CAST(image_id AS STRING) AS evidence_id", "label")
    return compute_once(named, {"content": (
        f"""concat(unhex('FFD8FFE000104A46494600010200000100010000'), unhex('FFFE'), unhex(lpad(hex(length(CAST(image_id AS STRING)) + 8), 4, '0')),
          CAST(concat('note ', image_id, ' ') AS BINARY), unhex(concat('FFDB004300', {body})), unhex('FFC0000408080808'), unhex('FFD9'))""")}, drop=("image_id",))


@query("m07_jpeg_markers", """
SELECT vec_id::VARCHAR AS evidence_id, 5::BIGINT AS marker_count, 1::BIGINT AS dqt_segments, 'APP0 → COM → DQT → SOF0 → EOI' AS marker_sequence FROM embeddings""")
def m07_jpeg(spark, d):
    return md.marker_summary(md.container_segments(jpegs(spark, d)))


# A whole JPEG head per document: two tables of which one may have 16 bits, a frame whose size is
# not that of the EXIF rows for every fourth document, comments and a scan.
def framed_jpegs(spark, d):
    docs = sf.spread(table(spark, d, "documents"))
    hex2 = lambda e, n=2: f"lpad(hex({e}), {n}, '0')"
    deep = "doc_id % 3 = 0"
    return compute_once(docs, {"path": "concat(doc_id, '.jpg')", "length": "CAST(n_chars AS BIGINT)", "modificationTime": "timestamp_seconds(1700000000 + doc_id)", "content": f"""concat(
      unhex('FFD8FFE000104A46494600010100000100010000FFEE000E41646F626500640000000000'), unhex(concat('FFFE', {hex2("octet_length(lang) + 2", 4)})), CAST(lang AS BINARY),
      unhex(concat('FFFFFFFE', {hex2("octet_length(source) + 2", 4)})), CAST(source AS BINARY),
      unhex(concat('FFDB', IF({deep}, '00C4', '0084'), '00', repeat({hex2("1 + doc_id % 200")}, 64), IF({deep}, concat('11', repeat('0102', 64)), concat('01', repeat('03', 64))))),
      unhex(concat('FFC2000B08', {hex2("1 + doc_id % 500", 4)}, {hex2("7 + doc_id % 2", 4)}, '01011100', 'FFDA0008010100003F00')), CAST(text AS BINARY), unhex('FFD9'))"""})


@query("m07_jpeg_container", """
WITH d AS (SELECT *, doc_id::VARCHAR AS evidence_id, 3 * (doc_id % 3 = 0)::INT AS deep, 1 + doc_id % 200 AS q FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
s AS (SELECT d.*, avg_of.per * q AS scale FROM d, (SELECT avg(100.0::DOUBLE / v) AS per FROM (SELECT unnest(QUANTISER) AS v)) avg_of)
SELECT evidence_id, 'Container Type' AS property, 'JPEG (ISO/IEC 10918-1)' AS value, 'JPEG Container' AS source FROM d UNION ALL SELECT evidence_id, 'Marker Count', '7', 'JPEG Container' FROM d
UNION ALL SELECT evidence_id, 'Marker Sequence', 'APP0 → APP14 → COM → COM → DQT → SOF2 → SOS', 'JPEG Container' FROM d UNION ALL SELECT evidence_id, 'Quantization Tables Count', '2', 'JPEG Container' FROM d
UNION ALL SELECT evidence_id, 'Quantization Table #0', 'Precision: 8-bit, Entries: 64', 'JPEG DQT' FROM d
UNION ALL SELECT evidence_id, 'Quantization Table #1', CASE deep WHEN 0 THEN 'Precision: 8-bit, Entries: 64' ELSE 'Precision: 16-bit, Entries: 64' END, 'JPEG DQT' FROM d
UNION ALL SELECT evidence_id, 'Estimated Quality', greatest(1, least(100, round_even(CASE WHEN scale <= 100 THEN (200 - scale) / 2 ELSE 5000 / scale END, 0)))::INT
  || '% (Estimated Property: Independent JPEG Group standard table comparison)', 'JPEG DQT (Estimation)' FROM s
UNION ALL SELECT evidence_id, 'JPEG Comment #1', trim(lang), 'JPEG COM' FROM d UNION ALL SELECT evidence_id, 'JPEG Comment #2', trim(source), 'JPEG COM' FROM d
UNION ALL SELECT evidence_id, 'Encoding Characteristic', 'JFIF Version 1.01', 'JPEG APP Marker' FROM d UNION ALL SELECT evidence_id, 'Encoding Characteristic', 'Adobe APP14 Marker Present', 'JPEG APP Marker' FROM d
""".replace("QUANTISER", str(fixed.LUMINANCE_QUANTISER)))
def m07_container(spark, d):
    files = framed_jpegs(spark, d).where("lang IS NOT NULL AND source IS NOT NULL").withColumn("evidence_id", F.col("doc_id").cast("string"))
    return md.segment_rows(cut_lineage(md.container_segments(files)))


@query("m09_jpeg_dimensions", """
SELECT doc_id::VARCHAR || '.jpg' AS path, 7 + doc_id % 2 AS decoded_width, 1 + doc_id % 500 AS decoded_height, doc_id % 4 = 1 AND NOT (doc_id % 2 = 0 AND doc_id % 500 = 15) AS differs
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def m09_jpeg(spark, d):
    files = framed_jpegs(spark, d).where("lang IS NOT NULL AND source IS NOT NULL")
    exif = files.where("doc_id % 4 = 1").select(F.col("path").alias("evidence_id"), F.inline(F.array(*[
        F.struct(F.lit(p).alias("property"), F.lit(v).alias("value"), F.lit("EXIF").alias("source")) for p, v in (("PixelXDimension", "8"), ("PixelYDimension", "16"))])))
    from vellumine.plans import flows

    facts = flows.metadata_examination(files.select("path", "content", "length", "modificationTime"), exif)["facts"]
    return facts.select("path", "decoded_width", "decoded_height", F.array_contains("flags", "DIMENSION DISCREPANCY").alias("differs"))


@query("m08_jpeg_quality", f"""
WITH ref AS (SELECT unnest({fixed.LUMINANCE_QUANTISER}) AS q), scales AS (SELECT DISTINCT label FROM embeddings),
s AS (SELECT label, avg(least(255, greatest(1, (q * (10 + label * 15) + 50) // 100)) * 100.0::DOUBLE / q) AS s FROM ref, scales GROUP BY 1)
SELECT e.vec_id::VARCHAR AS evidence_id, greatest(1, least(100, round_even(CASE WHEN s <= 100 THEN (200 - s) / 2 ELSE 5000 / s END, 0)))::INT AS estimated_quality
FROM embeddings e JOIN s USING (label)""")
def m08(spark, d):
    return md.jpeg_quality(md.container_segments(jpegs(spark, d)))


@query("m09_consistency", f"""WITH {CARRIER_SQL}, f AS (SELECT s.doc_id, s.is_consistent, coalesce(l.quality = 1, false) AS exif, coalesce(l.toxic = 1, false) AS gps,
  detected_format = 'PDF' AS pdf, s.doc_id % 100 AS ew, s.doc_id % 90 AS dw FROM signed s LEFT JOIN labels l USING (doc_id))
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN NOT is_consistent THEN 'FORMAT MISMATCH' END,
    CASE WHEN ew > 0 AND dw > 0 AND ew <> dw THEN 'DIMENSION DISCREPANCY' END, CASE WHEN exif THEN 'EXIF PRESENT' END, CASE WHEN gps THEN 'GPS PRESENT' END,
    CASE WHEN pdf THEN 'PDF JAVASCRIPT PRESENT' END, CASE WHEN exif OR pdf THEN 'METADATA PRESENT' ELSE 'NO METADATA' END], lambda t: t IS NOT NULL)), ',') AS flags,
  (CASE WHEN NOT is_consistent THEN 1 ELSE 0 END + CASE WHEN ew > 0 AND dw > 0 AND ew <> dw THEN 1 ELSE 0 END) AS n_inconsistencies FROM f""")
def m09(spark, d):
    marks = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("exif_present"), (F.col("toxic") == 1).alias("gps_present"))
    facts = md.signature(carriers(spark, d)).drop("content").join(marks, "doc_id", "left").withColumns({
        "exif_width": (F.col("doc_id") % 100).cast("int"), "exif_height": F.lit(5), "decoded_width": (F.col("doc_id") % 90).cast("int"), "decoded_height": F.lit(5),
        "has_thumbnail": F.lit(False), "xmp_present": F.lit(False), "is_pdf": F.col("detected_format") == "PDF",
        "security_flags": F.array(F.lit("PDF JAVASCRIPT PRESENT")), "software_indicators": F.array(F.lit("one"))})
    return md.consistency(facts).select("doc_id", F.array_join("flags", ",").alias("flags"), F.size("inconsistencies").alias("n_inconsistencies"))


def part_properties(spark, d):
    p = table(spark, d, "part").withColumn("evidence_id", F.col("p_partkey").cast("string"))
    return p.select("evidence_id", "p_size", F.inline(F.array(*[F.struct(F.lit(n).alias("property"), F.col(c).cast("string").alias("value"), F.lit(s).alias("source"))
                    for n, c, s in [("Software", "p_brand", "EXIF"), ("Creator", "p_type", "PDF Info"), ("CreatorTool", "p_brand", "XMP"),
                                    ("HistorySoftware", "p_name", "XMP"), ("Title", "p_name", "PDF Info"), ("Pages", "p_size", "PDF Header")]])))


PROPS_SQL = """props AS (SELECT p_partkey::VARCHAR AS evidence_id, unnest(['Software', 'Creator', 'CreatorTool', 'HistorySoftware', 'Title', 'Pages']) AS property,
  unnest([p_brand, p_type, p_brand, p_name, p_name, p_size::VARCHAR]) AS value, unnest(['EXIF', 'PDF Info', 'XMP', 'XMP', 'PDF Info', 'PDF Header']) AS source FROM part)"""


@query("m10_software_indicators", """
SELECT p_partkey::VARCHAR AS evidence_id, 'EXIF: ' || p_brand || ' | PDF Creator: ' || p_type || CASE WHEN contains('EXIF: ' || p_brand || 'PDF Creator: ' || p_type, p_name)
  THEN '' ELSE ' | XMP HistorySoftware: ' || p_name END AS indicators FROM part""")
def m10(spark, d):
    out = md.software_indicators(part_properties(spark, d).drop("p_size"))
    return out.select("evidence_id", F.array_join("software_indicators", " | ").alias("indicators"))


@query("m11_observed_timeline", """
WITH t AS (SELECT o_orderkey::VARCHAR AS evidence_id, 0 AS rk, 'Filesystem' AS source, 'File Modified Time' AS event, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders
UNION ALL SELECT l_orderkey::VARCHAR, 1, 'EXIF', 'DateTimeOriginal', strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_linenumber || ' (Timezone: Not encoded / Unknown)' FROM lineitem)
SELECT evidence_id, source, event, ts AS timestamp_str, row_number() OVER (PARTITION BY evidence_id ORDER BY rk, event, ts) AS seq FROM t""")
def m11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("evidence_id"), F.lit("File Modified Time").alias("property"),
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.lit("Filesystem").alias("source"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("evidence_id"), F.lit("DateTimeOriginal").alias("property"),
                                            F.concat_ws(" ", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_linenumber").alias("value"), F.lit("EXIF").alias("source"))
    return md.observed_timeline(o.unionByName(li))


@query("m12_examination_summary", f"""WITH {PROPS_SQL} SELECT evidence_id, 'PRESENT' AS metadata_status, 'Present' AS exif_present, 'Present' AS xmp_present,
  'Not Available' AS iptc_present, 'Not Available' AS gps_present FROM props GROUP BY 1
UNION ALL SELECT 'page-' || page_id, CASE WHEN contains(html, '<meta') THEN 'PRESENT' ELSE 'LIMITED' END, CASE WHEN contains(html, '<meta') THEN 'Present' ELSE 'Not Available' END,
  'Not Available', 'Not Available', 'Not Available' FROM pages""")
def m12(spark, d):
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("evidence_id"), F.when(F.col("html").contains("<meta"), "Make").otherwise("EXIF Status").alias("property"),
        F.lit("v").alias("value"), F.lit("EXIF").alias("source"))
    return md.examination_summary(part_properties(spark, d).drop("p_size").unionByName(pages))


@query("m13_anomalies", """
SELECT p_partkey, 'Medium' AS severity, 'Document contains editing tool signature in metadata: ' || p_name AS finding, 'Software' AS tag FROM part WHERE regexp_matches(p_name, 'ring|gear')
UNION ALL SELECT p_partkey, 'Low', 'PDF Creator (' || p_type || ') and Producer (' || p_brand || ') differ.', 'Creator/Producer' FROM part WHERE p_size > 10
UNION ALL SELECT p_partkey, CASE WHEN p_size > 40 THEN 'High' ELSE 'Medium' END, 'File: ' || CASE WHEN p_size > 40 THEN 'FORMAT x' ELSE 'other' END, 'src' FROM part""")
def m13(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("software"), F.col("p_type").alias("creator"), F.col("p_brand").alias("producer"),
        F.when(F.col("p_size") > 10, "PDF").otherwise("PNG").alias("file_type"),
        F.array(F.struct(F.lit("File").alias("field"), F.when(F.col("p_size") > 40, "FORMAT x").otherwise("other").alias("reason"), F.lit("src").alias("source"))).alias("inconsistencies"))
    return md.anomalies(p, tools=["ring", "gear"]).select("p_partkey", "severity", "finding", "tag")


VISIBLE = "(?s)<script.*?</script>|<style.*?</style>|<[^>]*>"  # what is not visible text of a page


def page_table(spark, d):
    p = table(spark, d, "pages")
    images = F.regexp_count("html", F.lit("<img"))
    return p.select("page_id", F.floor(F.col("page_id") / 10).cast("bigint").alias("doc_id"), (F.col("page_id") % 10 + 1).alias("page_number"),
                    F.regexp_replace("html", VISIBLE, " ").alias("text"),
                    images.alias("image_count"), "html")


PAGES_SQL = r"""pg AS (SELECT page_id, page_id // 10 AS doc_id, page_id % 10 + 1 AS page_number, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g') AS text,
  (length(html) - length(replace(html, '<img', ''))) // 4 AS images FROM pages),
cl AS (SELECT *, CASE WHEN trim(text) <> '' AND images > 0 THEN 'BOTH' WHEN trim(text) <> '' THEN 'TEXT' WHEN images > 0 THEN 'IMAGE' ELSE 'BLANK' END AS classification FROM pg)"""


@query("m14_page_classes", f"WITH {PAGES_SQL} SELECT page_id, classification FROM cl")
def m14(spark, d):
    return md.classify_pages(page_table(spark, d)).select("page_id", "classification")


@query("m14_page_class_counts", f"""WITH {PAGES_SQL} SELECT doc_id, count(*) AS pages_examined, count(*) FILTER (classification IN ('TEXT', 'BOTH')) AS text_pages,
  count(*) FILTER (classification IN ('IMAGE', 'BOTH')) AS raster_pages FROM cl GROUP BY 1""")
def m14_counts(spark, d):
    return md.page_class_counts(md.classify_pages(page_table(spark, d)), ["doc_id"])


@query("m15_native_text", f"""WITH {PAGES_SQL} SELECT doc_id, md5(coalesce(string_agg('--- Page ' || page_number || ' Native Text ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page_number)
  FILTER (trim(text) <> ''), '')) AS text_md5 FROM pg GROUP BY 1""")
def m15(spark, d):
    out = md.native_text(page_table(spark, d), ["doc_id"])
    return out.select("doc_id", F.md5(F.col("native_text").cast("binary")).alias("text_md5"))


@query("m16_active_content", """
SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<iframe') THEN 'EMBEDDED FILE PRESENT' END, CASE WHEN contains(html, '<script') THEN 'PDF JAVASCRIPT PRESENT' END) AS flags FROM pages""")
def m16(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.array_join(md.active_content(F.col("html"), "<iframe", "<script"), ",").alias("flags"))


@query("m17_row_routing", f"""WITH {PROPS_SQL} SELECT CASE WHEN source = 'EXIF' THEN 'EXIF' WHEN source = 'XMP' THEN 'XMP' ELSE 'PDF' END AS category, count(*) AS n FROM props GROUP BY 1
UNION ALL SELECT 'CONTAINER', count(*) FROM part WHERE p_size > 25""")
def m17(spark, d):
    props = part_properties(spark, d)
    png = props.where("property = 'Pages'").withColumn("source", F.lit("PNG IHDR"))
    formats = props.where("property = 'Pages'").select("evidence_id", F.when(F.col("p_size") > 25, "PNG").otherwise("JPEG").alias("detected_format"))
    return md.route_rows(props.unionByName(png), formats).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("m18_sanitise", f"WITH {PROPS_SQL} SELECT evidence_id, property, value FROM props WHERE property NOT IN ('Software', 'Creator', 'Title') AND source <> 'XMP'")
def m18(spark, d):
    return md.sanitise(part_properties(spark, d)).select("evidence_id", "property", "value")


@query("m19_file_facts", f"""WITH {PROPS_SQL} SELECT evidence_id, max(value) FILTER (property = 'Software') AS software, max(value) FILTER (property = 'Title') AS author,
  min(value) FILTER (property = 'HistorySoftware') AS history FROM props GROUP BY 1""")
def m19(spark, d):
    return md.file_facts(part_properties(spark, d), {"software": ["Software", "Creator"], "author": ["Artist", "Title"], "history": ["HistorySoftware"]})


# --- findings ----------------------------------------------------------------
def events(spark, d):
    return table(spark, d, "events")


@query("f01_finding_counts", """
SELECT event_type AS module, CASE WHEN value > 50 THEN 'Critical' WHEN value > 20 THEN 'High' WHEN value > 10 THEN 'Medium' ELSE 'Low' END AS severity, count(*) AS n,
  CASE WHEN value > 50 THEN 4 WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS severity_rank FROM events GROUP BY 1, 2, 4""")
def f01(spark, d):
    v = F.col("value")
    severity = F.when(v > 50, "Critical").when(v > 20, "High").when(v <= 10, "Low")
    return fi.finding_counts(fi.new_findings(events(spark, d).select(F.col("event_type").alias("module"), severity.alias("severity"))))


MODULE_OF = {"click": "Copy-Move Detection", "view": "Metadata Analysis", "error": "Noise Pattern Analysis", "purchase": "Splicing Analysis"}


@query("f02_fusion_matrix", "WITH r AS (SELECT user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODULE_OF.items()) + """ END AS module, max(value) AS confidence FROM events GROUP BY 1, 2),
u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, m.module, CASE WHEN r.user_id IS NULL THEN 'Analysis Pending' ELSE 'Complete' END AS status, coalesce(r.confidence, 0.0) AS confidence
FROM u CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{m}'" for m in fixed.FUSION_MODULES) + "]) AS module) m LEFT JOIN r ON r.user_id = u.user_id AND r.module = m.module")
def f02(spark, d):
    e = events(spark, d)
    module = F.create_map(*[x for k, v in MODULE_OF.items() for x in (F.lit(k), F.lit(v))])
    results = e.groupBy("user_id", F.try_element_at(module, F.col("event_type")).alias("module")).agg(F.max("value").alias("confidence")).withColumns(
        {"status": F.lit("Complete"), "evidence_strength": F.lit("Strong")})
    return fi.fusion_matrix(e.select("user_id").distinct(), results, "user_id").drop("evidence_strength")


@query("f03_case_overview", """
WITH ev AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_o, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_returnflag = 'R') AS fl, max(l_shipdate) AS last
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, coalesce(n, 0) AS n_evidence, coalesce(n_o, 0) AS n_o, coalesce(n_f, 0) AS n_f, coalesce(fl, 0) AS n_flagged, last AS last_event FROM orders LEFT JOIN ev ON k = o_orderkey""")
def f03(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("status"), "l_returnflag", F.col("l_shipdate").alias("timestamp"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    return fi.case_overview(cases, li, li, ["O", "F"], flagged=F.col("l_returnflag") == "R")


@query("f04_batch_work_list", f"""WITH {FILES_SQL} SELECT path, upper(ext) AS file_type, {SIZE_SQL} AS file_size, a.analysis,
  CASE WHEN a.analysis = 'OCR' AND lang = 'fr' THEN 'Complete' ELSE 'Ready' END AS status
FROM files CROSS JOIN (SELECT unnest([{', '.join(f"'{a}'" for a in fixed.BATCH_ANALYSES)}]) AS analysis) a WHERE {SUPPORTED}""")
def f04(spark, d):
    listed = files(spark, d)
    done = listed.where("lang = 'fr'").select("path", F.lit("OCR").alias("analysis"), F.lit("Complete").alias("status"))
    return fi.batch_work_list(listed, done).drop("file_name")


# --- streaming forms in batch, slots -----------------------------------------
@query("st2_audit_log", "SELECT user_id::VARCHAR AS case_id, event_id::VARCHAR AS evidence_id, event_type, props AS description, ts AS timestamp FROM events")
def st2(spark, d):
    from vellumine.operators.records import audit_rows
    return audit_rows(events(spark, d), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type"), F.col("props"), F.col("ts"))


@query("st3_current_state", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def st3(spark, d):
    from vellumine.operators.records import latest_by
    e = events(spark, d).select("user_id", "event_type", "event_id", "value", "ts")
    return latest_by(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("st4_audit_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st4(spark, d):
    return audit_rate(events(spark, d))


@query("u1_recogniser_slot", """WITH e AS (SELECT *, CASE WHEN lang IN ('en', 'fr') THEN 'raise' WHEN lang = 'de' THEN 'unloaded' WHEN lang = 'es' THEN 'idle' ELSE 'size' END AS engine FROM documents)
SELECT doc_id::VARCHAR AS page_key, engine,
  CASE engine WHEN 'raise' THEN CASE WHEN doc_id % 7 = 3 THEN md5('') ELSE md5(replace(text, 'e', 'E')) END WHEN 'size' THEN md5(length(text)::VARCHAR) ELSE md5('') END AS text_md5,
  CASE engine WHEN 'raise' THEN CASE WHEN doc_id % 7 = 3 THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END WHEN 'size' THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN engine = 'raise' AND doc_id % 7 = 3 THEN 'raise error: page ' || doc_id WHEN engine = 'unloaded' THEN 'unloaded error: no model'
    WHEN engine = 'idle' THEN 'idle error: no result' ELSE '' END AS error FROM e""")
def u1(spark, d):
    """Engines that read, fail on some pages, cannot start, and stop without a result."""
    def reader(convert, confidence, fails=lambda key: False):
        def run(batches):
            for b in batches:
                for i in range(0, len(b), 3):
                    part = b.iloc[i : i + 3]
                    for key in part["page_key"]:
                        if fails(key):
                            raise ValueError(f"page {key}")
                    yield part.assign(text=[convert(bytes(c).decode()) for c in part["content"]], confidence=confidence, word_confidences=[[confidence]] * len(part))
        return run

    def unloaded(batches):
        raise RuntimeError("no model")

    engines = [slots.Recogniser("absent", reader(str, 0.0), {"en": "eng"}, available=False),
               slots.Recogniser("raise", reader(lambda s: s.replace("e", "E"), 90.0, lambda key: int(key) % 7 == 3), {"en": "eng", "fr": "fra"}),
               slots.Recogniser("unloaded", unloaded, {"de": "deu"}), slots.Recogniser("idle", lambda batches: iter(()), {"es": "spa"}),
               slots.Recogniser("size", reader(lambda s: str(len(s)), 40.0), {"en": "eng", "zh": "zho"})]
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_key"), F.when(F.col("lang").isin("en", "fr", "de", "es"), F.col("lang")).otherwise("zh").alias("language"), F.col("text").cast("binary").alias("content"))
    out = slots.recognise(slots.assign_engine(pages, engines), engines)
    return out.select("page_key", "engine", F.md5(F.col("text").cast("binary")).alias("text_md5"), "confidence", "error")


@query("u2_analysis_slot", f"""SELECT d.doc_id::VARCHAR AS evidence_id, m.module, CASE WHEN m.module = 'Metadata Analysis' THEN 'Complete' ELSE 'Analysis Pending' END AS status,
  CASE WHEN m.module = 'Metadata Analysis' THEN n_chars::DOUBLE ELSE 0.0 END AS confidence FROM documents d CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in fixed.FUSION_MODULES)}]) AS module) m""")
def u2(spark, d):
    def measure(batches):
        for b in batches:
            yield b.assign(confidence=b["n_chars"].astype(float), evidence_strength="Weak")[["evidence_id", "confidence", "evidence_strength"]]
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), "n_chars")
    modules = [slots.Analysis("Metadata Analysis", measure), slots.Analysis("Splicing Analysis")]
    return fi.fusion_matrix(docs.select("evidence_id"), slots.run_analyses(docs, modules)).drop("evidence_strength")


# --- depth and length without limits --------------------------------------------
@query("m06_deep_json", """SELECT doc_id::VARCHAR AS evidence_id, rtrim(repeat('a:', 12), ':') || '[1]' AS property, lang AS value, 'XMP' AS source FROM documents
UNION ALL SELECT doc_id::VARCHAR, rtrim(repeat('a:', 12), ':') || '[0]', doc_id::VARCHAR, 'XMP' FROM documents""")
def m06_deep(spark, d):
    nested = F.concat(F.repeat(F.lit('{"a":'), F.lit(12)), F.lit('["'), F.col("doc_id").cast("string"), F.lit('","'), F.col("lang"), F.lit('"]'), F.repeat(F.lit("}"), F.lit(12)))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), nested.alias("j"))
    return md.flatten_json(docs, "evidence_id", "j")


@query("m06_deepest_json", """SELECT doc_id::VARCHAR AS evidence_id, 'd' || repeat(':x[0]', 150) || ':t' AS property, trim(source) AS value, 'XMP' AS source FROM documents WHERE trim(source) <> ''
UNION ALL SELECT doc_id::VARCHAR, 'n', n_chars::VARCHAR, 'XMP' FROM documents""")
def m06_deepest(spark, d):
    """302 levels in every row; a row of ten levels costs what it did without them."""
    nested = F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit(',"d":'), F.repeat(F.lit('{"x":['), F.lit(150)), F.to_json(F.struct(F.col("source").alias("t"))), F.repeat(F.lit("]}"), F.lit(150)), F.lit("}"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), nested.alias("j"))
    return md.flatten_json(docs, "evidence_id", "j")


@query("m06_bracket_json", """SELECT doc_id::VARCHAR AS evidence_id, 't' AS property, ']]}"]' AS value FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'x:y:z', lang FROM documents""")
def m06_bracket(spark, d):
    nested = F.concat(F.lit('{"t":"]]}\\"]","x":{"y":{"z":"'), F.col("lang"), F.lit('"}}}'))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), nested.alias("j"))
    return md.flatten_json(docs, "evidence_id", "j").select("evidence_id", "property", "value")


@query("m05_long_xmp_text", """SELECT doc_id::VARCHAR AS evidence_id, '1.1:title' AS property, md5(repeat(lang || source, 300)) AS value_md5 FROM documents""")
def m05_long(spark, d):
    packet = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>'),
                      F.repeat(F.concat("lang", "source"), F.lit(300)), F.lit("</dc:title><dc:title>second</dc:title></x:xmpmeta>"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), packet.alias("packet"))
    return md.xmp_rows(docs).select("evidence_id", "property", F.md5(F.col("value").cast("binary")).alias("value_md5"))


# --- continuous intake, batch by batch --------------------------------------------
@query("st1_intake", """
WITH f AS (SELECT doc_id, 'C' || (doc_id % 3) AS case_id, doc_id || '.png' AS name, text FROM documents)
SELECT case_id, name, sha256(text) AS sha256, 1::BIGINT AS n_registered, 1::BIGINT AS n_history, (doc_id % 10 = 0)::BIGINT AS n_changes FROM f""")
def st1(spark, d):
    """Documents as files in the shared folder, taken by the stream; a tenth is overwritten in
    place and the stream is run again, under the same checkpoint, until nothing is left."""
    import uuid

    from vellumine.session import ensure_checkpoint_dir
    from vellumine.sources.sinks import write_files
    from vellumine.sources.tables import EvidenceTables
    from vellumine.streaming.jobs import run_intake

    folder = f"{ensure_checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("in/d"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.col("text").cast("binary").alias("content"))
    tables = EvidenceTables(spark, f"{folder}/tables", buckets=4)
    changed = docs.where("doc_id % 10 = 0").withColumn("content", F.concat("content", F.lit("!").cast("binary")))
    for part in (docs, changed, docs.limit(0)):
        write_files(part, folder)
        run_intake(spark, f"{folder}/in", tables, f"{folder}/checkpoint",
                   lambda b: F.concat(F.lit("C"), F.pmod(F.regexp_extract("path", r"(\d+)\.png", 1).cast("bigint"), F.lit(3)).cast("string"))).awaitTermination()
    items = tables.read("evidence_items").groupBy("case_id", "evidence_id").agg(F.max("name").alias("name"), F.max("sha256").alias("sha256"), F.count("*").alias("n_registered"))
    history = tables.read("processing_history").groupBy("case_id", "evidence_id").agg(F.count("*").alias("n_history"))
    events = tables.read("case_events").groupBy("case_id", "evidence_id").agg(F.count("*").alias("n_changes"))
    out = items.join(history, ["case_id", "evidence_id"], "left").join(events, ["case_id", "evidence_id"], "left")
    return out.select("case_id", "name", "sha256", "n_registered", F.coalesce("n_history", F.lit(0).cast("long")).alias("n_history"), F.coalesce("n_changes", F.lit(0).cast("long")).alias("n_changes"))
