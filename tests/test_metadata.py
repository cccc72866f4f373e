"""Signatures, containers, XMP, consistency and reports on generated files."""

import json

import pytest
from pyspark.sql import functions as F

from tests.make_files import jpeg_head, png, quantiser
from vellumine.functions import fixed
from vellumine.operators import integrity as ig, metadata as md
from vellumine.plans import flows
from vellumine.sources import files as sf, sinks

XMP = ('<x:xmpmeta xmlns:x="adobe:ns:meta/"><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
       '<r:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" r:about="doc"><xmp:CreatorTool>Scan é</xmp:CreatorTool>'
       '<xmp:CreateDate>2024-01-02</xmp:CreateDate><xmp:CreatorTool>Later</xmp:CreatorTool></r:Description></r:RDF></x:xmpmeta>')


def zigzagged(values):
    return [values[i] for i in md.zigzag_order()]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    table = zigzagged(quantiser(85, fixed.LUMINANCE_QUANTISER))
    (root / "photo.jpg").write_bytes(jpeg_head([(0, table, 8), (1, table, 8)], "Questioned document"))
    (root / "deep.jpg").write_bytes(jpeg_head([(0, [v * 256 for v in [1] * 64], 16)]))
    (root / "text.png").write_bytes(png(200, 150, lambda y, x: (9, 9, 9), 3, {"Author": "A. Examiner", "Description": "Sample"}))
    (root / "wrong.jpg").write_bytes(png(4, 4, lambda y, x: (1, 2, 3)))
    (root / "empty.jpg").write_bytes(b"")
    (root / "doc.pdf").write_bytes(b"%PDF-1.4 /Names << /JavaScript 1 0 R >> /EmbeddedFiles " + XMP.encode() + b" %%EOF")
    (root / "scan.tif").write_bytes(b"MM\x00*rest")
    (root / "web.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8 ")
    (root / "fake.webp").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt ")
    return str(root)


@pytest.fixture(scope="module")
def scan(spark, folder):
    files = sf.evidence_scan(spark, folder, content=True)
    return files.withColumn("evidence_id", F.regexp_extract("path", r"([^/]+)$", 1)).cache()


def test_signatures(scan):
    rows = {r.evidence_id: r for r in md.signature(scan).collect()}
    assert {k: r.detected_format for k, r in rows.items()} == {
        "photo.jpg": "JPEG", "deep.jpg": "JPEG", "text.png": "PNG", "wrong.jpg": "PNG", "empty.jpg": "UNKNOWN", "doc.pdf": "PDF",
        "scan.tif": "TIFF (Big Endian)", "web.webp": "WEBP", "fake.webp": "UNKNOWN"}
    assert not rows["wrong.jpg"].is_consistent
    assert rows["wrong.jpg"].warning == ("FORMAT MISMATCH: Declared extension '.JPG' disagrees with detected container 'PNG' (Magic: 89504E47).")
    assert all(r.is_consistent for k, r in rows.items() if k != "wrong.jpg")
    orders = {r.evidence_id: r.value for r in md.byte_order_rows(md.signature(scan)).collect()}
    assert orders == {"scan.tif": "Big Endian (Motorola 'MM')", "web.webp": "Google WebP (RIFF)"}


def test_segments_comments_quality(scan):
    segments = md.container_segments(scan)
    summary = {r.evidence_id: r for r in md.marker_summary(segments).collect()}
    assert summary["photo.jpg"].marker_sequence == "APP0 → COM → DQT → DQT → EOI" and summary["photo.jpg"].marker_count == 5
    quality = {r.evidence_id: r.estimated_quality for r in md.jpeg_quality(segments).collect()}
    assert abs(quality["photo.jpg"] - 85) <= 2 and quality["deep.jpg"] == round(5000 / (sum(25600 / q for q in fixed.LUMINANCE_QUANTISER) / 64))
    props = {(r.evidence_id, r.property): r.value for r in md.segment_rows(segments).collect()}
    assert props["photo.jpg", "JPEG Comment #1"] == "Questioned document"
    assert props["photo.jpg", "Encoding Characteristic"] == "JFIF Version 1.02"
    assert props["text.png", "Author"] == "A. Examiner" and props["text.png", "Description"] == "Sample"
    assert props["text.png", "Dimensions"] == "200 × 150 px" and props["text.png", "Color Type"] == "RGB"


@pytest.mark.parametrize("quality", [10, 30, 50, 75, 95])
def test_quality_estimate_tracks_the_encoder(spark, quality):
    data = jpeg_head([(0, zigzagged(quantiser(quality, fixed.LUMINANCE_QUANTISER)), 8)])
    files = spark.createDataFrame([("a", bytearray(data))], "evidence_id string, content binary")
    assert abs(md.jpeg_quality(md.container_segments(files)).first().estimated_quality - quality) <= 2


def segments_of(spark, data):
    return md.container_segments(spark.createDataFrame([("a", bytearray(data))], "evidence_id string, content binary")).orderBy("segment_no")


def test_segments_are_read_by_their_lengths(spark):
    comment = b"\xff\xfe\x00\x06\xff\xd9\xff\xe0"  # markers inside a payload are payload
    frame = b"\xff\xc2" + bytes([0, 11, 8, 1, 0x2C, 2, 0x58, 1, 1, 0x11, 0])
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    rows = segments_of(spark, b"\xff\xd8" + comment + b"\xff\xff\xff" + frame[1:] + b"\xff\xd0stray\xff\x00" + b"\xff\xe5\x00\x02" + scan + b"\xff\xc0\x00\x0b" + b"\xff\xd9").collect()
    assert [(r.kind, r.length) for r in rows] == [("SOI", 0), ("COM", 6), ("SOF2", 11), ("0xFFD0", 0), ("APP5", 2), ("SOS", 8)]
    assert bytes(rows[1].payload) == b"\xff\xd9\xff\xe0"
    assert [(r.decoded_width, r.decoded_height) for r in md.frame_sizes(segments_of(spark, b"\xff\xd8" + frame)).collect()] == [(600, 300)]
    for cut, kinds in ((b"\xff\xd8\xff\xfe\x00\x09ab", ["SOI", "COM"]), (b"\xff\xd8\xff\xdb\x00", ["SOI"]), (b"\xff\xd8\xff\xff\xff", ["SOI"]), (b"\xff\xd8\xff\xfe\x00\x00\xff\xd9", ["SOI", "COM", "EOI"])):
        assert [r.kind for r in segments_of(spark, cut).collect()] == kinds


def test_tables_of_a_segment_are_split_by_their_precision(spark):
    one = bytes([0]) + bytes(range(1, 65))
    two = bytes([0x11]) + b"".join(v.to_bytes(2, "big") for v in range(1000, 1064))
    for body, want in ((one, [(0, 8, 1, 64)]), (two + one, [(1, 16, 1000, 1063), (0, 8, 1, 64)]), (one + two + one, [(0, 8, 1, 64), (1, 16, 1000, 1063), (0, 8, 1, 64)]),
                       (two + one[:40], [(1, 16, 1000, 1063)]), (one + b"\x13", [(0, 8, 1, 64)]), (one[:64], []), (b"", [])):
        data = b"\xff\xd8\xff\xdb" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"
        got = md.quantiser_tables(segments_of(spark, data)).orderBy("segment_no", "table_no").collect()
        assert [(r.table_id, r.bits, r.entries[0], r.entries[-1]) for r in got] == want and all(len(r.entries) == 64 for r in got)


def test_container_rows_of_a_jpeg(spark):
    data = jpeg_head([(0, zigzagged(quantiser(85, fixed.LUMINANCE_QUANTISER)), 8)], "one")
    rows = {(r.property, r.source): r.value for r in md.segment_rows(segments_of(spark, data)).collect()}
    assert rows["Container Type", "JPEG Container"] == "JPEG (ISO/IEC 10918-1)" and rows["Marker Count", "JPEG Container"] == "4"
    assert rows["Marker Sequence", "JPEG Container"] == "APP0 → COM → DQT → EOI" and rows["Quantization Tables Count", "JPEG Container"] == "1"
    assert rows["Quantization Table #0", "JPEG DQT"] == "Precision: 8-bit, Entries: 64" and rows["JPEG Comment #1", "JPEG COM"] == "one"
    assert rows["Estimated Quality", "JPEG DQT (Estimation)"].startswith("85% (Estimated")
    bare = {(r.property, r.source): r.value for r in md.segment_rows(segments_of(spark, b"\xff\xd8\xff\xd9")).collect()}
    assert bare["JPEG Comment", "JPEG COM"] == "Not Available" and bare["Quantization Tables Count", "JPEG Container"] == "0"
    assert bare["Estimated Quality", "JPEG DQT"] == "Not Available (Standard luminance table not matched)"


def test_zigzag_starts_along_the_first_diagonals():
    assert md.zigzag_order()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(md.zigzag_order()) == list(range(64))


def test_xmp(scan):
    packets = md.with_xmp_packet(scan).select("evidence_id", "packet")
    found = {r.evidence_id: r.packet for r in packets.collect()}
    assert found["doc.pdf"] == XMP and found["photo.jpg"] is None
    rows = {r.property: r.value for r in md.xmp_rows(packets).collect()}
    assert rows["1.0:CreatorTool"] == "Scan é" and rows["Description@about"] == "doc"
    assert md.with_xmp_packet(scan, window=20).where("packet IS NOT NULL").count() == 0


def test_broken_packet_gives_no_rows(spark):
    packets = spark.createDataFrame([("a", "<x:xmpmeta><b></x:xmpmeta>")], "evidence_id string, packet string")
    assert md.xmp_rows(packets).count() == 0


def test_examination(scan):
    props, facts = flows.examine_metadata(scan.drop("evidence_id"))
    flags = {r.file: r for r in facts.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "flags", "inconsistencies").collect()}
    assert "FORMAT MISMATCH" in flags["wrong.jpg"].flags and len(flags["wrong.jpg"].inconsistencies) == 1
    assert flags["doc.pdf"].flags == ["EMBEDDED FILE PRESENT", "METADATA PRESENT", "PDF JAVASCRIPT PRESENT", "XMP PRESENT"]
    assert flags["empty.jpg"].flags == ["NO METADATA"]
    status = {r.evidence_id.rsplit("/", 1)[1]: r.metadata_status for r in md.examination_summary(props).collect()}
    assert status["empty.jpg"] == "LIMITED" and status["doc.pdf"] == "PRESENT"
    timeline = md.observed_timeline(props).where(F.col("evidence_id").endswith("doc.pdf")).orderBy("seq").collect()
    assert [(r.seq, r.source, r.event) for r in timeline] == [(1, "Filesystem", "File Modified Time"), (2, "XMP", "1.0:CreateDate")]


def test_routing_and_facts(spark):
    props = spark.createDataFrame([
        ("a", "Software", "GIMP", "EXIF"), ("a", "DateTimeOriginal", "2001", "EXIF"), ("a", "GPS Present", "YES", "EXIF GPS"), ("a", "x", "1", "PNG IHDR"),
        ("a", "y", "1", "JPEG DQT"), ("a", "Artist", "Not Available", "EXIF"), ("a", "Copyright", "me", "EXIF"), ("a", "By-line", "z", "IPTC / IIM"),
        ("a", "Magic", "z", "File Signature")], "evidence_id string, property string, value string, source string")
    formats = spark.createDataFrame([("a", "PNG")], "evidence_id string, detected_format string")
    routed = {r.property: r.category for r in md.route_rows(props, formats).collect()}
    assert routed == {"Software": "EXIF", "DateTimeOriginal": "EXIF", "GPS Present": "EXIF", "x": "CONTAINER", "Artist": "EXIF", "Copyright": "EXIF",
                      "By-line": "IPTC", "Magic": "FILE"}
    facts = md.file_facts(props).first()
    assert (facts.software, facts.creation_date, facts.author) == ("GIMP", "2001", "me")
    assert md.examination_summary(props).first().gps_present == "Present"
    left = {r.property for r in md.sanitise(props).collect()}
    assert left == {"x", "y", "Magic"}
    with pytest.raises(ValueError):
        md.write_sanitised(props, "/tmp/a/", "/tmp/a")


def test_software_indicators_skip_known_values(spark):
    props = spark.createDataFrame([
        ("a", "Software", "GIMP 2", "EXIF"), ("a", "CreatorTool", "GIMP", "XMP"), ("a", "HistorySoftware", "Canva", "XMP"), ("a", "Producer", "Not Available", "PDF Info")],
        "evidence_id string, property string, value string, source string")
    assert md.software_indicators(props).first().software_indicators == ["EXIF: GIMP 2", "XMP HistorySoftware: Canva"]


def test_verification_states(spark):
    df = spark.createDataFrame([("abc", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("abd", "00"), (None, "00")], "c string, h string")
    assert [r[0] for r in df.select(ig.verify(F.col("c"), F.col("h"))).collect()] == [True, False, None]


def test_reports(spark, scan, tmp_path):
    props, facts = flows.examine_metadata(scan.drop("evidence_id"))
    sinks.write_json(facts.select("path", "detected_format", "flags", "inconsistencies"), str(tmp_path / "json"))
    records = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(records) == 9 and any(r["flags"] == ["NO METADATA"] for r in records)
    lines = sinks.metadata_report(props)
    sinks.write_text_report(lines, str(tmp_path / "txt"), "evidence_id", ("section", "property"))
    assert spark.read.text(str(tmp_path / "txt")).count() == props.count()


def test_a_whole_metadata_report(spark, scan):
    found = flows.metadata_examination(scan.drop("evidence_id"))
    lines = sinks.examination_report(found["properties"], found["facts"], found["summary"], F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    text = {}
    for r in lines.orderBy("evidence_id", "section", "part", "property", "line_no").collect():
        text.setdefault(r.evidence_id.rsplit("/", 1)[1], []).append(r.text)
    photo, wrong = text["photo.jpg"], text["wrong.jpg"]
    assert len(text) == 9 and photo[:2] == ["=" * 80, "QUESTIONED DOCUMENT FORENSIC METADATA REPORT"] and photo[-2] == "END OF FORENSIC METADATA REPORT"
    assert "Case ID:        Unassigned" in photo and "File Name:      photo.jpg" in photo and "Examination At: 2026-01-02 03:04:05" in photo and "Detected Type:  JPEG" in photo
    assert "Forensic Flags: NO METADATA" in photo and "JPEG CONTAINER & QUANTIZATION" in photo and "EXIF METADATA" not in photo
    at = photo.index("JPEG CONTAINER & QUANTIZATION")
    assert photo[at + 2].startswith("PROPERTY") and any(x.startswith("JPEG Comment #1 ") and "Questioned document" in x for x in photo[at:])
    at = wrong.index("METADATA INCONSISTENCIES OBSERVED")
    assert wrong[at + 2] == "• Field: File Format" and wrong[at + 3] == "  Observed:   PNG" and wrong[at + 4] == "  Comparison: .JPG" and "METADATA INCONSISTENCIES OBSERVED" not in photo


def test_unexamined_item_report(spark):
    cols = ["evidence_id", "case_id", "case_name", "case_status", "examiner", "name", "file_path", "sha256", "evidence_type", "overall_script", "overall_language"]
    df = spark.createDataFrame([tuple("x" for _ in cols) + (None, None)], ", ".join(f"{c} string" for c in cols) + ", overall_confidence double, total_words int")
    text = [r.text for r in sinks.case_report(df).orderBy("line_no").collect()]
    assert "No OCR or Examination Data available for this evidence." in text and "No detailed analysis performed." in text
    assert not any(t.startswith("Script Detection") for t in text)


def plain_indicators(rows):
    """Indicators of one file: (rank, property, value, label) rows in order."""
    out = []
    for rank, _, value, label in sorted(rows):
        if rank < 3 or not any(value in x for x in out):
            out.append(label)
    return out


def test_software_of_a_file_with_many_properties(spark):
    import random

    rng = random.Random(6)
    rows = [("f", "Software", "GIMP 2.1", "EXIF"), ("f", "Creator", "Word", "PDF Info"), ("f", "Producer", "Word", "PDF Info"), ("f", "Title", "no", "XMP"), ("g", "HistoryAgent", "x", "XMP"), ("g", "CreatorTool", "Not Available", "XMP")]
    rows += [("f", f"History{i}", "".join(rng.choices("ab 1é", k=rng.randint(1, 9))), "XMP") for i in range(700)]
    props = spark.createDataFrame(rows + rows[:50], "evidence_id string, property string, value string, source string").repartition(5)
    got = {}
    for r in md.software_indicator_rows(props).collect():
        got.setdefault(r.evidence_id, {})[r.indicator_no] = r.indicator
    unique = {}
    for e, p, v, s in rows:
        rank = {"Software": 0, "Creator": 1, "Producer": 2}.get(p) if s != "XMP" else 3 if p[:3] in ("His", "Cre") else None
        if e == "f" and rank is not None:
            label = [f"EXIF: {v}", f"PDF Creator: {v}", f"PDF Producer: {v}", f"XMP {p}: {v}"][rank]
            unique[v, rank if rank < 3 else None] = min((rank, p, v, label), unique.get((v, rank if rank < 3 else None), (9,)))
    assert [got["f"][i] for i in sorted(got["f"])] == plain_indicators(unique.values()) and sorted(got["f"]) == list(range(len(got["f"])))
    assert got["g"] == {0: "XMP HistoryAgent: x"}
    both = {r.evidence_id: r.software_indicators for r in md.software_indicators(props).collect()}
    assert both == {e: [x[i] for i in sorted(x)] for e, x in got.items()}


def test_equal_software_rows_are_combined_without_gathering(spark, monkeypatch):
    rows = [("f", p, v, s) for p, v, s in [
        ("creator", "Word", "PDF Info"), ("Creator", "Word", "PDF Info"), ("CREATOR", "Calc", "PDF Info"), ("Software", "Word", "EXIF"), ("Producer", "Word", "PDF Info"),
        ("HistoryB", "Krita", "XMP"), ("HistoryA", "Krita", "XMP"), ("HistoryC", "Calc", "XMP")]]
    props = spark.createDataFrame(rows * 20 + [(None, "Software", "x", "EXIF")] * 3, "evidence_id string, property string, value string, source string").repartition(3)
    want = ["EXIF: Word", "PDF Creator: Calc", "PDF Creator: Word", "PDF Producer: Word", "XMP HistoryA: Krita"]
    for seen in (1, md.SEEN):  # forgotten at once, and never
        monkeypatch.setattr(md, "SEEN", seen)
        assert {r.evidence_id: r.software_indicators for r in md.software_indicators(props).collect()} == {"f": want, None: ["EXIF: x"]}
    plan = md.software_indicator_rows(props)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1  # no sort or table of a whole scan


def test_100_000_properties_of_one_file_are_folded_as_they_come(spark):
    props = spark.range(100_000).selectExpr("'f' AS evidence_id", "'History' || id AS property", "'agent ' || sha2(CAST(id % 99000 AS STRING), 256) AS value", "'XMP' AS source")
    assert md.software_indicator_rows(props).count() == 99_000
