"""Sinks: histogram CSV, result JSON, text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import fixed

CHANNEL_COLUMNS = {"R": "Red_Count", "G": "Green_Count", "B": "Blue_Count", "GRAY": "Grayscale_Count"}


# --- histogram CSV -----------------------------------------------------------
def histogram_table(hist: DataFrame) -> DataFrame:
    """Histogram rows to one line per intensity: image_id, Intensity, a column per channel.

    The channel list is fixed, so one grouping has a sum for each channel. Rows need not be
    counted before: samples with an ``n`` of 1 do, and take one shuffle instead of two.
    """
    per = {name: F.coalesce(F.sum(F.when(F.col("ch") == c, F.col("n"))), F.lit(0)).alias(name) for c, name in CHANNEL_COLUMNS.items()}
    return hist.groupBy("image_id", F.col("bin").alias("Intensity")).agg(*per.values())


def write_histogram_csv(hist: DataFrame, path: str, provenance: DataFrame | None = None) -> None:
    """CSV lines under ``path``/counts, provenance of each image beside them.

    Lines are range-partitioned by image, so an image's 256 lines are consecutive and
    the number of files follows the volume, not the number of images.
    """
    lines = histogram_table(hist).repartitionByRange("image_id", "Intensity").sortWithinPartitions("image_id", "Intensity")
    lines.write.mode("overwrite").option("header", "true").csv(f"{path}/counts")
    if provenance is not None:
        provenance.write.mode("overwrite").option("header", "true").csv(f"{path}/provenance")


# --- JSON --------------------------------------------------------------------
def document_json(docs: DataFrame, pages: DataFrame, key: str, page: str = "page_number",
                  pages_per_chunk: int = 256) -> DataFrame:
    """One nested record per document with its pages in order.

    Pages are gathered in chunks, then the chunks in order. Image bytes have no place in
    the record: binary columns are dropped.
    """
    plain = [f.name for f in pages.schema.fields if f.dataType.simpleString() != "binary" and f.name != key]
    body = F.struct(page, *[c for c in plain if c != page])
    chunk = F.floor(F.col(page) / F.lit(pages_per_chunk)).alias("_chunk")
    parts = pages.groupBy(key, chunk).agg(F.array_sort(F.collect_list(body)).alias("_p"))
    gathered = parts.groupBy(key).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("_chunk", "_p"))), lambda s: s["_p"])).alias("pages"))
    keep = [f.name for f in docs.schema.fields if f.dataType.simpleString() != "binary"]
    return docs.select(*keep).join(gathered, key, "left")


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- text reports ------------------------------------------------------------
RULE, THIN = "=" * 70, "-" * 20


def report_lines(df: DataFrame, key: str, lines: Sequence[Column | str]) -> DataFrame:
    """A fixed sequence of lines per row: (key, line_no, text). Null lines are left out."""
    items = F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]))
    return df.select(key, F.posexplode(items).alias("line_no", "text"))


def labelled(label: str, value: Column | str, width: int = 16) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{label}:".ljust(width)), F.coalesce(v.cast("string"), F.lit(fixed.NOT_AVAILABLE)))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def case_report(df: DataFrame, key: str = "evidence_id", generated_at: Column | None = None) -> DataFrame:
    """Case report lines of each evidence item.

    Needs the case and evidence columns and, for examined items, ``overall_script``,
    ``overall_language``, ``overall_confidence`` and ``total_words`` (null otherwise). Read where
    they are there: ``organization``, ``date``, ``created_at``, ``reference_number``,
    ``integrity_status`` (what the digest check found; without one the hash counts as not
    verified) and ``manual_review`` ("Required" where runs disagree; unknown counts as such).
    """
    from vellumine.functions.times import shown_local
    from vellumine.operators.runs import reliability_conclusion

    done = F.col("overall_confidence").isNotNull()
    checked, review, created = _optional(df, "integrity_status"), _optional(df, "manual_review"), _optional(df, "created_at", "timestamp")
    good, bad = checked == fixed.INTEGRITY_VERIFIED, checked == fixed.INTEGRITY_CHANGED
    agreed = F.coalesce(review != "Required", F.lit(False))

    def row(name: str, status: str | Column, result: Column) -> Column:
        state = F.rpad(F.lit(status) if isinstance(status, str) else status, 10, " ")
        return F.when(done, F.concat(F.lit(f"{name:<20} | "), state, F.lit(" | "), result.cast("string")))

    return report_lines(df, key, [
        RULE, " " * 20 + "FORENSIC REPORT", RULE, "",
        "1. CASE DETAILS", THIN, labelled("Case ID", "case_id"), labelled("Case Name", "case_name"),
        labelled("Status", "case_status"), labelled("Examiner", "examiner"), labelled("Organization", _optional(df, "organization")), labelled("Date", _optional(df, "date")),
        F.when(created.isNotNull(), labelled("Created (IST)", shown_local(created, naive=False))), labelled("Ref Number", _optional(df, "reference_number")), "",
        "2. EVIDENCE DETAILS", THIN, labelled("Evidence ID", key), labelled("Name", "name"),
        labelled("File Path", "file_path"), labelled("SHA-256 Hash", "sha256"), labelled("Type", "evidence_type"), "",
        "3. ANALYSIS COVERAGE", THIN,
        labelled("OCR", F.when(done, "Completed").otherwise("Not Performed")),
        labelled("Image Quality", F.when(done, "Checked").otherwise("Not Performed")),
        labelled("Hash", F.when(good, "Verified").when(bad, "Changed").otherwise("Not Verified")), "",
        "4. FORENSIC EXAMINATION MATRIX", THIN,
        F.when(~done, "No OCR or Examination Data available for this evidence."),
        row("Analysis", "Status", F.lit("Result")), F.when(done, "-" * 65),
        row("Evidence Integrity", F.when(good, "CONFIRMED").when(bad, "FAILED").otherwise("UNCERTAIN"),
            F.when(good, "SHA-256 verified").when(bad, "SHA-256 differs from the record").otherwise("Not verified")),
        row("Script Detection", "LIKELY", F.col("overall_script")),
        row("Language ID", "LIKELY", F.col("overall_language")),
        row("Primary OCR", "COMPLETED", F.format_string("%.1f%%", F.col("overall_confidence"))),
        row("Engine Disagreement", F.when(agreed, "CONFIRMED").otherwise("UNCERTAIN"), F.when(agreed, "Runs agree").otherwise("Review Required")),
        row("OCR Regions", "COMPLETED", F.concat(F.col("total_words").cast("string"), F.lit(" words"))), "",
        "5. CONCLUSION", THIN, reliability_conclusion(F.col("overall_confidence")), "", RULE,
        F.concat(F.lit("Report Generated At: "), F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd HH:mm:ss")), RULE,
    ])


def histogram_report(stats: DataFrame, clip: DataFrame, tonal: DataFrame) -> DataFrame:
    """Histogram report lines per image from the gray statistics."""
    joined = stats.join(clip, ["image_id", "ch"]).join(tonal, ["image_id", "ch"])
    num = lambda c: F.col(c).cast("string")
    share = lambda label, a, b: F.concat(F.lit(f"{label:<20}: "), F.format_string("%,d", F.col(a)), F.lit(" pixels ("), num(b), F.lit("%)"))
    return report_lines(joined, "image_id", [
        "HISTOGRAM REPORT", "1. STATISTICAL METRICS",
        *[labelled(label, num(c), 19) for label, c in [("Total Pixels", "pixel_count"), ("Mean Intensity", "mean"), ("Median Intensity", "median"),
          ("Std Deviation", "std_dev"), ("Min Intensity", "min"), ("Max Intensity", "max"), ("Dynamic Range", "dynamic_range")]],
        F.concat_ws(" | ", *[F.concat(F.lit(f"{p.upper()}: "), num(p)) for p in ("p1", "p5", "p25", "p50", "p75", "p95", "p99")]),
        "2. CLIPPING & SATURATION ANALYSIS", share("Black Clipping", "black_count", "black_pct"), share("White Clipping", "white_count", "white_pct"),
        "3. TONAL DISTRIBUTION", share("Shadows (0-84)", "shadows_count", "shadows_pct"),
        share("Midtones (85-170)", "midtones_count", "midtones_pct"), share("Highlights (171-255)", "highlights_count", "highlights_pct"),
    ])


SECTIONS = ["FILESYSTEM ATTRIBUTES", "EXIF METADATA", "XMP METADATA", "IPTC / IIM METADATA", "PDF METADATA & STRUCTURE", "JPEG CONTAINER & QUANTIZATION", "OTHER PROPERTIES"]
BROAD = "=" * 80
BREAK = "-" * 80


def _section(source: Column) -> Column:
    """Number of a property row's section, from 1."""
    return (F.when(source == "Filesystem", 1).when(source.startswith("EXIF"), 2).when(source == "XMP", 3).when(source.startswith("IPTC"), 4)
            .when(source.startswith("PDF"), 5).when(source.startswith("JPEG"), 6).otherwise(7))


def _property_line(name: Column | str, value: Column | str, source: Column | str) -> Column:
    def cell(of: Column | str, width: int):  # widths pad, they never cut
        flat = F.regexp_replace(of, "\n", " ")
        return F.when(F.length(flat) < width, F.rpad(flat, width, " ")).otherwise(flat)

    return F.concat_ws(" | ", cell(name, 35), cell(value, 32), F.lit(source) if isinstance(source, str) else source)


def metadata_report(props: DataFrame) -> DataFrame:
    """Property table lines: one line per property row, sections in a fixed order."""
    return props.select("evidence_id", _section(F.col("source")).alias("section"), "property", _property_line("property", "value", F.col("source")).alias("text"))


def examination_report(props: DataFrame, facts: DataFrame, summary: DataFrame, examined_at: Column | None = None) -> DataFrame:
    """Whole metadata report of each file: (evidence_id, section, part, property, line_no, text).

    Sorted by these columns it has the header, the summary with its flags, a table for every
    section that has properties, the inconsistencies and the end. ``facts`` and ``summary`` are
    those of ``flows.metadata_examination``; ``case_id`` of the facts is read where it is there.
    """
    at = F.current_timestamp() if examined_at is None else examined_at
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    told = [c for c in summary.columns if c != "evidence_id"]
    both = facts.select("evidence_id", "path", "detected_format", "flags", "inconsistencies", F.coalesce(_optional(facts, "case_id"), F.lit("Unassigned")).alias("case_id")).join(summary, "evidence_id", "left")
    field = lambda label, value: F.concat(F.lit(f"{label:<28}: "), F.coalesce(value.cast("string"), F.lit(fixed.NOT_AVAILABLE)))
    head = [
        BROAD, "QUESTIONED DOCUMENT FORENSIC METADATA REPORT", BROAD, "", labelled("Case ID", "case_id"), labelled("Evidence ID", "evidence_id"), labelled("File Name", name),
        labelled("File Path", "path"), labelled("Detected Type", "detected_format"), labelled("Examination At", F.date_format(at, "yyyy-MM-dd HH:mm:ss")), "",
        BREAK, "FORENSIC EXAMINATION SUMMARY", BREAK, *[field(c.replace("_", " ").title(), F.col(c)) for c in told], "",
        F.concat(F.lit("Forensic Flags: "), F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("None")), ""]

    def lines(df: DataFrame, section: Column, part: int, items: list[Column | str], order: Column) -> DataFrame:
        texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])
        return df.select("evidence_id", section.alias("section"), F.lit(part).alias("part"), order.alias("property"), F.posexplode(texts).alias("line_no", "text"))

    nothing = F.lit("")
    titles = F.lit(SECTIONS)
    tables = props.select("evidence_id", _section(F.col("source")).alias("section")).distinct()
    heading = lines(tables, F.col("section"), 0, [BREAK, F.get(titles, F.col("section") - 1), BREAK, _property_line(F.lit("PROPERTY"), F.lit("VALUE"), "SOURCE"), BREAK], nothing)
    rows = metadata_report(props).select("evidence_id", "section", F.lit(1).alias("part"), "property", F.lit(0).alias("line_no"), "text")
    after = lines(tables, F.col("section"), 2, [""], nothing)
    issues = both.select("evidence_id", F.posexplode("inconsistencies").alias("at", "i"))
    first = lines(both.where(F.size("inconsistencies") > 0), F.lit(8), 0, [BREAK, "METADATA INCONSISTENCIES OBSERVED", BREAK], nothing)
    each = lines(issues, F.lit(8), 1, [
        F.concat(F.lit("• Field: "), F.col("i.field")), *[F.concat(F.lit(f"  {label:<12}"), F.coalesce(F.col(f"i.{c}"), F.lit(fixed.NOT_AVAILABLE))) for label, c in (
            ("Observed:", "observed_value"), ("Comparison:", "comparison_value"), ("Source:", "source"), ("Reason:", "reason"))], ""], F.lpad(F.col("at").cast("string"), 6, "0"))
    out = lines(both, F.lit(0), 0, head, nothing)
    for part in (heading, rows, after, first, each, lines(both, F.lit(9), 0, [BROAD, "END OF FORENSIC METADATA REPORT", BROAD], nothing)):
        out = out.unionByName(part)
    return out


def ocr_report(docs: DataFrame, key: str) -> DataFrame:
    """Recognition report lines of each document; its text is the last line."""
    return report_lines(docs, key, [
        "OCR & Language Identification Report", labelled("Language", "overall_language"),
        F.concat(F.lit("Confidence:     "), F.col("overall_confidence").cast("string"), F.lit("%")), labelled("Assessment", "overall_level"),
        labelled("Pages", "total_pages"), labelled("Words", "total_words"), labelled("Characters", "total_chars"),
        F.when(F.size("detected_languages") > 1, F.concat(F.lit("Multiple languages detected: "), F.array_join("detected_languages", ", "))),
        "EXTRACTED TEXT", F.coalesce(F.nullif("total_text", F.lit("")), F.lit("(No text extracted)")),
    ])


def write_text_report(lines: DataFrame, path: str, key: str, order: Sequence[str] = ("line_no",)) -> None:
    """Report lines as text files, every item's lines consecutive and in order.

    A range partitioning on (item, line) keeps the order across files and lets even one
    item's lines span several tasks. Each line is prefixed with its item.
    """
    ordered = lines.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ordered.select(F.concat_ws("\t", F.col(key).cast("string"), F.col("text")).alias("value")).write.mode("overwrite").text(path)


# --- files -------------------------------------------------------------------
def write_files(rows: DataFrame, root: str) -> int:
    """Write ``content`` of each row to the file ``path`` below ``root``; an old file is replaced.

    Every task writes its rows' files through the file system of ``root``, which driver and
    executors must share. Returns the number of files. A null content is an empty file.
    """
    from vellumine.sources.files import file_system

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            contents = batch.column("content")
            for i, path in enumerate(batch.column("path").to_pylist()):
                content = contents[i].as_buffer()  # the bytes stay in the batch
                system, at = file_system(f"{root.rstrip('/')}/{path}")
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
