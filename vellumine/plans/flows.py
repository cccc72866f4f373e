"""Whole examinations: import, recognition and language, metadata, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellumine.functions import fixed
from vellumine.functions.numbering import hash_order
from vellumine.operators import integrity, metadata, profiles as language_profiles, raster, records, runs, text_id
from vellumine.session import cut_lineage


def import_documents(files: DataFrame, registry: DataFrame, case_id: Column, generated_case: Column) -> DataFrame:
    """Files with content to registered evidence rows.

    One projection over one binary scan gives facts, digests and signature; the content
    is dropped before the only shuffle, the join with the registry.
    """
    seen = integrity.digests(metadata.signature(files)).drop("content")
    placed = records.default_case(seen.withColumn("case_id", case_id), generated_case).withColumnRenamed("path", "file_path")
    return records.register_or_reuse(placed, registry, [hash_order("file_path"), F.col("file_path")])


def identify_pages(pages: DataFrame, text: str = "text", stat: tuple[str, str] | None = None) -> DataFrame:
    """Script, language and counts of page texts; row by row, no shuffle."""
    from vellumine.functions import text as tx

    counted = pages.withColumns({"word_count": tx.word_count(F.col(text)), "char_count": tx.char_count(F.col(text))})
    return text_id.identify_language(text_id.detect_script(counted, text), text, stat)


def recognise_documents(page_runs: DataFrame, doc: str, page: str) -> DataFrame:
    """Runs of many pages to one row per document: text, language, script."""
    return recognition_examination(page_runs, doc, page)["documents"]


def recognition_examination(page_runs: DataFrame, doc: str, page: str, file_digest: Column | None = None, engine: Column | None = None,
                            profiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages and documents of a table of recognition runs.

    ``pages``: the best run of each page with script, language and counts, the agreement of
    its runs (overlap of the first two texts) and what review it needs. ``documents``: text,
    language and script votes, the least agreement over the pages, the conclusion and the
    integrity snapshot. ``profiles`` (language, gram, gain, floor) add the statistical vote of
    each page to its word scores. ``file_digest`` and ``engine`` are columns of the documents.

    Pages shuffle once on (document, page), documents once on the document key.
    """
    best = runs.best_run(page_runs, [doc, page], runs.candidate_score(F.col("confidence"), F.col("text")))
    best = best.withColumnRenamed("confidence", "ocr_confidence")
    stat = None
    if profiles is not None:
        keyed = best.withColumn("_page", F.to_json(F.struct(doc, page)))
        votes = language_profiles.score_profiles(keyed, "_page", profiles)
        best = keyed.join(votes, "_page", "left").drop("_page")
        stat = ("stat_language", "stat_probability")
    agreed = runs.run_consensus(page_runs, [doc, page]).select(doc, page, "agreement_level", "overlap_score")
    named = identify_pages(best, stat=stat).join(agreed, [doc, page], "left")
    kept = runs.validate_pages(named).withColumns({"manual_review": runs.manual_review(F.col("agreement_level")), "status": runs.run_status(F.col("text"))})
    # the page results feed several groupings: finish them once
    pages = cut_lineage(kept.select(doc, page, "text", "script", "language", "language_confidence", "ocr_confidence", "agreement_level", "overlap_score", "manual_review", "status"))
    text = runs.assemble_documents(pages, [doc], page)
    vote = runs.language_vote(pages, [doc], page)
    script = runs.script_vote(pages, [doc], page)
    agreement = pages.groupBy(doc).agg(F.min("overlap_score").alias("least_overlap"), F.count_if(F.col("manual_review") == "Required").alias("pages_to_review"))
    documents = text.join(vote, doc).join(script, doc, "left").join(agreement, doc)
    none = F.lit(None).cast("string")
    documents = documents.withColumns({
        "conclusion": runs.reliability_conclusion(F.col("overall_confidence")),
        "snapshot": integrity.snapshot(F.col("total_text"), none if file_digest is None else file_digest, none if engine is None else engine)})
    return {"pages": pages, "documents": documents}


def examine_metadata(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(property rows, one facts row with flags per file) of a binary scan."""
    found = metadata_examination(files)
    return found["properties"], found["facts"]


def metadata_examination(files: DataFrame, supplied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the metadata examination of a binary scan finds.

    ``supplied`` are property rows (evidence_id, property, value, source) of decoders that
    are not part of the library: EXIF, EXIF GPS, IPTC / IIM, PDF Info. Their evidence_id is
    the file's path. Returned: ``properties`` with their category, ``facts`` with flags and
    inconsistencies (and the number of software indicators), ``timeline``, ``summary``, ``anomalies``,
    ``quality`` and ``software``, the indicators.

    The content is read once: digests, signature, packet, active content and container
    segments are kept in a checkpoint without it, and everything else comes from there.
    """
    named = files.withColumn("evidence_id", F.col("path"))
    examined = metadata.examine(named).withColumn("segments", metadata.segment_array(F.col("content")))
    seen = cut_lineage(examined.drop("content"))
    segments = metadata.segment_relation(seen)
    props = (
        metadata.filesystem_rows(seen)
        .unionByName(metadata.byte_order_rows(seen))
        .unionByName(metadata.xmp_rows(seen).drop("n"))
        .unionByName(metadata.segment_rows(segments))
    )
    if supplied is not None:
        props = props.unionByName(supplied.select(*metadata.ROW))
    props = cut_lineage(metadata.route_rows(props))
    p, s, v = F.col("property"), F.col("source"), F.col("value")
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    marks = props.groupBy("evidence_id").agg(
        any_of((s == "EXIF") & ~p.endswith("Status")).alias("exif_present"), any_of((s == "EXIF GPS") & (p == "GPS Present") & (v == "YES")).alias("gps_present"),
        any_of(p.contains("Thumbnail") & ~F.upper(v).isin("NO", "NONE", F.upper(F.lit(fixed.NOT_AVAILABLE)))).alias("has_thumbnail"),
        F.min(F.when((s == "PDF Info") & (F.lower(p) == "creator"), v)).alias("creator"), F.min(F.when((s == "PDF Info") & (F.lower(p) == "producer"), v)).alias("producer"))
    wide = metadata.file_facts(props)
    software = cut_lineage(metadata.software_indicator_rows(props))
    n_software = software.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("software_indicators"))
    facts = seen.drop("segments").join(n_software, "evidence_id", "left").join(marks, "evidence_id", "left").join(metadata.frame_sizes(segments), "evidence_id", "left").join(wide, "evidence_id", "left")
    facts = metadata.consistency(facts.withColumns({
        "exif_width": F.col("exif_width").try_cast("int"), "exif_height": F.col("exif_height").try_cast("int"), "xmp_present": F.col("packet").isNotNull()}))
    found = facts.select("evidence_id", F.coalesce("software", F.lit("")).alias("software"), F.coalesce("creator", F.lit("")).alias("creator"),
                         F.coalesce("producer", F.lit("")).alias("producer"), F.col("detected_format").alias("file_type"), "inconsistencies")
    return {"properties": props.select(*metadata.ROW), "routed": props, "facts": facts, "timeline": metadata.observed_timeline(props),
            "summary": metadata.examination_summary(props), "anomalies": metadata.anomalies(found), "quality": metadata.jpeg_quality(segments), "software": software}


def histogram_examination(images: DataFrame) -> dict[str, DataFrame]:
    """Histogram, statistics, clipping and tones of decoded images.

    Samples are counted once; everything else derives from at most 256 counts per
    image and channel.
    """
    colour = images.where(F.size("channels") > 1)  # a gray image's plane is its gray already
    counts = cut_lineage(raster.bin_counts(raster.colour_only(raster.pixels(colour)).unionByName(
        raster.gray_samples(images).select("image_id", "y", "x", "ch", "v"))))
    gray = raster.select_channel(counts)
    return {"histogram": raster.histogram_from(counts), "statistics": raster.statistics(gray), "channels": raster.statistics(counts),
            "clipping": raster.clipping(counts), "tonal": raster.tonal_split(gray),
            "invariant": raster.histogram_invariant(counts, images)}
