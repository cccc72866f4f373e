"""Records, numbering, durable tables, runs, findings and slots."""

import collections
import datetime as dt
import pathlib

import pytest
from pyspark.sql import Window as W, functions as F

from vellumine.functions import times
from vellumine.functions.numbering import hash_order, number_rows, quantile_bounds, _placed
from vellumine.operators import findings as fi, records as rc, runs as rn, slots
from vellumine.plans import flows
from vellumine.sources import sinks
from vellumine.sources.tables import EvidenceTables


def test_name_and_title_mirror(spark):
    df = spark.createDataFrame([("A", ""), (None, "B"), (" ", None), ("A", "B")], "case_name string, title string")
    assert [tuple(r) for r in rc.backfill_names(df).collect()] == [("A", "A"), ("B", "B"), ("", ""), ("A", "B")]


def test_local_time_names_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, 0),), (dt.datetime(1969, 1, 1),), (None,)], "t timestamp_ntz")
    rows = df.select(times.shown_local(F.col("t")).alias("a"), times.shown_local(F.col("t"), naive=False).alias("b")).collect()
    assert rows[0].a == "2026-01-01 00:00:00 IST (UTC+05:30)" and rows[0].b == "2026-01-01 05:30:00 IST (UTC+05:30)"
    assert rows[1].b is None and rows[2].a is None


def test_ids_continue_after_the_highest(spark):
    old = spark.createDataFrame([("2026", "CASE-2026-000007"), ("2026", "CASE-2026-x"), ("2025", "CASE-2025-000100")], "year string, case_id string")
    new = spark.createDataFrame([(1, "2026"), (2, "2026"), (3, "2027")], "k long, year string")
    out = rc.assign_ids(new, old, "year", "case_id", ["k"], "CASE-%s-%06d", [F.col("year")])
    assert {r.k: r.case_id for r in out.collect()} == {1: "CASE-2026-000008", 2: "CASE-2026-000009", 3: "CASE-2027-000001"}


def test_numbering_of_a_hot_group(spark):
    # one group holds two thirds of the rows
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7))
    want = df.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy("id")))
    for rows in (1 << 20, 2000, 64, 7):
        got = number_rows(df, ["g"], ["id"], chunk_rows=rows).withColumnRenamed("id", "i")
        both = want.join(got, want.id == got.i)
        assert got.columns == ["i", "g", "seq"] and both.count() == 20_000 and both.where("want <> seq").count() == 0
    hashed = number_rows(df.withColumn("p", F.col("id").cast("string")), ["g"], [hash_order("p"), F.col("p")], chunk_rows=500)
    assert hashed.groupBy("g").agg((F.max("seq") == F.count("*")).alias("a"), (F.countDistinct("seq") == F.count("*")).alias("b")).where("NOT a OR NOT b").count() == 0


def test_only_hot_groups_are_cut_into_even_parts(spark):
    df = spark.range(60_000).withColumn("g", F.when(F.col("id") % 3 < 2, F.lit(None)).otherwise(F.col("id") % 997))
    placed = _placed(df.withColumn("same", F.lit(1)), ["g"], ["same"])  # ties all along
    bounds = quantile_bounds(placed, 4096).collect()
    assert len(bounds) == 1 and bounds[0]._g.g0 is None and 5 <= len(bounds[0]._bounds) <= 15
    parts = placed.where("g IS NULL").groupBy(F.size(F.filter(F.lit([b.row for b in bounds[0]._bounds]), lambda b: b <= F.col("_o.row")))).count().collect()
    assert max(r["count"] for r in parts) < 3 * 4096
    assert number_rows(df, ["g"], ["id"], within=["id"]).where("seq <> 1").count() == 0
    assert number_rows(df.limit(0), ["g"], ["id"]).count() == 0


def test_numbering_carries_no_bounds_and_measures_few_rows(spark, monkeypatch):
    from vellumine.functions import numbering

    monkeypatch.setattr(numbering, "MOST_BOUNDS", 40)
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS g", "id")
    bounds = quantile_bounds(_placed(df, ["g"], ["id"]), 64).collect()
    assert len(bounds) == 3 and all(25 <= len(r._bounds) <= 60 for r in bounds)
    out = number_rows(df, ["g"], ["id"], chunk_rows=64)
    assert {(r.id, r.seq) for r in out.collect()} == {(i, i // 3 + 1) for i in range(20_000)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # rows are numbered once; parts are counted, so no row takes its group's bounds through a shuffle
    assert plan.count("row_number()") == 1


def test_a_registration_joins_once(spark):
    scan = spark.range(3000).selectExpr("IF(id % 3 < 2, 'hot', 'c' || id % 5) AS case_id", "'f' || id AS file_path", "sha2(CAST(id AS STRING), 256) AS sha256")
    registry = scan.where("file_path LIKE '%7%'").selectExpr("*", "format_string('EVD-%06d', row_number() OVER (PARTITION BY case_id ORDER BY file_path)) AS evidence_id")
    out = rc.register_or_reuse(scan, registry, ["file_path"])
    assert out.count() == 3000 and out.select("case_id", "evidence_id").distinct().count() == 3000
    known = registry.join(out.withColumnRenamed("evidence_id", "e"), ["case_id", "file_path"])
    assert known.count() == registry.count() == known.where("known AND e = evidence_id AND status = 'INTEGRITY VERIFIED'").count()
    numbers = out.groupBy("case_id").agg((F.max("evidence_id") == F.format_string("EVD-%06d", F.count("*"))).alias("dense")).collect()
    assert all(r.dense for r in numbers)


def test_patch_ignores_other_columns(spark):
    base = spark.createDataFrame([("c1", "A", "A", "OPEN"), ("c2", "B", "B", "OPEN")], "case_id string, case_name string, title string, status string")
    patch = spark.createDataFrame([("c1", "New", "x")], "case_id string, title string, secret string")
    out = {r.case_id: r for r in rc.apply_patch(base, patch, ["case_id"], ["title", "case_name", "status"], touched=None).collect()}
    assert (out["c1"].case_name, out["c1"].title, out["c2"].title) == ("New", "New", "B") and "secret" not in out["c1"]


def case(spark, case_id, title):
    return spark.createDataFrame([(case_id, title)], "case_id string, title string")


def test_durable_tables(spark, tmp_path):
    t = EvidenceTables(spark, str(tmp_path), buckets=4)
    for i in range(6):
        t.append("cases", case(spark, f"C{i}", f"T{i}"))
        t.append("evidence_items", spark.createDataFrame([(f"C{i}", f"EVD-{j:06d}", f"/f/{j}") for j in range(3)], "case_id string, evidence_id string, file_path string"))
    row = t.read_case("cases", "C3").first()
    assert row.title == "T3" and row.status == "OPEN" and row.examiner == ""
    assert t.read("evidence_items").where("page_count = 1 AND NOT reviewed").count() == 18
    plan = t.read_case("cases", "C3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(case_bucket" in plan
    t.replace("evidence_items", spark.createDataFrame([("C1", "EVD-000000", "/new")], "case_id string, evidence_id string, file_path string"), ["case_id"])
    assert t.read("evidence_items").count() == 16
    t.delete_cases(case(spark, "C1", "").unionByName(case(spark, "C2", "")))
    assert t.read("evidence_items").count() == 12 and t.read("cases").count() == 4
    assert {r.case_id for r in t.read("evidence_items").select("case_id").distinct().collect()} == {"C0", "C3", "C4", "C5"}


def test_delete_that_empties_a_folder(spark, tmp_path):
    t = EvidenceTables(spark, str(tmp_path), buckets=1)
    t.append("cases", case(spark, "only", "x"))
    t.delete_cases(case(spark, "only", ""))
    assert spark.read.parquet(t.path("cases")).count() == 0 if any((tmp_path / "cases").glob("case_bucket=*")) else True


ITEM = "case_id string, evidence_id string, file_path string"


def items(spark, case, first, last, note="/f/"):
    return spark.range(first, last).selectExpr(f"'{case}' AS case_id", "format_string('EVD-%06d', id) AS evidence_id", f"'{note}' || id AS file_path")


def files_of(t, name="evidence_items"):
    return {p.relative_to(t.path(name)).as_posix(): p.stat().st_mtime_ns for p in pathlib.Path(t.path(name)).rglob("part-*.parquet")}


def test_a_large_case_fills_many_folders(spark, tmp_path):
    t = EvidenceTables(spark, str(tmp_path), buckets=4, folder_rows=100)
    t.append("evidence_items", items(spark, "hot", 0, 150).unionByName(items(spark, "cold", 0, 5)))
    first = {f.split("/")[0] for f in files_of(t)}
    t.append("evidence_items", items(spark, "hot", 150, 3000))
    folders = {f.split("/")[0] for f in files_of(t)}
    assert len(first) <= 3 and 30 <= len(folders) <= 40
    assert t.read_case("evidence_items", "hot").count() == 3000 and t.read_case("evidence_items", "cold").count() == 5
    for i in (0, 149, 150, 2999):  # of any age, out of one folder per size that the bucket had
        one = t.read_case("evidence_items", "hot", f"EVD-{i:06d}")
        assert [r.file_path for r in one.collect()] == [f"/f/{i}"] and len(one.inputFiles()) <= len(files_of(t))
        scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
        assert "case_bucket" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    per = t.read("evidence_items").where("case_id = 'hot'").groupBy(F.input_file_name()).count()
    assert per.agg(F.max("count")).first()[0] < 400


def test_a_replacement_rewrites_its_files_only(spark, tmp_path):
    t = EvidenceTables(spark, str(tmp_path), buckets=2, folder_rows=50)
    for i in range(12):
        t.append("evidence_items", items(spark, f"C{i}", 0, 20))
    before = files_of(t)
    new = items(spark, "C3", 5, 7, "/new/").unionByName(items(spark, "C99", 1, 2, "/new/"))
    old = t.touched_files("evidence_items", new, ["case_id", "evidence_id"])
    t.replace("evidence_items", new, ["case_id", "evidence_id"])
    after = files_of(t)
    assert 1 <= len(old) <= 2 and set(before) - set(after) == set(old) and all(after[f] == before[f] for f in set(before) & set(after))
    rows = {(r.case_id, r.evidence_id): r.file_path for r in t.read("evidence_items").collect()}
    assert len(rows) == t.read("evidence_items").count() == 241
    assert rows["C3", "EVD-000005"] == "/new/5" and rows["C3", "EVD-000007"] == "/f/7" and rows["C99", "EVD-000001"] == "/new/1"
    assert t._counts("evidence_items").agg(F.sum("n")).first()[0] == 243  # rows that only moved are not counted again


@pytest.mark.parametrize("step", ["deleted", "half moved"])
def test_a_broken_rewrite_is_ended_by_the_next_reader(spark, tmp_path, monkeypatch, step):
    t = EvidenceTables(spark, str(tmp_path), buckets=8)
    t.append("evidence_items", items(spark, "A", 0, 10).unionByName(items(spark, "B", 0, 10)))
    finish = EvidenceTables._finish
    monkeypatch.setattr(EvidenceTables, "_finish", lambda self, name, label: None)  # the driver is lost after the journal
    t.replace("evidence_items", items(spark, "A", 3, 4, "/new/").unionByName(items(spark, "B", 3, 4, "/new/")), ["case_id", "evidence_id"])
    monkeypatch.setattr(EvidenceTables, "_finish", finish)
    journal = next((tmp_path / "_journal" / "evidence_items").iterdir())
    for r in spark.read.parquet(str(journal)).collect():
        (tmp_path / "evidence_items" / r.file).unlink()
    if step == "half moved":
        done = next((tmp_path / "_aside" / "evidence_items").rglob("part-*.parquet"))
        target = tmp_path / "evidence_items" / done.parent.name / done.name
        target.parent.mkdir(exist_ok=True)
        done.rename(target)
    again = EvidenceTables(spark, str(tmp_path), buckets=8)
    rows = {(r.case_id, r.evidence_id): r.file_path for r in again.read("evidence_items").collect()}
    assert len(rows) == 20 and again.read("evidence_items").count() == 20 and rows["A", "EVD-000003"] == "/new/3"
    assert not list((tmp_path / "_journal" / "evidence_items").iterdir())


@pytest.mark.parametrize("reached", [True, False])
def test_many_folders_are_written_and_moved_by_tasks(spark, tmp_path, monkeypatch, reached):
    monkeypatch.setattr("vellumine.sources.tables.MOVES_A_TASK", 8)
    if not reached:  # a store that only Spark opens
        monkeypatch.setattr(EvidenceTables, "_tasks_reach", lambda self: False)
    t = EvidenceTables(spark, str(tmp_path), buckets=4, folder_rows=20)
    t.append("evidence_items", items(spark, "hot", 0, 3000).unionByName(items(spark, "cold", 0, 5)))
    folders = collections.Counter(f.split("/")[0] for f in files_of(t))
    tasks = {f.split("/part-")[1][:5] for f in files_of(t)}
    assert len(folders) > 100 and max(folders.values()) == 1 and len(tasks) >= 4
    t.replace("evidence_items", items(spark, "hot", 0, 300, "/new/"), ["case_id", "evidence_id"])
    # what stays and what is new of a folder is one file
    assert max(collections.Counter(f.split("/")[0] for f in files_of(t)).values()) == 1
    t.delete_cases(case(spark, "cold", ""), ["evidence_items"])
    rows = {r.evidence_id: r.file_path for r in t.read("evidence_items").collect()}
    assert len(rows) == t.read("evidence_items").count() == 3000
    assert rows["EVD-000299"] == "/new/299" and rows["EVD-000300"] == "/f/300"
    assert not list((tmp_path / "_aside" / "evidence_items").iterdir()) and not list((tmp_path / "_journal" / "evidence_items").iterdir())
    held = {p.name for p in pathlib.Path(t.path("evidence_items")).rglob("*.parquet")}
    assert {f".{n}.crc" for n in held} == {p.name for p in pathlib.Path(t.path("evidence_items")).rglob(".part-*.crc")}


def test_older_files_get_defaults(spark, tmp_path):
    t = EvidenceTables(spark, str(tmp_path))
    old = spark.createDataFrame([("C1", "Legacy", 0)], "case_id string, title string, case_bucket int")
    old.write.partitionBy("case_bucket").parquet(t.path("cases"))
    row = rc.backfill_names(t.read("cases")).first()
    assert (row.case_name, row.title, row.status) == ("Legacy", "Legacy", "OPEN")


# --- runs --------------------------------------------------------------------
RUN = "page string, run_no int, engine string, confidence double, text string"


def test_consensus_cases(spark):
    runs = spark.createDataFrame([
        ("two", 0, "a", 90.0, "x y z"), ("two", 1, "b", 50.0, "x y"), ("two", 2, "c", 10.0, "q"),
        ("one", 0, "a", 12.0, " "), ("one", 1, "b", 80.0, "text"), ("none", 0, "a", 5.0, "")], RUN)
    got = {r.page: r for r in rn.run_consensus(runs, ["page"]).collect()}
    assert (got["two"].agreement_level, got["two"].overall_confidence) == ("Medium", 50.0) and abs(got["two"].overlap_score - 2 / 3) < 1e-12
    assert (got["one"].agreement_level, got["one"].overall_confidence, got["one"].overlap_score) == ("N/A (Single Run)", 12.0, 1.0)
    assert (got["none"].agreement_level, got["none"].overall_confidence) == ("Low", 0.0)


def test_stability_cases(spark):
    runs = spark.createDataFrame([
        ("same", 0, "a", 0.0, "x y"), ("same", 1, "a", 0.0, "y x"), ("far", 0, "a", 0.0, "x y"), ("far", 1, "a", 0.0, "p q"),
        ("one", 0, "a", 0.0, "x"), ("none", 0, "a", 0.0, " ")], RUN)
    got = {r.page: (r.stability_score, r.profile) for r in rn.run_stability(runs, ["page"]).collect()}
    assert got == {"same": (100.0, "Highly Stable"), "far": (0.0, "Highly Unstable"), "one": (50.0, "Weak (Only one variant produced text)"), "none": (0.0, "Unstable (No Text)")}


def test_incumbent_keeps_a_tie(spark):
    broad = spark.createDataFrame([("p", "broad", 60.0, "abc")], "page string, engine string, confidence double, text string")
    runs = spark.createDataFrame([("p", 0, "c1", 60.0, "long text"), ("p", 1, "c2", 110.0, "ab")], RUN)
    assert rn.best_candidate(broad, runs, ["page"]).first().engine == "broad"


def test_long_document_is_whole_and_ordered(spark):
    pages = spark.range(1000).select(F.lit("d").alias("doc"), F.col("id").alias("page_number"), F.concat(F.lit("p"), "id").alias("text"))
    row = rn.assemble_documents(pages.repartition(7), ["doc"]).first()
    assert row.total_text == "\n\n--- Page Break ---\n\n".join(f"p{i}" for i in range(1000)) and row.total_words == 1000


def test_garbage(spark):
    df = spark.createDataFrame([("", "Tamil", 50.0), ("fine text", "Latin", 10.0), ("!!!???a", "Latin", 50.0), ("abcdefgh", "Tamil", 50.0), ("இது ஒரு சோதனை", "Tamil", 50.0), ("fine text", "Latin", 0.0)], "t string, s string, c double")
    assert [r[0] for r in df.select(rn.is_garbage(F.col("t"), F.col("s"), F.col("c"))).collect()] == [True, True, True, True, False, False]


def test_document_flow_and_json(spark, tmp_path):
    runs = spark.createDataFrame([
        ("d", 1, 0, "a", 80.0, "This is page one of the text"), ("d", 1, 1, "b", 90.0, "This is page one of the text!"), ("d", 2, 0, "a", 95.0, "यह एक परीक्षण है और इस में हिन्दी के शब्द हैं")],
        "doc string, page_number int, run_no int, engine string, confidence double, text string")
    docs = flows.recognise_documents(runs, "doc", "page_number")
    row = docs.first()
    assert row.total_pages == 2 and row.overall_language == "English" and row.is_multi_language and row.overall_script == "Latin"
    pages = runs.where("run_no = 0").select("doc", "page_number", "text", F.lit(b"x").alias("thumb"))
    sinks.write_json(sinks.document_json(docs, pages, "doc"), str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).first()
    assert [p.page_number for p in back.pages] == [1, 2] and "thumb" not in back.pages[0]
    text = [r.text for r in sinks.ocr_report(docs, "doc").orderBy("line_no").collect()]
    assert "Language:       English" in text and text[-1].startswith("This is page one")


# --- findings, slots ---------------------------------------------------------
def test_findings_defaults_and_order(spark):
    df = fi.new_findings(spark.createDataFrame([("m", "Critical"), ("m", None), ("m", "Low")], "module string, severity string"))
    assert [r.severity for r in fi.by_severity(df).collect()] == ["Critical", "Medium", "Low"]
    assert {r.status for r in df.collect()} == {"Potential Anomaly"}


def test_fusion_never_invents(spark):
    ev = spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")
    res = spark.createDataFrame([("e1", "Metadata Analysis", "Complete", 70.0, "Strong")], "evidence_id string, module string, status string, confidence double, evidence_strength string")
    m = fi.fusion_matrix(ev, res)
    assert m.count() == 20 and m.where("status = 'Analysis Pending' AND confidence = 0").count() == 19
    assert {r.evidence_id: r.assessment for r in fi.overall_assessment(m).collect()} == {"e1": "Partially Assessed", "e2": "Analysis Pending"}


def test_failing_recogniser_reports(spark):
    def broken(batches):
        raise RuntimeError("no model")
        yield
    engine = slots.Recogniser("broken", broken, {"Hindi": "hin"}, fallbacks={"Dogri": "hin"})
    pages = spark.createDataFrame([("p", "Dogri", b"x")], "page_key string, language string, content binary")
    row = slots.recognise(slots.assign_engine(pages, [engine]), [engine]).first()
    assert row.error == "broken error: no model" and row.text == ""
    assert slots.recognise(slots.assign_engine(pages, []), []).first().error == "No OCR engines available."
    assert "not installed" in slots.Recogniser("x", broken, {}, available=False).status()


def _pages(spark, n):
    return spark.range(n).selectExpr("'p' || id AS page_key", "'Hindi' AS language", "CAST('x' AS BINARY) AS content")


def _engines():
    """Functions that travel to the tasks by value."""
    def read(part):
        return part.assign(text="ok", confidence=90.0, word_confidences=[[]] * len(part))

    def at_once(batches):
        raise RuntimeError("no model")

    def nothing(batches):
        return iter(())

    def after_the_last(batches):
        for b in batches:
            yield read(b)
        raise RuntimeError("late")

    def one_batch_only(batches):
        yield read(next(batches))

    def twice_and_strangers(batches):
        for b in batches:
            yield read(b)
            yield read(b)
            yield read(b.assign(page_key="stranger"))

    def without_text(batches):
        yield from batches

    return locals()


@pytest.mark.parametrize(("engine", "text", "error"), [
    ("at_once", "", "e error: no model"), ("nothing", "", "e error: no result"), ("after_the_last", "ok", ""), ("one_batch_only", "ok", ""),
    ("twice_and_strangers", "ok", ""), ("without_text", "", None)])
def test_every_page_gets_one_row(spark, engine, text, error):
    engines = [slots.Recogniser("e", _engines()[engine], {"Hindi": "hin"})]
    for n in (1, 1000):  # 1000 pages are several Arrow batches of a task
        got = slots.recognise(slots.assign_engine(_pages(spark, n).coalesce(1), engines), engines).collect()
        assert sorted(r.page_key for r in got) == sorted(f"p{i}" for i in range(n))
        assert {r.text for r in got} == {text} and all(bool(r.error) if error is None else r.error == error for r in got)


def test_equal_page_keys_are_pages_each(spark):
    engines = [slots.Recogniser("e", _engines()["after_the_last"], {"Hindi": "hin"})]
    pages = _pages(spark, 5).withColumn("page_key", F.when(F.col("page_key") < "p3", F.lit("same"))).coalesce(1)
    assert sorted(str(r.page_key) for r in slots.recognise(slots.assign_engine(pages, engines), engines).collect()) == ["None", "None", "same", "same", "same"]


def test_module_slots(spark):
    ev = spark.createDataFrame([("e",)], "evidence_id string")
    assert slots.run_analyses(ev, slots.default_modules()).count() == 0
    assert spark.range(1).select(slots.module_status(slots.default_modules())).first()[0]["Splicing Analysis"] == "Analysis engine not connected"


@pytest.mark.parametrize("at", [None, "2026-01-01"])
def test_default_case_events(spark, at):
    df = rc.default_case(spark.createDataFrame([("f1", None), ("f2", "C")], "file string, case_id string"), F.lit("CASE-2026-000001"))
    ev = rc.auto_case_events(df, F.lit(at).cast("timestamp") if at else None).collect()
    assert [(e.case_id, e.event_type) for e in ev] == [("CASE-2026-000001", "Case Created")]


def test_insert_new_accounts_for_every_row(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)], "k string, o int")
    base = spark.createDataFrame([("b",), (None,)], "k string")
    accepted, rejected = rc.insert_new(base, batch, "k", ["o"])
    assert [tuple(r) for r in accepted.collect()] == [("a", 1)]
    assert sorted(map(str, (tuple(r) for r in rejected.collect()))) == sorted(map(str, [("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)]))


def test_documents_of_unknown_pages_stay(spark):
    pages = spark.createDataFrame([("d1", "Unknown"), ("d2", "Hindi"), ("d2", "Unknown")], "doc string, language string")
    got = {r.doc: (r.detected_languages, r.is_multi_language) for r in rn.document_languages(pages, ["doc"]).collect()}
    assert got == {"d1": ([], False), "d2": (["Hindi"], False)}


def test_only_failing_pages_fail_and_models_load_once(spark, tmp_path):
    folder = str(tmp_path)

    def read(batches):
        import os
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()  # a load
        for b in batches:
            if "p2" in list(b["page_key"]):
                raise ValueError("bad page")
            yield b.assign(text="ok", confidence=90.0, word_confidences=[[]] * len(b))

    engine = slots.Recogniser("one", read, {"Hindi": "hin"})
    pages = spark.createDataFrame([(f"p{i}", "Hindi", b"x") for i in range(4)], "page_key string, language string, content binary").coalesce(1)
    got = {r.page_key: (r.text, r.error) for r in slots.recognise(slots.assign_engine(pages, [engine]), [engine]).collect()}
    assert got == {"p0": ("ok", ""), "p1": ("ok", ""), "p2": ("", "one error: bad page"), "p3": ("ok", "")}
    many = spark.range(3000).selectExpr("'q' || id AS page_key", "'Hindi' AS language", "CAST('x' AS BINARY) AS content").coalesce(1)
    import os
    before = len(os.listdir(folder))
    assert slots.recognise(slots.assign_engine(many, [engine]), [engine]).count() == 3000
    assert len(os.listdir(folder)) - before == 1


def test_engines_get_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(slots, "BATCH_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"page_key": [str(i) for i in range(40)], "content": [b"x" * 300] * 20 + [None, b"", b"y" * 5000] + [b"z"] * 17})
    parts = list(slots.bounded(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.num_rows for p in parts)
    assert all(p.num_rows == 1 or sum(len(c or b"") for c in p.column("content").to_pylist()) <= 1000 for p in parts)

    def sizes(batches):
        for b in batches:
            yield b.assign(text=str(sum(len(c) for c in b["content"])), confidence=1, word_confidences=[[1.0]] * len(b))[["page_key", "text", "confidence", "word_confidences"]]

    most = slots.BATCH_BYTES = 4 << 20
    engine = slots.Recogniser("sizes", sizes, {"en": "eng"})
    pages = spark.range(0, 60, 1, 1).selectExpr("CAST(id AS STRING) AS page_key", "'en' AS language", "CAST(repeat('x', 500000) AS BINARY) AS content")
    got = slots.recognise(slots.assign_engine(pages, [engine]), [engine]).collect()
    assert len(got) == 60 and max(int(r.text) for r in got) <= most and {r.confidence for r in got} == {1.0}
