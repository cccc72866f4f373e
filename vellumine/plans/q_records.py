"""Record and integrity operators over the test tables.

Stand-ins: orders are cases, lineitem and documents their evidence, events the audit
log. The "current scan" of documents is the part covered by labels, with the content
of items marked toxic altered: the others are missing, the altered ones changed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import files, fixed, text as tx, times
from vellumine.operators import integrity as ig, records as rc
from vellumine.plans.registry import query, table


def cases(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.format_string("CASE-%d-%06d", F.year("o_orderdate"), "o_orderkey").alias("case_id"),
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"),
        F.col("o_orderpriority").alias("case_name"), F.col("o_orderstatus").alias("status"),
        "o_totalprice", F.col("o_orderdate").alias("modified_at"))


CASES_SQL = """cases AS (SELECT printf('CASE-%d-%06d', year(o_orderdate), o_orderkey) AS case_id, o_orderkey,
  year(o_orderdate) AS year, o_orderpriority AS case_name, o_orderstatus AS status, o_totalprice,
  o_orderdate AS modified_at FROM orders)"""


@query("s03_human_size", """
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS size_text,
  CASE WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) || ' (' || format('{:,}', b) || ' bytes)'
  WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0::DOUBLE) || ' (' || format('{:,}', b) || ' bytes)'
  ELSE printf('%d bytes', b) END AS exact_text
FROM (SELECT doc_id, strlen(text)::BIGINT AS b FROM documents)""")
def s03(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("b"))
    return docs.select("doc_id", files.human_size(F.col("b")).alias("size_text"),
                       files.exact_size(F.col("b")).alias("exact_text"))


@query("s06_schema_evolution", """
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS notes, 1 AS version FROM orders
UNION ALL SELECT c_custkey, 'OPEN', c_mktsegment, 2 FROM customer""")
def s06(spark, d):
    from vellumine.sources.tables import with_defaults
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                                           F.col("o_orderpriority").alias("notes"), F.lit(1).alias("version"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("notes"),
                                             F.lit(2).alias("version"))
    return with_defaults(old.unionByName(new, allowMissingColumns=True), {"status": "OPEN"})


@query("r01_list_cases", f"WITH {CASES_SQL} SELECT case_id, case_name, modified_at FROM cases WHERE status = 'O'")
def r01(spark, d):
    return rc.list_cases(cases(spark, d), "O").select("case_id", "case_name", "modified_at")


@query("r02_key_lookup", f"""WITH {CASES_SQL} SELECT case_id, status FROM cases
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def r02(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rc.lookup(cases(spark, d), keys, ["o_orderkey"]).select("case_id", "status")


@query("r03_insert_new", """
WITH batch AS (SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS case_id, c_name FROM customer),
known AS (SELECT p_type || '-' || p_size AS case_id FROM part UNION ALL SELECT 'BUILDING-' || n_nationkey FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c_custkey) AS rn,
  case_id IN (SELECT case_id FROM known) AS k FROM batch)
SELECT case_id, c_custkey, c_name AS title, upper('open') AS status,
  CASE WHEN rn = 1 AND NOT k THEN 'accepted' ELSE 'rejected' END AS outcome FROM r""")
def r03(spark, d):
    batch = table(spark, d, "customer").select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("case_id"), "c_custkey",
        F.lit("").alias("case_name"), F.col("c_name").alias("title"), F.lit("open").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"))
    known = table(spark, d, "part").select(F.concat_ws("-", "p_type", "p_size").alias("case_id")).unionByName(
        table(spark, d, "nation").select(F.concat(F.lit("BUILDING-"), F.col("n_nationkey")).alias("case_id")))
    ok, refused = rc.insert_new(known, rc.canonical_case(batch), "case_id", ["c_custkey"])
    return (ok.withColumn("outcome", F.lit("accepted")).unionByName(refused.withColumn("outcome", F.lit("rejected")))
            .select("case_id", "c_custkey", "title", "status", "outcome"))


@query("r04_patch_update", f"""WITH {CASES_SQL}, patch AS (
  SELECT l_orderkey AS o_orderkey, max(l_returnflag || l_linestatus) AS case_name, max(l_shipdate) AS at
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT c.case_id, coalesce(p.case_name, c.case_name) AS case_name, coalesce(p.case_name, c.case_name) AS title,
  c.status, CASE WHEN p.case_name IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE c.modified_at END AS modified_at
FROM cases c LEFT JOIN patch p USING (o_orderkey)""")
def r04(spark, d):
    base = cases(spark, d).withColumn("title", F.col("case_name"))
    patch = (table(spark, d, "lineitem").where(F.col("l_returnflag") != "N")
             .groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("case_name"),
                  F.max("l_shipdate").alias("o_totalprice")))  # not allow-listed: ignored
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    out = rc.apply_patch(base, patch, ["o_orderkey"], fixed.CASE_PATCH_COLUMNS, now=now)
    return out.select("case_id", "case_name", "title", "status", "modified_at")


@query("r05_upsert_state", """
SELECT user_id, event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def r05(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"),
                                         "ts", "event_id")
    state = rc.upsert_latest(e.where(F.col("key") != "click"), e.where(F.col("key") == "click"),
                             ["user_id", "key"], ["ts", "event_id"])
    return state.select("user_id", "key", "value")


@query("r06_cascade_delete", """
SELECT 'evidence' AS child, l_orderkey AS case_key, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2
UNION ALL SELECT 'case', o_orderkey, count(*) FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2""")
def r06(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_key"), "o_orderstatus")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_key"))
    doomed = o.where(F.col("o_orderstatus") == "F")
    left_li, left_o = rc.cascade_delete(doomed, "case_key", li, o.select("case_key"))
    tagged = left_li.select(F.lit("evidence").alias("child"), "case_key").unionByName(
        left_o.select(F.lit("case").alias("child"), "case_key"))
    return tagged.groupBy("child", "case_key").agg(F.count(F.lit(1)).alias("n"))


@query("r07_replace_rows", """
WITH rerun AS (SELECT user_id, event_id, 'rerun' AS event_type FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM rerun)
UNION ALL SELECT * FROM rerun""")
def r07(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    rerun = e.where(F.col("event_type") == "purchase").withColumn("event_type", F.lit("rerun"))
    return rc.replace_rows(e, rerun, ["user_id"])


@query("r08_audit_append", """
SELECT 'U' || user_id AS case_id, 'E' || event_id AS evidence_id, event_type AS operation,
  '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS parameters, ts AS timestamp FROM events""")
def r08(spark, d):
    e = table(spark, d, "events")
    return rc.history_rows(e, F.concat(F.lit("U"), F.col("user_id")), F.concat(F.lit("E"), F.col("event_id")),
                           F.col("event_type"), [F.col("user_id"), F.col("event_type")], F.col("ts"))


@query("r09_case_timeline", """
SELECT user_id, event_id, event_type, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""")
def r09(spark, d):
    from vellumine.functions.numbering import number_rows
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return rc.timeline(number_rows(e, ["user_id"], ["ts", "event_id"]), case_col="user_id", at="ts",
                       tie=["event_id"])


@query("r10_counts", """
SELECT 'all cases' AS what, NULL::BIGINT AS case_key, count(*) AS n FROM orders
UNION ALL SELECT 'evidence', l_orderkey, count(*) FROM lineitem GROUP BY 2""")
def r10(spark, d):
    total = rc.count_cases(table(spark, d, "orders"), "n").select(
        F.lit("all cases").alias("what"), F.lit(None).cast("bigint").alias("case_key"), "n")
    per = rc.count_by_case(table(spark, d, "lineitem"), "l_orderkey", "n")
    return total.unionByName(per.select(F.lit("evidence").alias("what"), F.col("l_orderkey").alias("case_key"), "n"))


@query("r11_next_ids", f"""WITH {CASES_SQL}, fresh AS (
  SELECT c_custkey, 1995 + c_nationkey % 5 AS year FROM customer),
top AS (SELECT year, max(TRY_CAST(split_part(case_id, '-', -1) AS BIGINT)) AS top FROM cases GROUP BY 1)
SELECT f.c_custkey, printf('CASE-%d-%06d', f.year::BIGINT, coalesce(top, 0)::BIGINT
  + row_number() OVER (PARTITION BY f.year ORDER BY f.c_custkey)) AS case_id
FROM fresh f LEFT JOIN top t ON t.year = f.year""")
def r11(spark, d):
    fresh = table(spark, d, "customer").select(
        "c_custkey", (F.lit(1995) + F.col("c_nationkey") % 5).cast("bigint").alias("year"))
    out = rc.assign_ids(fresh, cases(spark, d), "year", "case_id", ["c_custkey"],
                        "CASE-%d-%06d", [F.col("year")])
    return out.select("c_custkey", "case_id")


@query("r12_recent_files", """
SELECT file_path, max(ts) AS opened_at FROM (SELECT '/' || event_type || '/' || user_id AS file_path, ts FROM events)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def r12(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("/"), "event_type", F.lit("/"), "user_id").alias("file_path"),
                                         F.col("ts").alias("opened_at"))
    return rc.recent_files(e, keep=15, show=10)


@query("r13_latest_examination", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(props, event_id) AS props FROM events GROUP BY 1""")
def r13(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    return rc.latest_by(e, ["user_id"], ["event_id"])


@query("r14_examination_list", """
SELECT user_id, event_id, ts, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0 AS n_flags FROM events""")
def r14(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "props", F.col("event_type").alias("flags"))
    out = rc.decode_examination(e, {"props": "map<string,bigint>", "flags": "array<string>"})
    return rc.examinations_of_case(out, "ts", "event_id", "user_id").select(
        "user_id", "event_id", "ts", F.try_element_at("props", F.lit("k")).alias("k"), F.size("flags").alias("n_flags"))


@query("r15_examination_save", """
SELECT event_id, '["' || event_type || '","USER ' || user_id || '"]' AS flags,
  '{"evidence":' || user_id || ',"props":{"k":' || (props->>'$.k') || '}}' AS summary FROM events""")
def r15(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.array("event_type", F.concat(F.lit("USER "), "user_id")).alias("flags"),
        F.struct(F.col("user_id").alias("evidence"), F.from_json("props", "map<string,bigint>").alias("props")).alias("summary"))
    return rc.encode_examination(e, ["flags", "summary"])


@query("r16_runs_of_evidence", """
SELECT conv_id, turn, role, n_pages, length(text) AS n_chars FROM conversations
JOIN (SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY 1) USING (conv_id)""")
def r16(spark, d):
    runs = table(spark, d, "conversations")
    results = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pages"))
    out = rc.runs_of_evidence(runs, results, ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", "role", "n_pages", F.char_length("text").cast("bigint").alias("n_chars"))


@query("r17_evidence_of_case", """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders""")
def r17(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rc.evidence_of_case(o, order=["o_orderdate", "o_orderkey"], case_col="o_custkey")


def scan_and_registry(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    scan = ig.digests(docs.select("doc_id", F.col("source").alias("case_id"),
                                  F.concat(F.lit("/evidence/"), "doc_id").alias("file_path"), "text"), "text").drop("text")
    marks = table(spark, d, "labels").select("doc_id", "toxic")
    seen = docs.join(marks, "doc_id").withColumn(
        "content", F.when(F.col("toxic") == 1, F.concat("text", F.lit("*"))).otherwise(F.col("text")))
    registry = ig.digests(seen).select(
        F.col("source").alias("case_id"), F.concat(F.lit("/evidence/"), "doc_id").alias("file_path"),
        F.format_string("EVD-%06d", F.col("doc_id") + 1).alias("evidence_id"), "sha256", "md5", "doc_id")
    return scan, registry


REGISTRY_SQL = """reg AS (SELECT d.source AS case_id, d.doc_id, printf('EVD-%06d', d.doc_id + 1) AS evidence_id,
  sha256(CASE WHEN l.toxic = 1 THEN d.text || '*' ELSE d.text END) AS sha256,
  md5(CASE WHEN l.toxic = 1 THEN d.text || '*' ELSE d.text END) AS md5
  FROM documents d JOIN labels l USING (doc_id))"""


@query("r18_register_or_reuse", f"""WITH {REGISTRY_SQL},
top AS (SELECT case_id, max(TRY_CAST(split_part(evidence_id, '-', -1) AS BIGINT)) AS top FROM reg GROUP BY 1)
SELECT d.source AS case_id, d.doc_id, r.doc_id IS NOT NULL AS known,
  CASE WHEN r.doc_id IS NOT NULL THEN r.evidence_id ELSE printf('EVD-%06d', coalesce(t.top, 0)::BIGINT
    + row_number() OVER (PARTITION BY d.source, r.doc_id IS NULL ORDER BY d.doc_id)) END AS evidence_id
FROM documents d LEFT JOIN reg r ON r.doc_id = d.doc_id LEFT JOIN top t ON t.case_id = d.source""")
def r18(spark, d):
    scan, registry = scan_and_registry(spark, d)
    out = rc.register_or_reuse(scan, registry.drop("doc_id"), ["doc_id"])
    return out.select("case_id", "doc_id", "known", "evidence_id")


@query("r19_default_case", """
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'CASE-2026-000001' ELSE 'CASE-' || d.source END AS case_id,
  l.doc_id IS NULL AS auto_created FROM documents d LEFT JOIN labels l USING (doc_id)""")
def r19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    marked = docs.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("m")), "doc_id", "left").withColumn(
        "case_id", F.when(F.col("m") == 1, F.concat(F.lit("CASE-"), "source")))
    return rc.default_case(marked, F.lit("CASE-2026-000001")).select("doc_id", "case_id", "auto_created")


@query("r20_name_backfill", """
WITH x AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE ' ' END AS a,
  CASE WHEN p_size < 40 THEN p_type END AS b FROM part)
SELECT p_partkey, coalesce(nullif(trim(a), ''), b, '') AS case_name, coalesce(b, nullif(trim(a), ''), '') AS title FROM x""")
def r20(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" ").alias("case_name"),
        F.when(F.col("p_size") < 40, F.col("p_type")).alias("title"))
    return rc.backfill_names(p)


@query("r21_status_normalise", """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'Completed' ELSE 'pending' END AS s
  FROM orders)
SELECT o_orderkey, CASE WHEN upper(s) IN ('OPEN', 'IN PROGRESS', 'COMPLETED', 'ARCHIVED') THEN upper(s) ELSE s END AS status
FROM x""")
def r21(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "Completed").otherwise("pending")
    return table(spark, d, "orders").select("o_orderkey", rc.normalise_status(raw).alias("status"))


@query("r22_local_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' IST (UTC+05:30)' AS shown_naive,
  strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' IST (UTC+05:30)' AS shown_utc FROM events""")
def r22(spark, d):
    return table(spark, d, "events").select("event_id", times.shown_local(F.col("ts")).alias("shown_naive"),
                                            times.shown_local(F.col("ts"), naive=False).alias("shown_utc"))


@query("r23_text_filter", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""")
def r23(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return p.where(tx.contains_any("RING ", F.col("p_name"), F.col("p_brand"), F.col("p_type")))


@query("r24_digest_abbreviation", """
SELECT doc_id, substr(h, 1, 8) || '...' || right(h, 8) AS short8, substr(h, 1, 16) || '...' || right(h, 8) AS short16,
  CASE WHEN length(lang) > 16 THEN 'x' ELSE lang END AS kept
FROM (SELECT doc_id, lang, sha256(text) AS h FROM documents)""")
def r24(spark, d):
    docs = ig.digests(table(spark, d, "documents").select("doc_id", "text", "lang"), "text")
    return docs.select("doc_id", tx.abbreviate(F.col("sha256")).alias("short8"),
                       tx.abbreviate(F.col("sha256"), 16).alias("short16"), tx.abbreviate(F.col("lang")).alias("kept"))


@query("i01_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def i01(spark, d):
    return ig.digests(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("i02_verify", f"""WITH {REGISTRY_SQL}
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'unknown' WHEN sha256(d.text) = r.sha256 THEN 'match' ELSE 'mismatch' END AS by_sha256,
  CASE WHEN r.doc_id IS NULL THEN 'unknown' WHEN md5(d.text) = r.md5 THEN 'match' ELSE 'mismatch' END AS by_md5
FROM documents d LEFT JOIN reg r ON r.doc_id = d.doc_id""")
def i02(spark, d):
    _, registry = scan_and_registry(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    j = docs.join(registry.select("doc_id", F.upper("sha256").alias("s"), "md5"), "doc_id", "left")
    content = F.when(F.col("s").isNotNull(), F.col("text"))

    def word(v):
        return F.when(v, "match").when(~v, "mismatch").otherwise("unknown")

    return j.select("doc_id", word(ig.verify(content, F.col("s"))).alias("by_sha256"),
                    word(ig.verify(content, F.col("md5"), "md5")).alias("by_md5"))


@query("i03_bulk_reverify", f"""WITH {REGISTRY_SQL}
SELECT CASE WHEN r.doc_id IS NULL THEN 'Missing File' WHEN sha256(d.text) = r.sha256 THEN 'INTEGRITY VERIFIED'
  ELSE 'INTEGRITY CHANGED' END AS status, d.doc_id FROM documents d LEFT JOIN reg r ON r.doc_id = d.doc_id""")
def i03(spark, d):
    stored, now = scan_and_registry(spark, d)
    out = ig.reverify(stored.select("doc_id", "sha256"), now.select("doc_id", F.col("sha256").alias("current_sha256")), ["doc_id"])
    return out.select("status", "doc_id")


@query("i03_verification_totals", f"""WITH {REGISTRY_SQL}
SELECT CASE WHEN r.doc_id IS NULL THEN 'Missing File' WHEN sha256(d.text) = r.sha256 THEN 'INTEGRITY VERIFIED'
  ELSE 'INTEGRITY CHANGED' END AS status, count(*) AS n FROM documents d LEFT JOIN reg r ON r.doc_id = d.doc_id GROUP BY 1""")
def i03_totals(spark, d):
    return ig.verification_totals(i03(spark, d))


@query("i04_reimport_check", f"""WITH {REGISTRY_SQL}
SELECT d.doc_id, CASE WHEN r.doc_id IS NOT NULL AND sha256(d.text) <> r.sha256 THEN 'INTEGRITY CHANGED'
  ELSE 'INTEGRITY VERIFIED' END AS status FROM documents d LEFT JOIN reg r ON r.doc_id = d.doc_id""")
def i04(spark, d):
    scan, registry = scan_and_registry(spark, d)
    out = rc.register_or_reuse(scan, registry.drop("doc_id"), ["doc_id"])
    return out.select("doc_id", "status")


@query("i05_integrity_snapshot", """
SELECT conv_id, turn, sha256(text || md5(role) || 'engine') AS snapshot FROM conversations""")
def i05(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", ig.snapshot(F.col("text"), F.md5(F.col("role").cast("binary")), F.lit("engine")).alias("snapshot"))


@query("i06_intake_status", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Error' ELSE 'Verified' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def i06(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("m")), "doc_id", "left")
    return found.select("doc_id", ig.intake_status(F.when(F.col("m") == 1, F.sha2("text", 256))).alias("status"))


# --- rows with null and tied keys ---------------------------------------------
@query("r03_insert_null_and_tied_keys", """
WITH b AS (SELECT CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey % 5 END AS k FROM customer)
SELECT k, (k IS NOT NULL AND k <> 1)::BIGINT AS n_accepted, count(*) - (k IS NOT NULL AND k <> 1)::BIGINT AS n_rejected FROM b GROUP BY k""")
def r03_odd_keys(spark, d):
    c = table(spark, d, "customer")
    key = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey") % 5)
    batch = c.select(key.alias("k"), F.col("c_mktsegment").alias("o"), F.lit("same").alias("name"))  # few orders: most rows are tied
    base = c.where("c_nationkey % 5 = 1").select((F.col("c_nationkey") % 5).alias("k")).limit(1)
    accepted, rejected = rc.insert_new(base, batch, "k", ["o"])
    both = accepted.select("k", F.lit(1).alias("a")).unionByName(rejected.select("k", F.lit(0).alias("a")))
    return both.groupBy("k").agg(F.sum("a").alias("n_accepted"), F.sum(1 - F.col("a")).alias("n_rejected"))


@query("r11_number_null_groups", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 7 > 0 THEN user_id % 7 END AS g, CASE WHEN event_id % 11 > 0 THEN event_id END AS o FROM events)
SELECT event_id, g, row_number() OVER (PARTITION BY g ORDER BY o NULLS FIRST, event_id) AS seq FROM e""")
def r11_null_groups(spark, d):
    from vellumine.functions.numbering import number_rows

    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7).alias("g"), F.when(F.col("event_id") % 11 > 0, F.col("event_id")).alias("o"))
    return number_rows(e, ["g"], ["o", "event_id"], chunk_rows=64).select("event_id", "g", "seq")
