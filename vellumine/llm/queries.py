"""One registered query per operator of this folder, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op2_mix_sources", r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS okey,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
k AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS kind FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS w, 3.0::DOUBLE * total AS lim FROM k),
l AS (SELECT *, (sum(total) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY lim / w, source NULLS FIRST) AS place
  FROM w WINDOW b AS (ORDER BY lim / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, total, w, [7.0, 2.0, 0.5][kind + 1]::DOUBLE AS a, [3.0, 2.0, 1.5][kind + 1]::DOUBLE AS b,
  coalesce(least(lim, w * arg_min(level, place) FILTER (lim >= level * w) OVER ()), 0)::DOUBLE AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.okey, d.size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target, (size * ((before + size / 2 < target AND size > 0)::INT
  + (total + before + size / 2 < target AND size > 0)::INT + (2 * total + before + size / 2 < target AND size > 0)::INT))::BIGINT AS taken,
  list_transform(list_filter([before::DOUBLE + size::DOUBLE / 2, (total + before)::DOUBLE + size::DOUBLE / 2, (2 * total + before)::DOUBLE + size::DOUBLE / 2], lambda m: m < target AND size > 0),
    lambda m: greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0::DOUBLE * ((m / target) * w) / (a + sqrt(greatest(a * a + 2.0::DOUBLE * (b - a) * ((m / target) * w), 0.0::DOUBLE)))))) AS positions FROM p
""")
def op2_mix_sources(spark, sf_dir):
    from vellumine.llm.mixing import in_order, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, carry=["doc_id"]).withColumn("first", F.get("positions", F.lit(0)))
    return in_order(mixed, "first", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "positions")


@query("op2_training_order", r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS okey,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
k AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS kind FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS w, 3.0::DOUBLE * total AS lim FROM k),
l AS (SELECT *, (sum(total) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY lim / w, source NULLS FIRST) AS place
  FROM w WINDOW b AS (ORDER BY lim / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, total, w, [7.0, 2.0, 0.5][kind + 1]::DOUBLE AS a, [3.0, 2.0, 1.5][kind + 1]::DOUBLE AS b,
  coalesce(least(lim, w * arg_min(level, place) FILTER (lim >= level * w) OVER ()), 0)::DOUBLE AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.okey, d.size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, unnest([0, 1, 2])::INT AS reading FROM p WHERE size > 0),
m AS (SELECT *, (reading * total + before)::DOUBLE + size::DOUBLE / 2 AS middle FROM r),
x AS (SELECT *, (middle / target) * w AS need FROM m WHERE middle < target)
SELECT doc_id, reading, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0::DOUBLE * need / (a + sqrt(greatest(a * a + 2.0::DOUBLE * (b - a) * need, 0.0::DOUBLE))))) AS position FROM x
""")
def op2_training_order(spark, sf_dir):
    from vellumine.llm.mixing import readings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return readings(docs, carry=["doc_id"])


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op3_exact_dedup(spark, sf_dir):
    from vellumine.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark, sf_dir):
    from vellumine.llm.ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    from vellumine.llm.substring_dedup import repeated_windows

    out = repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_embedding_near_dedup", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT u, count(*) AS k FROM links GROUP BY u),
reach AS (WITH RECURSIVE r AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM r JOIN links l ON r.v = l.u) SELECT u, min(v) AS c FROM r GROUP BY u)
SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN reach ON v.vec_id = reach.u LEFT JOIN n ON n.u = v.vec_id
""")
def op7_embedding_near_dedup(spark, sf_dir):
    from vellumine.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    from vellumine.llm.pieces import MODEL, Vocabulary, decode, encode

    model = Vocabulary(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, model=model), model=model)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids",
                       F.col("decoded").eqNullSafe(F.translate("text", "▁", " ")).alias("round_trip"))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 by 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fitted_toxicity(spark, docs, sf_dir):
    """The scorer learned from the labels that are not held out, over all of ``docs``."""
    from vellumine.llm.toxicity import fit

    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return fit(docs, docs.select("doc_id", "text").join(labels, "doc_id"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    from vellumine.llm.toxicity import THRESHOLD, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted_toxicity(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op10_page_text")
def op10_page_text(spark, sf_dir):
    from vellumine.llm.page_text import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    from vellumine.llm.secret_scan import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example", "most_owners", "most_repos")


@query("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    from vellumine.llm.personal_data import scan_personal

    found = scan_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")


@query("op11_merkle_manifest", r"""
WITH RECURSIVE table256 AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, table256),
f AS (SELECT doc_id, source, text, crc % 5 = 0 AS hit, concat(
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
  coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
    ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS arrived FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM l),
tree AS (SELECT source, 0 AS level, rank, leaf AS node, n AS width FROM r UNION ALL
  SELECT source, level + 1, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), max((width + 15) // 16) FROM tree WHERE width > 1 GROUP BY source, level, rank // 16),
sub AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources, level AS height FROM tree WHERE width = 1),
crown AS (SELECT 0 AS level, place AS rank, subroot AS node, sources AS width FROM sub UNION ALL
  SELECT level + 1, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), max((width + 15) // 16) FROM crown WHERE width > 1 GROUP BY level, rank // 16),
steps AS (SELECT t.source, t.level, t.rank, coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (WHERE s.rank < t.rank), '') AS before,
    coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (WHERE s.rank > t.rank), '') AS after
  FROM tree t JOIN tree s ON s.source IS NOT DISTINCT FROM t.source AND s.level = t.level AND s.rank // 16 = t.rank // 16 WHERE t.width > 1 GROUP BY ALL),
rises AS (SELECT t.level, t.rank, coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (WHERE s.rank < t.rank), '') AS before,
    coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (WHERE s.rank > t.rank), '') AS after
  FROM crown t JOIN crown s ON s.level = t.level AND s.rank // 16 = t.rank // 16 WHERE t.width > 1 GROUP BY ALL),
fold AS (SELECT r.source, r.rank, r.doc_id, 0 AS level, r.rank AS at, '' AS proof, arrived AS node FROM r UNION ALL
  SELECT f.source, f.rank, f.doc_id, f.level + 1, f.at // 16, f.proof || s.before || s.after, sha256(s.before || f.node || s.after)
  FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.level = f.level AND s.rank = f.at),
rise AS (SELECT f.source, f.rank, f.doc_id, 0 AS level, sub.place AS at, f.proof, f.node FROM fold f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source AND sub.height = f.level UNION ALL
  SELECT f.source, f.rank, f.doc_id, f.level + 1, f.at // 16, f.proof || s.before || s.after, sha256(s.before || f.node || s.after)
  FROM rise f JOIN rises s ON s.level = f.level AND s.rank = f.at),
root AS (SELECT node AS root, level AS height FROM crown WHERE width = 1)
SELECT r.doc_id, r.leaf, sub.subroot, root.root, sha256(rise.proof) AS proof_sha256, rise.node AS folded_root, rise.node = root.root AS verified
FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source JOIN root ON true
JOIN rise ON rise.source IS NOT DISTINCT FROM r.source AND rise.rank = r.rank AND rise.level = root.height
""")
def op11_merkle_manifest(spark, sf_dir):
    from vellumine.llm.common import lower_ascii
    from vellumine.llm.manifest import manifest, verified

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return verified(manifest(table(spark, sf_dir, "documents"), tampered))


@query("op12_spelling_variants", r"""
WITH RECURSIVE table256 AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
  ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, table256),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (d, i, l) WHERE a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.d = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.d = w.word),
near AS (SELECT a, count(*) AS n_near, min(ROW(-w.n, b)) AS best FROM pairs JOIN w ON b = w.word GROUP BY a),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n
  FROM w LEFT JOIN near ON a = word),
follow AS (SELECT word, form, word AS at FROM told UNION ALL SELECT f.word, t.form, t.word FROM follow f JOIN told t ON t.word = f.form)
SELECT told.word, told.form, follow.at AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told JOIN follow USING (word) WHERE follow.form IS NULL
""")
def op12_spelling_variants(spark, sf_dir):
    from vellumine.llm.common import lower_ascii, stored
    from vellumine.llm.spelling import group_variants, word_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(r"([A-Za-zÀ-ÿ]+)"), F.lit(0))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    typed = F.when(h % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return group_variants(stored(word_counts(docs, runs, typed), "words"))


@query("op13_power_packing")
def op13_power_packing(spark, sf_dir):
    from vellumine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), ids_col=None)
