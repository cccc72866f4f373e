"""Run registered queries next to their SQL and compare (also used by the tests)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(value)
    if isinstance(value, int):
        return repr(float(value)) if False else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def kinds(columns, rows):
    """Python type per column, from the values seen."""
    found = {}
    for i, c in enumerate(columns):
        found[c] = sorted({type(r[i]).__name__ for r in rows if r[i] is not None})
    return found


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    compare.spark_done = time.time()
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} != {len(b)}; spark {a[:2]} sql {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return len(got), f"{len(bad)} of {len(a)} rows differ, columns {sorted(df.columns)}; spark {bad[0][0]} sql {bad[0][1]}"
    ka, kb = kinds(df.columns, got), kinds(names, want)
    off = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    return len(got), (f"types differ {off}" if off else None)


def main(argv):
    import __spark_entry__ as entry
    from vellumine.session import build_session

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": os.environ.get("CHECK_TZ", "UTC")})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in picked:
        t = time.time()
        try:
            count, problem = compare(spark, con, sf, n, qs[n], sqls.get(n))
        except Exception as e:  # noqa: BLE001 - report and go on
            count, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        state = "FAIL" if problem else ("ok" if n in sqls else "rows")
        failed += bool(problem)
        done = getattr(compare, "spark_done", t)
        if problem or not os.environ.get("QUIET"):
            print(f"{state:4} {n} rows={count} spark {max(0, done - t):.2f}s "
                  f"sql {time.time() - max(done, t):.2f}s {problem or ''}"[:1500], flush=True)
    print(f"{len(picked)} queries, {failed} failed, {sum(n in sqls for n in picked)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main([a for a in sys.argv[1:] if a != "-v"])))
