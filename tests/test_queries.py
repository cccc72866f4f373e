"""Every registered query next to its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect
from vellumine.plans import catalogue

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    seen = {}

    def once(spark, sf_dir):
        seen["df"] = QUERIES[name](spark, sf_dir)
        return seen["df"]

    count, problem = compare(spark, con, sf_dir, name, once, ORACLES.get(name))
    assert problem is None, problem
    assert count > 0
    plan = seen["df"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_first_runs_are_pruned_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["o07_run_consensus"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_identification_adds_no_shuffle(spark, sf_dir):
    from vellumine.plans.flows import identify_pages

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in identify_pages(docs)._jdf.queryExecution().executedPlan().toString()


def test_filters_add_no_shuffle(spark, sf_dir):
    from vellumine.operators import raster

    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id AS image_id", "8 AS height", "8 AS width", "array('GRAY') AS channels", "transform(embedding, e -> CAST(e * 100 AS SMALLINT)) AS px")
    for df, python in ((raster.sharpen(tiles), False), (raster.median_blur(tiles, 3), True), (raster.adaptive_threshold(tiles), True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and ("Python" in plan) == python  # wide filters run over whole bands


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_status_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["r01_list_cases"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = QUERIES["r05_upsert_state"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema: ")[1].split(">")[0]
