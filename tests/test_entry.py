"""The driver's contract, and queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the driver runs all of them.
SAMPLE = ["callers", "callee_resolution", "impact_radius", "subsystem_anchors", "co_change", "branch_latest", "reconcile", "upsert_nodes", "hybrid_search", "solid_srp", "contract_check", "index_health", "naming_signal", "index_status", "label_coverage", "check_performance", "check_principles", "design_patterns", "class_siblings", "check_contracts", "change_hints", "health_report", "result_signals", "fork_delta", "dependency_health"]


def test_sql_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = entry.queries()[name](spark, DIR).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["knn", "hybrid_search", "concentration"])
def test_searches_ask_every_twentieth_row(spark, name):
    test_against_sql(spark, name)
    asked = spark.read.parquet(f"{DIR}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert entry.queries()[name](spark, DIR).select("query_id").distinct().count() >= asked > 20


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_dependents_are_named(spark):
    """find_dependents gives each dependent of each part, as impact_radius does, not how many there are."""
    test_against_sql(spark, "find_dependents")
    got = entry.queries()["find_dependents"](spark, DIR)
    assert got.columns == ["target", "id", "depth"]
    near = entry.queries()["impact_radius"](spark, DIR)
    assert near.join(got, near.columns, "left_anti").count() == 0
    assert got.select("target").distinct().count() == spark.read.parquet(f"{DIR}/part.parquet").count()
