"""Tables that are laid out together are joined and read in order without an exchange."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import layout as L
from lodestrata.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fresh(spark, tmp_path, rows, name, order=(), buckets=8):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return L.lay_out(rows, name, str(tmp_path / name), "k", order, buckets)


def test_registered_join_and_read_have_no_exchange(spark):
    queries, _ = registry.load()
    joined = queries["filings_with_chunks"](spark, FOLDER)
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    ordered = queries["laid_out_chunks_in_order"](spark, FOLDER)
    assert "Exchange" not in plan(ordered)
    at = [r["chunk_index"] for r in ordered.collect()]
    assert at == sorted(at) and len(at) >= 1


def test_one_file_a_bucket_and_equal_rows(spark, tmp_path):
    parents = spark.range(500).selectExpr("id AS k", "id % 7 AS p")
    children = spark.range(3000).selectExpr("id % 600 AS k", "id AS at", "CASE WHEN id % 11 = 0 THEN NULL ELSE id END AS v")
    a, b = fresh(spark, tmp_path, parents, "laid_a"), fresh(spark, tmp_path, children, "laid_b", ["at"])
    assert len(b.inputFiles()) <= 8
    got = L.together(a, b, "k")
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.select("k", "p", "at").collect())) == sorted(map(tuple, parents.join(children, "k").select("k", "p", "at").collect()))
    assert L.rows_of(b, "k", 100000, ["at"]).count() == 0
    assert [r["at"] for r in L.rows_of(b, "k", 5, ["at"]).collect()] == [5, 605, 1205, 1805, 2405]
    (own,) = {r[0] for r in b.filter("k = 5").select(F.input_file_name()).collect()}
    for file in set(b.inputFiles()) - {own}:
        Path(urlparse(file).path).unlink()  # so that reading any other bucket fails
    assert [r["at"] for r in L.rows_of(b, "k", 5, ["at"]).collect()] == [5, 605, 1205, 1805, 2405]
    with pytest.raises(Exception):
        b.collect()


def test_nulls_and_empty_tables(spark, tmp_path):
    keyed = spark.createDataFrame([(None, 1), (1, 2), (1, 2)], "k long, x int")
    none = spark.createDataFrame([], "k long, y int")
    a, b = fresh(spark, tmp_path, keyed, "laid_c"), fresh(spark, tmp_path, none, "laid_d")
    assert a.count() == 3 and b.count() == 0
    assert L.together(a, b, "k").count() == 0
    assert sorted(r["k"] or 0 for r in L.together(a, b, "k", "left").collect()) == [0, 1, 1]
    assert L.together(a, fresh(spark, tmp_path, keyed.withColumnRenamed("x", "z"), "laid_e"), "k").count() == 4


def test_a_folder_of_another_application(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 10 AS k", "id AS at")
    first = fresh(spark, tmp_path, rows, "laid_f", ["at"])
    spark.sql("DROP TABLE IF EXISTS laid_g")
    again = L.add_table(spark, "laid_g", str(tmp_path / "laid_f"), rows, "k", ["at"], 8)
    joined = L.together(first.select("k", first["at"].alias("one")), again, "k")
    assert "Exchange" not in plan(joined) and joined.count() == 1000
    with pytest.raises(Exception):
        L.lay_out(rows, "laid_f", str(tmp_path / "laid_h"), "k", (), 8)


def test_bucket_numbers(spark):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert L.buckets_for(rows) == 8
    assert L.buckets_for(rows, each=1000) & (L.buckets_for(rows, each=1000) - 1) == 0
    assert L.buckets_for(rows, each=1000) > 8
