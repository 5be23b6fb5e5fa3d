"""Layered graphs against the exact search: recall, copies, shards, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph_index as G
from lodestrata.operators import retrieval as R
from lodestrata.operators import vector_index as V


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").cache()


@pytest.fixture(scope="module")
def graphs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graphs") / "g")
    G.write_graphs(rows, path, shard_rows=1000)
    return G.open_graphs(spark, path)


def test_recall(rows, graphs):
    queries = [r.embedding for r in rows.filter("id % 200 = 0").collect()]
    share, compared = G.recall(graphs, rows, queries)
    assert share >= 0.95 and compared < 0.9
    assert graphs.select("shard").distinct().count() == 2
    few, less = G.recall(graphs, rows, queries, ef=20)
    assert less < compared and few > 0.7
    exact = R.cosine_topk(rows, queries[0]).collect()
    got = G.search(graphs, queries[0]).orderBy("rank").collect()
    assert got[0].id == exact[0].id == 0 and [round(r.score, 9) for r in got][:1] == [round(r.score, 9) for r in exact][:1]


def test_cells_probe_as_many_as_they_need(spark, rows, tmp_path):
    cells = V.Cells.fit(rows)
    V.write_index(rows, cells, str(tmp_path / "c"))
    index, again = V.open_index(spark, str(tmp_path / "c"))
    queries = [r.embedding for r in rows.filter("id % 200 = 7").collect()]
    assert again.probes == cells.probes < 100 and V.recall(index, again, queries) >= 0.9


def test_copies_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    copy = rng.normal(size=8).tolist()
    data = [(f"c{i:04}", copy) for i in range(400)] + [(f"d{i:04}", rng.normal(size=8).tolist()) for i in range(300)]
    data += [("null", None), ("zero", [0.0] * 8), ("d0001", copy), (None, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(data, "id string, embedding array<double>")
    G.write_graphs(df.filter("id is not null"), str(tmp_path / "g"), shard_rows=400)
    graphs = G.open_graphs(spark, str(tmp_path / "g"))
    assert graphs.agg(F.sum(F.size("ids"))).first()[0] == 701
    # copies: the smallest ids of all shards
    assert [r.id for r in G.search(graphs, copy).orderBy("rank").collect()] == [f"c{i:04}" for i in range(5)]
    for i in (5, 77, 123):
        q = data[400 + i][1]
        assert [r.id for r in G.search(graphs, q, ef=200).orderBy("rank").collect()] == [r.id for r in R.cosine_topk(df.filter("embedding is not null and id is not null and id <> 'zero'"), q).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        G.search_all(graphs, [copy] * (G.QUERIES + 1))
    G.write_graphs(df.limit(0), str(tmp_path / "e"))
    assert spark.read.schema(graphs.schema).parquet(str(tmp_path / "e")).count() == 0
