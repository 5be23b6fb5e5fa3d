"""The stored table with versions: against a model, half-way failures, two writers."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import versioned
from lodestrata.operators.versioned import Conflict, VersionedTable

SCHEMA = "id string, name string, size int, is_active boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return {r["id"]: (r["name"], r["size"], r["is_active"]) for r in df.collect()}


def files(folder):
    return {p for p in Path(folder).rglob("part-*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"k{i}", f"n{i}", i, True) for i in range(40)]
    return VersionedTable.create(frame(spark, rows), str(tmp_path / "t"), "id", 8)


def test_changes_equal_a_model_and_old_versions_stay(spark, table):
    rng, model = random.Random(4), rows_of(table.read())
    seen = {0: dict(model)}
    for _ in range(6):
        kind = rng.choice(["upsert", "insert", "delete", "update"])
        picked = rng.sample([f"k{i}" for i in range(60)], 4)
        batch = [(k, f"new{rng.randint(0, 9)}", rng.randint(100, 200), None) for k in picked]
        if kind == "upsert":
            v = table.upsert(frame(spark, batch), ("name", "is_active"))
            model |= {k: (n, model[k][1], a) if k in model else (n, s, a) for k, n, s, a in batch}
        elif kind == "insert":
            v = table.insert_ignore(frame(spark, batch))
            model |= {k: (n, s, a) for k, n, s, a in batch if k not in model}
        elif kind == "delete":
            v = table.delete(frame(spark, batch))
            model = {k: x for k, x in model.items() if k not in picked}
        else:
            v = table.soft_delete(F.col("size") % 9 == len(seen))
            model = {k: (n, s, False if s % 9 == len(seen) else a) for k, (n, s, a) in model.items()}
        seen[v] = dict(model)
        assert rows_of(table.read()) == model
    again = VersionedTable.open(spark, table.folder)
    for v, rows in seen.items():
        assert rows_of(again.read(v)) == rows
    assert [r["version"] for r in again.history().collect()] == list(range(max(seen) + 1))
    assert {k: x for k, x in rows_of(again.point("k7")).items()} == {k: x for k, x in model.items() if k == "k7"}


def test_only_touched_buckets_are_written(spark, table):
    before, folders = files(table.folder), table.manifest().folders
    table.upsert(frame(spark, [("k5", "x", 1, True)]), ("name",))
    new, after = files(table.folder) - before, table.manifest().folders
    assert len(new) == 1 and len([b for b in folders if after[b] != folders[b]]) == 1
    assert table.history().orderBy("version").collect()[1]["n_buckets"] == 1
    assert len(table.point("k5").inputFiles()) == 1
    last = table.manifest().version
    assert table.delete(frame(spark, [("gone", "", 0, True)])) == last  # nothing to do, no version
    assert table.update(F.col("size") > 10_000, name="y") == last
    assert table.insert_ignore(frame(spark, [("k5", "z", 1, True)])) == last
    assert files(table.folder) == before | new


def test_a_change_that_dies_leaves_the_old_version(spark, table, monkeypatch):
    model = rows_of(table.read())

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(table.files, "put_once", dies)
    with pytest.raises(OSError, match="lost"):
        table.upsert(frame(spark, [("k1", "x", 1, True)]), ("name",))
    monkeypatch.undo()
    assert rows_of(VersionedTable.open(spark, table.folder).read()) == model
    with pytest.raises(Exception, match="repeats"):
        table.upsert(frame(spark, [("k1", "x", 1, True), ("k1", "y", 1, True)]), ("name",))
    assert rows_of(table.read()) == model and table.versions() == [0]
    # what nobody names goes with the next clearing
    left = files(table.folder)
    table.vacuum()
    assert rows_of(table.read()) == model and files(table.folder) < left


def test_of_two_writers_the_second_is_refused(spark, table, monkeypatch):
    other, old = VersionedTable.open(spark, table.folder), table.manifest()
    other.upsert(frame(spark, [("k1", "theirs", 1, True)]), ("name",))
    stale = [old]
    monkeypatch.setattr(table, "manifest", lambda version=None, real=table.manifest: stale.pop() if stale and version is None else real(version))
    with pytest.raises(Conflict):
        table.delete_where(F.col("id") == "k2")
        table._commit(old, {0}, table._rows(old, {0}), "late")
    monkeypatch.undo()
    assert versioned.retried(lambda: table.upsert(frame(spark, [("k2", "mine", 1, True)]), ("name",))) >= 2
    rows = rows_of(table.read())
    assert rows["k1"][0] == "theirs" and rows["k2"][0] == "mine"
    with pytest.raises(Conflict):
        VersionedTable.create(frame(spark, []), table.folder, "id")


def test_order_decides_repeated_keys_and_nulls_are_refused(spark, table, tmp_path):
    table.upsert(frame(spark, [("k1", "x", 1, True), ("k1", "y", 2, True)]), ("name",), "size")
    assert rows_of(table.point("k1"))["k1"][0] == "y"
    with pytest.raises(Exception, match="null"):
        VersionedTable.create(frame(spark, [(None, "x", 1, True)]), str(tmp_path / "u"), "id")
    empty = VersionedTable.create(frame(spark, []), str(tmp_path / "e"), "id")
    assert empty.read().count() == 0 and empty.upsert(frame(spark, [("a", "x", 1, True)]), ("name",)) == 1
    assert empty.read().count() == 1 and empty.read(0).count() == 0


def test_children_go_with_their_parents(spark, table, tmp_path):
    children = spark.createDataFrame([(i, f"k{i % 10}") for i in range(100)], "n int, parent string")
    child = VersionedTable.create(children, str(tmp_path / "c"), "n", 4)
    versioned.cascade_delete(table, child, frame(spark, [("k3", "", 0, True), ("zz", "", 0, True)]), "parent")
    assert child.read().count() == 90 and child.read().filter("parent = 'k3'").count() == 0 and "k3" not in rows_of(table.read())


def test_each_row_of_a_repeated_key_counts_where_that_is_wanted(spark, table):
    version = table.upsert(frame(spark, [("k1", "x", 1, True), ("k1", "y", 2, True), ("new", "z", 3, True)]), ("name",), each=True)
    size = table.read(0).filter("id = 'k1'").first()["size"]
    assert sorted(tuple(r)[:3] for r in table.point("k1", version).collect()) == [("k1", "x", size), ("k1", "y", size)]
    assert table.read().count() == table.read(0).count() + 2
    table.delete(frame(spark, [("k1", "", 0, True)]))
    assert table.point("k1").count() == 0
    with pytest.raises(ValueError):
        table.upsert(frame(spark, [("k2", "x", 1, True)]), ("name",), order="size", each=True)


@pytest.mark.parametrize("name", ["bulk_upsert", "table_as_of", "table_changes", "insert_ignore"])
def test_queries_of_parts_whose_moved_keys_are_taken(spark, tmp_path, name):
    """Keys above a million: the batch's moved keys meet stored ones and its own."""
    import duckdb

    from lodestrata.plans import registry

    from .oracle import by_spark, plain

    rows = [(k, f"part {k}", size, float(k)) for k, size in ((1, 45), (2, 50), (3, 10), (4, 25), (5, 2), (1000001, 30), (1000002, 8), (1000003, 22), (1000004, 41), (1000013, 30))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    queries, sql = registry.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(sql[name])
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert by_spark(queries[name](spark, str(tmp_path)))[1] == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
