"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from lodestrata.plans import registry

from .oracle import by_spark, by_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert by_spark(QUERIES[name](spark, FOLDER)) == by_sql(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert set(SQL) <= set(__spark_entry__.queries())
