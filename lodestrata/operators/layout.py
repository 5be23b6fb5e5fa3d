"""Tables laid out together: equal keys in equal buckets, rows in order, so that joins and ordered reads move nothing.

Both tables are written into the same number of buckets by a hash of one key, one
file a bucket, sorted by the key and further columns.  A join by the key (or by more
columns with it) reads bucket by bucket; so does an aggregation by the key after it;
a read of one key's rows opens one bucket's file.

A key that a large part of all rows have is one task's read: lay such tables out by
a finer key.  Null keys share a bucket and meet nothing.  Empty tables are laid out
like others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def buckets_for(rows: DataFrame, each: int = 128 << 20, least: int = 8) -> int:
    """A power of two of buckets with about ``each`` bytes of the files that rows reads; take the larger table's for all that are to meet."""
    spark, total = rows.sparkSession, 0
    for file in rows.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return max(least, 1 << math.ceil(math.log2(max(1, total / each))))


def lay_out(rows: DataFrame, name: str, folder: str, key: str, order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Writes rows as the table ``name`` in a folder and gives it back; one shuffle, the last that its joins need."""
    n = buckets or buckets_for(rows)
    placed = rows.repartition(n, key).sortWithinPartitions(key, *order)
    writer = placed.write.format("parquet").bucketBy(n, key).sortBy(key, *order)
    writer.option("path", folder).mode("errorifexists").saveAsTable(name)
    return rows.sparkSession.table(name)


def add_table(spark: SparkSession, name: str, folder: str, like: DataFrame, key: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Names a folder that lay_out() wrote in another application's session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    by = ", ".join(f"`{c}`" for c in (key, *order))
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def together(parent: DataFrame, child: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join of two tables that were laid out by key; a merge of sorted buckets whatever their sizes."""
    return parent.hint("merge").join(child.hint("merge"), key, how)


def rows_of(table: DataFrame, key: str, value: object, order: Sequence[str]) -> DataFrame:
    """The rows of one key in order: one task reads its bucket's file, as the others are pruned, and sorts what it kept."""
    return table.filter(F.col(key) == F.lit(value)).coalesce(1).orderBy(*order)
