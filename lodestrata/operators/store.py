"""Lookups and writes of the document store, as tables in, tables out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import HISTORY


class NotFound(LookupError):
    """No row has the wanted key."""


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value)


def point_or_raise(df: DataFrame, key: str, value: object) -> DataFrame:
    found = point(df, key, value)
    if not found.take(1):
        raise NotFound(f"{key} = {value}")
    return found


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exists_by_hash(wanted: DataFrame, stored: DataFrame, key: str = "file_hash") -> DataFrame:
    """wanted with ``found``: whether a stored row has its hash."""
    have = stored.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def chunks_of_filing(chunks: DataFrame, filing_id: object, section: str | None = None) -> DataFrame:
    """A filing's chunks, of one section if it is named, by their index."""
    rows = point(chunks, "filing_id", filing_id)
    return (rows if section is None else point(rows, "section", section)).orderBy("chunk_index")


def stats(df: DataFrame, key: str, size: str, listed: int = 50, active: str = "is_active") -> DataFrame:
    """(key, n_active, n_listed, size): of each key its active rows, of which at most ``listed`` are listed; and a row without a key for all, where every row counts as listed."""
    on = F.count_if(F.col(active))
    each = df.groupBy(key).agg(on.alias("n_active"), F.least(on, F.lit(listed)).alias("n_listed"), F.sum(size).alias(size))
    whole = df.agg(on.alias("n_active"), F.count("*").alias("n_listed"), F.sum(size).alias(size)).select(F.lit(None).cast("string").alias(key), "n_active", "n_listed", size)
    return each.unionByName(whole)


def newest_per_key(df: DataFrame, keys: Sequence[str], recency: str, tie: str, n: int = 1) -> DataFrame:
    """The n newest rows of each key; rows without a date count as newest."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(recency).desc_nulls_first(), F.col(tie)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def first_per_year(df: DataFrame, key: str, date: str, order: Sequence, years: int) -> DataFrame:
    """Per key the first row of each year in a given order, for the first ``years`` years met in that order."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    placed = df.withColumn("year", F.year(date).cast("long")).filter("year is not null").withColumn("pos", position)
    first = placed.withColumn("in_year", F.row_number().over(Window.partitionBy(key, "year").orderBy("pos"))).filter("in_year = 1")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("nth") <= years).drop("pos", "in_year", "nth")


def _once(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """batch with one row per key: the last by order; without an order a repeated key is an error when the rows are read."""
    same = Window.partitionBy(key)
    if order is None:
        repeated = F.raise_error(F.concat(F.lit(f"the batch repeats {key} "), F.col(key).cast("string")))
        return batch.withColumn("__n", F.count("*").over(same)).withColumn(key, F.when(F.col("__n") > 1, repeated).otherwise(F.col(key))).drop("__n")
    return batch.withColumn("__nth", F.row_number().over(same.orderBy(F.col(order).desc_nulls_last()))).filter("__nth = 1").drop("__nth")


def upsert(stored: DataFrame, batch: DataFrame, key: str, updated: Sequence[str], order: str | None = None, each: bool = False) -> DataFrame:
    """stored with batch merged in: new keys are added, of known ones only the ``updated`` columns change, to nulls too.

    A batch that repeats a key is an error, or with ``order`` (a column of batch) its last row of the key counts;
    with ``each`` every row of it counts, and the key has as many rows afterwards, as after a full join.
    """
    if each and order is not None:
        raise ValueError("either each row of a repeated key or the last by order")
    old, new = stored.alias("o"), (batch if each else _once(batch, key, order)).alias("n")
    merged = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    known, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        if c in updated:
            return F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return merged.select(*(pick(c) for c in stored.columns))


def insert_ignore(stored: DataFrame, batch: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """stored and those rows of batch whose key it doesn't have, of a repeated key the first by order (by default all columns)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(order or batch.columns)))
    fresh = batch.join(stored.select(key), key, "left_anti").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return stored.unionByName(fresh)


def append(rows: DataFrame, path: str) -> int:
    """Adds rows to a Parquet table and says how many; nothing is written for none."""
    if not rows.take(1):
        return 0
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def delete(df: DataFrame, gone: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """df without the rows whose ``key`` is among ``of`` (by default the same column) of gone."""
    return df.join(gone.select(F.col(of or key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    return delete(parents, gone, parent_key), delete(children, gone, child_key, parent_key)


def update(df: DataFrame, condition: Column, **values: object) -> DataFrame:
    """df with columns set where the condition holds; an unknown column is an error."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def soft_delete(df: DataFrame, condition: Column, flag: str = "is_active") -> DataFrame:
    return update(df, condition, **{flag: False})


def ingest(batch: DataFrame, stored: DataFrame, hash_col: str = "file_hash", order: str = "id") -> DataFrame:
    """The rows of batch that are new by content: hashes not stored, each once (the smallest ``order``).

    Comes before any costly step, so that known documents cost a hash only.
    """
    fresh = batch.join(stored.select(hash_col).distinct(), hash_col, "left_anti")
    first = F.row_number().over(Window.partitionBy(hash_col).orderBy(order))
    return fresh.withColumn("__nth", first).filter("__nth = 1").drop("__nth")


# --- a cache as a table (key, value, expires_at) ---


def cache_get(cache: DataFrame, now: Column, schema: str) -> DataFrame:
    """Live entries with parsed values; bad JSON gives a null."""
    return cache.filter(F.col("expires_at") > now).withColumn("parsed", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def cache_set(cache: DataFrame, entries: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """cache with entries (key, value) that live ``ttl`` seconds."""
    timed = entries.select("key", "value", (now + F.make_interval(secs=F.lit(ttl))).alias("expires_at"))
    return upsert(cache, timed, "key", ("value", "expires_at"))


def cache_touch(cache: DataFrame, key: str, now: Column, ttl: int) -> DataFrame:
    return update(cache, F.col("key") == key, expires_at=now + F.make_interval(secs=F.lit(ttl)))


def cache_exists(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys (key) that have a live entry."""
    return keys.join(cache.filter(F.col("expires_at") > now).select("key"), "key", "left_semi")


def cache_delete(cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache without the keys, keys with ``existed``)."""
    found = cache.select("key").distinct().withColumn("existed", F.lit(True))
    return cache.join(keys.select("key"), "key", "left_anti"), keys.join(found, "key", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def cache_clear(cache: DataFrame, namespace: str) -> DataFrame:
    return cache.filter(~F.col("key").startswith(f"{namespace}:"))


def _json(value: object) -> Column:
    """A part of a cache key as JSON: columns become strings, other values what they are."""
    if not isinstance(value, Column):
        return F.lit(json.dumps(value))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(quoted, F.lit("null"))


def cache_key(**parts: object) -> Column:
    """Namespaced SHA-256 of the parts as JSON with sorted names; the same for the same parts, in any order.  Parts are values or string columns."""
    fields = [F.concat(F.lit(f"{json.dumps(name)}: "), _json(parts[name])) for name in sorted(parts)]
    return F.concat(F.lit("query:"), F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")), 256))


# --- the audit log ---


def audit(spark: SparkSession, now: Column, **fields: object) -> DataFrame:
    """One row of the audit log: id and time are made, the ticker is in upper case, absent fields have their defaults; unknown ones are an error."""
    names = [f.split()[0] for f in HISTORY.split(", ")]
    if unknown := set(fields) - set(names):
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    for needed in ("question", "answer", "agent_type", "latency_ms"):
        if needed not in fields:
            raise ValueError(f"{needed} is missing")
    given = {"id": str(uuid.uuid4()), "analysis_style": "analyst", "search_type": "similarity", "source_chunk_ids": []} | fields
    if given.get("ticker"):
        given["ticker"] = given["ticker"].upper()
    row = spark.createDataFrame([tuple(given.get(n) for n in names)], HISTORY)
    return row.withColumn("created_at", F.coalesce("created_at", now))


def agent_results(runs: DataFrame, trace: Sequence[str] = ("tool_calls", "reasoning_steps")) -> DataFrame:
    """Runs of an agent as results of queries: search_type is ``agent``, the trace of its tools stays behind."""
    return runs.drop(*trace).withColumn("search_type", F.lit("agent"))
