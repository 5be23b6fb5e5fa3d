"""A cache as a stream's state against a model, and metrics of running streams against batch aggregates."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from lodestrata.operators import monitoring as M
from lodestrata.streaming import events as E
from lodestrata.streaming import keyed as K
from lodestrata.streaming.metrics import Metrics

SCHEMA = "ts timestamp, nth int, op string, key string, value string, ttl int"
START = dt.datetime(2024, 1, 1)


def changes(seed):
    rng, rows = random.Random(seed), []
    for i in range(120):
        op = rng.choice(["set", "set", "set", "touch", "delete", "clear"])
        key = rng.choice(["q", "r"]) if op == "clear" else f"{rng.choice('qr')}:{rng.randint(0, 5)}"
        rows.append((START + dt.timedelta(seconds=10 * i), i, op, key, f"v{i}" if op == "set" else None, rng.choice([None, 30, 100, 400])))
    return rows


def model(rows, default):
    """Entries that are left, with their ends."""
    have = {}
    for at, _, op, key, value, ttl in rows:
        have = {k: x for k, x in have.items() if x[1] > at}
        until = at + dt.timedelta(seconds=default if ttl is None else ttl)
        if op == "set":
            have[key] = (value, until)
        elif op == "touch" and key in have:
            have[key] = (have[key][0], until)
        elif op == "delete":
            have.pop(key, None)
        elif op == "clear":
            have = {k: x for k, x in have.items() if not k.startswith(f"{key}:")}
    return have


def test_a_cache_in_state_equals_the_model(spark, tmp_path):
    rows = changes(3)
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (rows[:50], rows[50:60], rows[60:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        E.run_available(K.cached(E.timed(E.read(spark, source, SCHEMA), late="0 seconds"), 200, 4, order="nth"), sink, check)
    want = model(rows, 200)
    got = {r.key: (r.value, r.expires_at) for r in K.live(spark, check).collect()}
    assert got == {k: x for k, x in want.items()} and want
    log = spark.read.parquet(sink).collect()
    assert sum(r.state == "set" for r in log) == sum(r[2] == "set" for r in rows)
    # every entry that was set is gone in one way or is left
    ended = [r for r in log if r.state in ("expired", "deleted", "cleared")]
    assert ended and all(r.at <= START + dt.timedelta(seconds=1200) for r in ended)
    # a last change far away ends all others
    spark.createDataFrame([(START + dt.timedelta(days=1), 999, "set", "z:0", "last", 5)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    E.run_available(K.cached(E.timed(E.read(spark, source, SCHEMA), late="0 seconds"), 200, 4, order="nth"), sink, check)
    assert [r.key for r in K.live(spark, check).collect()] == ["z:0"]
    expired = {r.key: r.at for r in spark.read.parquet(sink).filter("state = 'expired'").collect() if r.key in want and r.value == want[r.key][0]}
    assert expired == {k: x[1] for k, x in want.items()}


def test_metrics_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "value")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(source)
    metrics = Metrics("events", "kind", ["error", "view"], (1.0, 50.0))
    listener = metrics.listener()
    spark.streams.addListener(listener)
    try:
        stream = metrics.observed(E.read(spark, source, events.schema, 1), F.col("event_type"), F.col("value"))
        E.run_available(stream, sink, str(tmp_path / "check"))
        until = time.time() + 30
        while time.time() < until and sum(metrics.totals.get(f"n_{i}", 0) for i in range(3)) < events.count():
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    kind = F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).otherwise("other")
    want = {(r.kind, str(r.le)): float(r.n) for r in M.histogram(events.withColumn("kind", kind), "value", (1.0, 50.0), "kind").collect()}
    rows = metrics.table(spark).collect()
    assert {(r.kind, "inf" if r.le == "+Inf" else r.le): r.value for r in rows if r.metric == "bucket"} == want
    sums = {r.kind: r.value for r in rows if r.metric == "sum"}
    for r in events.groupBy(kind.alias("kind")).agg(F.sum("value").alias("s")).collect():
        assert abs(sums[r.kind] - r.s) < 1e-6
    batch, seen = metrics.counted(events, F.col("event_type"), F.col("value"))
    batch.write.format("noop").mode("overwrite").save()
    before = metrics.totals["n_0"]
    metrics.add(seen.get, ("run", 7))
    metrics.add(seen.get, ("run", 7))  # the same batch again
    assert metrics.totals["n_0"] == 2 * before
    text = metrics.text(spark, "Events.")
    assert "# TYPE events_total counter" in text and f'events_total{{kind="error"}} {2 * before:.1f}' in text and any(x.startswith('events_bucket{kind="view",le="+Inf"}') for x in text)
