"""Alerts and tail sampling as streams: equal to their batch forms however the events come in batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import monitoring as M
from lodestrata.streaming import events as E
from lodestrata.streaming import keyed as K

SCHEMA = "ts timestamp, who string, bad boolean, n int"
START = dt.datetime(2024, 1, 1)


def some_events(seed):
    rng = random.Random(seed)
    rows = []
    for who in ("a", "b", None):
        hot = False
        for m in range(60):
            hot = rng.random() < 0.7 if hot else rng.random() < 0.3
            if rng.random() < 0.15:
                continue  # a window without events
            rows += [(START + dt.timedelta(minutes=m, seconds=rng.randint(0, 59)), who, rng.random() < (0.9 if hot else 0.1), rng.randint(0, 99)) for _ in range(3)]
    return sorted(rows, key=lambda r: r[0])


def run(spark, tmp_path, parts, make):
    """The rows that a stream gives when its input comes in so many parts, one batch each."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = make(E.timed(E.read(spark, source, SCHEMA), late="1 minute"))
        E.run_available(stream, sink, check)
    return spark.read.parquet(sink).collect()


def in_parts(rows, n, seed):
    """Parts of rows in order, but for some disorder within what the watermark allows."""
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rng.sample(p, len(p)) for p in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True))]


END = [(START + dt.timedelta(days=1), w, False, 0) for w in ("a", "b", None)]


@pytest.mark.parametrize("n", [1, 4])
def test_alerts_equal_the_batch_form(spark, tmp_path, n):
    rows = some_events(n)
    got = run(spark, tmp_path, [*in_parts(rows, n, n), END], lambda s: K.alerts(s, F.col("who"), F.col("bad"), 0.5, 2, 60))
    windows = spark.createDataFrame(rows, SCHEMA).groupBy("who", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.count_if("bad").alias("errors")).withColumn("start", F.col("w.start"))
    want = M.sustained(windows, "start", F.col("errors") > 0.5 * F.col("n"), 2, 60, "who").collect()
    assert len(want) > 5
    assert sorted(map(str, ((r.key, r.alert_start, r.alert_end, r.n_windows) for r in got if r.state == "resolved"))) == sorted(map(str, ((r.who, r.alert_start, r.alert_end, r.n_windows) for r in want)))
    fired = [(r.key, r.alert_start) for r in got if r.state == "firing"]
    assert sorted(map(str, fired)) == sorted(map(str, ((r.who, r.alert_start) for r in want)))


def test_late_events_change_nothing(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [[(at(m), "a", True, 1) for m in (0, 1, 10)], [(at(20), "a", False, 1)], [(at(2), "a", True, 1), (at(0), "a", False, 1)], [(at(60), "a", False, 1)]]
    got = run(spark, tmp_path, parts, lambda s: K.alerts(s, F.col("who"), F.col("bad"), 0.5, 2, 60))
    assert [(r.state, r.alert_start.minute, r.alert_end.minute, r.n_windows) for r in sorted(got, key=lambda r: r.state)] == [("firing", 0, 1, 2), ("resolved", 0, 1, 2)]


def traces(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        at = START + dt.timedelta(seconds=rng.randint(0, 600))
        rows += [(at + dt.timedelta(milliseconds=rng.randint(0, 9000)), f"t{i}", rng.random() < 0.05, rng.choice([None, 7])) for _ in range(rng.randint(1, 6))]
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("n", [1, 5])
def test_traces_stay_or_go_whole(spark, tmp_path, n):
    rows = traces(n)
    got = run(spark, tmp_path, [*in_parts(rows, n, n), END], lambda s: K.sampled_traces(s, F.col("who"), F.col("bad"), 20, shards=4))
    want = M.sampled_tail(spark.createDataFrame(rows, SCHEMA), F.col("bad"), F.col("who"), 20, F.col("who")).collect()
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs if r.ts < START + dt.timedelta(hours=1))))
    assert key(got) == key(want) and 0 < len(want) < len(rows)


def test_too_many_open_traces_are_decided_early(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    first = [(at(i), f"t{i}", False, 1) for i in range(6)]
    late = [(at(7), "t0", True, 2), (at(7), "t5", True, 2)]  # t0 was dropped as one of the oldest, t5 still waits
    got = run(spark, tmp_path, [first, late, END], lambda s: K.sampled_traces(s, F.col("who"), F.col("bad"), 0, most_open=2, shards=1))
    assert sorted((r.who, r.n) for r in got) == [("t5", 1), ("t5", 2)]
