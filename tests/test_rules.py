"""Rules over a grid of instants against brute force: gaps, keys, block borders, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import rules

START = dt.datetime(2024, 1, 1)


def some_events(seed, n=150):
    rng = random.Random(seed)
    at = [rng.choice([rng.randint(0, 4000), rng.randint(20_000, 22_000), 600]) for _ in range(n)]  # a long gap, and times on the grid
    return [(START + dt.timedelta(seconds=s), rng.choice(["a", "b", None]), rng.random() < 0.4) for s in at] + [(None, "a", True)]


@pytest.mark.parametrize("block", [4096, 7])
def test_trailing_counts(spark, monkeypatch, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    rows = some_events(block)
    df = spark.createDataFrame(rows, "ts timestamp, who string, bad boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.who, r.moment): tuple(r)[2:] for r in rules.trailing_counts(df, "ts", {"n": F.lit(True), "bad": F.col("bad")}, (120, 3600), 60, ("who",)).collect()}
    known = [r for r in rows if r[0]]
    number = lambda t: -int(-(t - START).total_seconds() // 60)
    last, want = max(number(r[0]) for r in known), {}
    for who in ("a", "b", None):
        own = [r for r in known if r[1] == who]
        for i in range(min(number(r[0]) for r in own), last + 1):
            moment = START + dt.timedelta(minutes=i)
            within = [[r for r in own if moment - dt.timedelta(seconds=s) < r[0] <= moment] for s in (120, 3600)]
            want[who, moment] = (*(len(w) for w in within), *(sum(r[2] for r in w) for w in within))
    assert got == want
    with pytest.raises(ValueError):
        rules.trailing_counts(df, "ts", {"n": F.lit(True)}, (90,), 60)
    assert rules.availability_series(df.limit(0), "ts", F.col("bad"), 60).count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_holding(spark, monkeypatch, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    rng = random.Random(1)
    rows = [(k, START + dt.timedelta(minutes=i), rng.choice([0.1, 0.9, 0.9, 0.9, None])) for k in "ab" for i in range(40)]
    got = rules.holding_series(spark.createDataFrame(rows, "k string, moment timestamp, v double"), F.col("v") > 0.5, 180, 60, ("k",)).collect()
    hot = {(k, t): v is not None and v > 0.5 for k, t, v in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.pending == hot[r.k, r.moment]
        assert r.firing == all(hot.get((r.k, r.moment - dt.timedelta(minutes=j)), False) for j in range(4))


def test_counters(spark):
    """Two restarts, a window with one sample, an edge that is far away."""
    seconds = {"a": [(5, 10), (65, 14), (125, 3), (185, 8), (245, 1), (1000, 9)], "b": [(30, 0), (60, 0)], "c": [(10, 2)]}
    rows = [(k, START + dt.timedelta(seconds=s), v) for k, xs in seconds.items() for s, v in xs]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int")
    got = {(r.k, (r.moment - START).total_seconds()): (r.increase, r.rate) for r in rules.rate_series(df, "ts", "v", 240, 60, ("k",)).collect()}
    want = {}
    for k, xs in seconds.items():
        for moment in range(60, 1021, 60):
            w = [x for x in xs if moment - 240 < x[0] <= moment]
            if len(w) < 2:
                continue
            rise = sum(b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in zip(w, w[1:], strict=False))
            span = w[-1][0] - w[0][0]
            mean = span / (len(w) - 1)
            start, end = w[0][0] - (moment - 240), moment - w[-1][0]
            start, end = (mean / 2 if d >= 1.1 * mean else d for d in (start, end))
            if rise > 0:
                start = min(start, span * w[0][1] / rise)
            want[k, moment] = rise * (span + start + end) / span
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v[0] for k, v in got.items()}
    assert all(v[1] == pytest.approx(v[0] / 240) for v in got.values())
