"""Aggregates of an event log: counters, histograms, rates, service levels, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in seconds.
QUERY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
#: The share of errors that a service level of 99.5 % leaves, that of slow answers, and how many times as much is a fast or slow burn.
ALLOWED, ALLOWED_SLOW = 0.005, 0.05
FAST, SLOW = 14.4, 6.0
#: Limits of alerts (seconds, share, tokens, errors a second, drops a second, clients, restarts in 15 minutes).
SLOW_SECONDS, HIT_RATIO, TOKENS, ERRORS, DROPS, CLIENTS, RESTARTS = 120.0, 0.75, 4500, 0.1, 10, 180, 3


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0.0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def error_rate(events: DataFrame, is_error: Column, *by: str) -> DataFrame:
    """(by..., n, errors, error_rate) in one pass."""
    out = events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"))
    return out.withColumn("error_rate", share(F.col("errors"), F.col("n")))


def histogram(events: DataFrame, value: str, bounds: Sequence[float], *by: str) -> DataFrame:
    """(by..., le, n): cumulative counts per bound, the last bound infinite; one pass, then one row per bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*by).agg(*counts, F.count(value).alias("total"))
    bucket = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    bucket.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return wide.select(*by, F.inline(F.array(*bucket)))


def quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """(by..., quantile): linear between bounds of cumulative buckets, from 0 in the first; the highest finite bound beyond it."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = w.orderBy("le")
    b = buckets.withColumn("wanted", F.max("n").over(w) * F.lit(q)).withColumn("low", F.lag("le", 1, 0.0).over(ordered)).withColumn("before", F.lag("n", 1, 0).over(ordered))
    first = b.filter((F.col("n") >= F.col("wanted")) & (F.col("before") < F.col("wanted")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("wanted") - F.col("before")) / (F.col("n") - F.col("before"))
    return first.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def last_value(events: DataFrame, value: str, time: str, tie: str, *by: str) -> DataFrame:
    """(by..., last_value): a gauge."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(time, tie)).alias("last_value"))


def rate_per_window(events: DataFrame, time: str, width: str, seconds: int, *by: str) -> DataFrame:
    """(window_start, by..., n, per_second) of tumbling windows."""
    out = events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def success_per_window(events: DataFrame, time: str, is_error: Column, width: str) -> DataFrame:
    """(window_start, n, errors, success_ratio)."""
    out = error_rate(events.withColumn("w", F.window(time, width)), is_error, "w")
    return out.select(F.col("w.start").alias("window_start"), "n", "errors", (1 - F.col("error_rate")).alias("success_ratio"))


def trailing_error_rates(events: DataFrame, time: str, is_error: Column, hours: Sequence[int]) -> DataFrame:
    """One row: the error share of the last hours before the latest event, a column ``err_<h>h`` per length; one pass over the longest stretch."""
    anchor = F.broadcast(events.agg(F.max(time).alias("__end")))
    recent = events.crossJoin(anchor).filter(F.col(time) > F.col("__end") - F.make_interval(hours=F.lit(max(hours))))
    aggs = []
    for h in hours:
        inside = F.col(time) > F.col("__end") - F.make_interval(hours=F.lit(h))
        aggs.append(share(F.count_if(inside & is_error), F.count_if(inside)).alias(f"err_{h}h"))
    return recent.agg(*aggs)


def burn_alerts(rates: DataFrame, allowed: float = ALLOWED) -> DataFrame:
    """rates with ``fast_burn`` (1 h and 6 h), ``slow_burn`` (6 h and 24 h) and ``burning``."""
    fast = (F.col("err_1h") > FAST * allowed) & (F.col("err_6h") > FAST * allowed)
    slow = (F.col("err_6h") > SLOW * allowed) & (F.col("err_24h") > SLOW * allowed)
    return rates.withColumn("fast_burn", fast).withColumn("slow_burn", slow).withColumn("burning", fast | slow)


def budget(rates: DataFrame, allowed: float = ALLOWED) -> DataFrame:
    """rates with the error budget that is left and whether it is low or gone."""
    left = 1 - F.col("err_72h") / allowed
    return rates.withColumn("budget_left", left).withColumn("budget_low", left < 0.1).withColumn("budget_gone", left <= 0)


def trailing_shares(events: DataFrame, time: str, good: Column, minutes: Sequence[int], name: str = "within", counted: Column | None = None) -> DataFrame:
    """One row: the share of good events among those counted (by default all) in the last minutes before the latest event, a column ``<name>_<m>m`` per length, null where there is none."""
    anchor = F.broadcast(events.agg(F.max(time).alias("__end")))
    recent = events.crossJoin(anchor).filter(F.col(time) > F.col("__end") - F.make_interval(mins=F.lit(max(minutes))))
    counted = F.lit(True) if counted is None else counted
    aggs = []
    for m in minutes:
        inside = (F.col(time) > F.col("__end") - F.make_interval(mins=F.lit(m))) & counted
        aggs.append(F.try_divide(F.count_if(inside & good).cast("double"), F.count_if(inside).cast("double")).alias(f"{name}_{m}m"))
    return recent.agg(*aggs)


def latency_burn(shares: DataFrame, allowed: float = ALLOWED_SLOW) -> DataFrame:
    """shares (within_60m, within_360m) with the shares of slow answers, ``fast_burn`` (both lengths) and ``slow_burn`` (the longer, below the fast limit)."""
    slow = shares.withColumn("slow_60m", 1 - F.col("within_60m")).withColumn("slow_360m", 1 - F.col("within_360m"))
    fast, least = FAST * allowed, SLOW * allowed
    hold = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  where nothing was asked, nothing burns
    return slow.withColumn("fast_burn", hold((F.col("slow_60m") > fast) & (F.col("slow_360m") > fast))).withColumn("slow_burn", hold((F.col("slow_360m") > least) & (F.col("slow_360m") < fast)))


def cost_per_query(costs: DataFrame, llm: str, infra: str, queries: str) -> DataFrame:
    """costs with ``cost_cents``: both costs over the number of queries in hundredths; null where nothing was asked."""
    return costs.withColumn("cost_cents", F.try_divide((F.col(llm) + F.col(infra)).cast("double"), F.col(queries).cast("double")) * 100)


def budget_consumed(rates: DataFrame, allowed: float = ALLOWED, days: int = 30) -> DataFrame:
    """rates with ``consumed_percent``: the error share of three days, carried on, against what is allowed."""
    return rates.withColumn("consumed_percent", F.col("err_72h") * days / allowed * 100)


def rate_alerts(events: DataFrame, time: str, width: str, seconds: int, limit: float, *by: str) -> DataFrame:
    """(window_start, by..., n, per_second) of the windows with more events a second than the limit."""
    return rate_per_window(events, time, width, seconds, *by).filter(F.col("per_second") > limit)


def increase_alerts(counters: DataFrame, time: str, value: str, width: str, limit: float, *by: str) -> DataFrame:
    """(window_start, by..., increase) of the windows in which a counter rose by more than the limit; a fall is a restart from 0."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    step = F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)).otherwise(0)
    out = counters.withColumn("__step", step).groupBy(F.window(time, width).alias("w"), *by).agg(F.sum("__step").alias("increase"))
    return out.filter(F.col("increase") > limit).select(F.col("w.start").alias("window_start"), *by, "increase")


def at_most(current: DataFrame, limits: DataFrame, key: str, value: str, limit: str) -> DataFrame:
    """current whose value has reached its limit (key, limit): an equi-join of two vectors; keys of one side only never match."""
    return current.join(limits, key).filter(F.col(value) >= F.col(limit))


def average_alert(events: DataFrame, value: str, limit: float) -> DataFrame:
    """One row: average and ``alert``, whether it exceeds the limit (never, where there is nothing)."""
    out = events.agg(F.avg(value).alias("average"))
    return out.withColumn("alert", F.coalesce(F.col("average") > limit, F.lit(False)))


def gauge_alerts(gauges: DataFrame, value: str, time: str, tie: str, limit: float, *by: str) -> DataFrame:
    """(by..., last_value) of gauges whose last value exceeds the limit."""
    return last_value(gauges, value, time, tie, *by).filter(F.col("last_value") > limit)


def exposition(samples: DataFrame, name: str, kind: str, about: str, value: str, *labels: str) -> DataFrame:
    """(line) in the text format of metrics: help and type, then a sample per row with its labels in the order given; null labels are empty."""
    quote = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), quote(c), F.lit('"')) for c in labels))
    sample = F.concat(F.lit(name), F.concat(F.lit("{"), pairs, F.lit("}")) if labels else F.lit(""), F.lit(" "), F.col(value).cast("double").cast("string"))
    head = samples.sparkSession.createDataFrame([(f"# HELP {name} {about}",), (f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(samples.select(sample.alias("line")))


def sustained(windows: DataFrame, time: str, above: Column, least: int, width_seconds: int, *by: str) -> DataFrame:
    """(by..., alert_start, alert_end, n_windows): runs of at least ``least`` adjoining windows that are above."""
    hot = windows.filter(above).withColumn("slot", (F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000 / width_seconds).cast("long"))
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy("slot")  # one row per window of time, not per event
    runs = hot.withColumn("run", F.col("slot") - F.row_number().over(order))
    out = runs.groupBy(*by, "run").agg(F.min(time).alias("alert_start"), F.max(time).alias("alert_end"), F.count("*").alias("n_windows"))
    return out.filter(F.col("n_windows") >= least).drop("run")


def sampled_tail(events: DataFrame, keep: Column, key: Column, percent: int = 1, trace: Column | None = None) -> DataFrame:
    """Rows to keep, and of the others those whose key's MD5 falls into the share; with ``trace`` whole traces: one row to keep keeps its trace, and the share is one of traces."""
    if trace is None:
        return events.filter(keep | in_share(key, percent))
    kept = events.groupBy(trace.alias("__trace")).agg(F.max(F.coalesce(keep, F.lit(False))).alias("__keep")).filter(F.col("__keep") | in_share(F.col("__trace"), percent))
    return events.withColumn("__trace", trace).join(kept.select("__trace"), "__trace", "left_semi").drop("__trace")


def in_share(key: Column, percent: int) -> Column:
    """Whether a key is in the share by its MD5, the same everywhere."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("long") % 100 < percent


def over_limit(events: DataFrame, time: str, client: str, width: str, limit: int) -> DataFrame:
    """(window_start, client, n) of clients with more events in a window than allowed."""
    out = events.groupBy(F.window(time, width).alias("w"), client).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return out.select(F.col("w.start").alias("window_start"), client, "n")
