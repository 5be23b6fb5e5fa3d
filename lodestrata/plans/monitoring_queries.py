"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..operators import rules as P
from ..operators import store as S
from .registry import query


def error():
    return F.col("event_type") == "error"


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def avg_latency(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("SELECT event_type, round(min(value) / 1000.0, 6) AS min_s, round(avg(value) / 1000.0, 6) AS avg_s, round(max(value) / 1000.0, 6) AS max_s FROM events GROUP BY event_type")
def latency_stats(t):
    s = lambda f: F.round(f("value") / 1000.0, 6)
    return t.events.groupBy("event_type").agg(s(F.min).alias("min_s"), s(F.avg).alias("avg_s"), s(F.max).alias("max_s"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*), 0)::DOUBLE, 0), 6) AS error_rate FROM events")
def error_rate(t):
    return M.error_rate(t.events, error()).withColumn("error_rate", F.round("error_rate", 6))


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY ALL")
def query_counter(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count("*").alias("n"))


_BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
_LIST = ", ".join(map(str, _BOUNDS))
_HISTOGRAM = f"SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([{_LIST}, 'infinity'::DOUBLE]) AS le) GROUP BY event_type, le"


@query(_HISTOGRAM)
def latency_histogram(t):
    return M.histogram(t.events, "value", _BOUNDS, "event_type")


@query(
    f"""WITH h AS ({_HISTOGRAM}),
    b AS (SELECT *, 0.95 * max(n) OVER (PARTITION BY event_type) AS wanted, lag(le, 1, 0.0) OVER w AS low, lag(n, 1, 0) OVER w AS before FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (wanted - before) / (n - before) END, 6) AS p95 FROM b WHERE n >= wanted AND before < wanted"""
)
def histogram_quantile(t):
    q = M.quantile(M.histogram(t.events, "value", _BOUNDS, "event_type"), 0.95, "event_type")
    return q.select("event_type", F.round("quantile", 6).alias("p95"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def gauge_last(t):
    return M.last_value(t.events, "value", "ts", "event_id", "user_id")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(count(*) / 900.0, 6) AS per_second FROM events GROUP BY ALL")
def counter_rate(t):
    return M.rate_per_window(t.events, "ts", "15 minutes", 900, "event_type").withColumn("per_second", F.round("per_second", 6))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(1 - count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS success_ratio FROM events GROUP BY ALL")
def slo_success_5m(t):
    return M.success_per_window(t.events, "ts", error(), "5 minutes").withColumn("success_ratio", F.round("success_ratio", 6))


def _trailing(hours) -> str:
    parts = ", ".join(f"coalesce(count(*) FILTER (ts > e - INTERVAL {h} HOUR AND event_type = 'error') / nullif(count(*) FILTER (ts > e - INTERVAL {h} HOUR), 0)::DOUBLE, 0) AS err_{h}h" for h in hours)
    return f"SELECT {parts} FROM events, (SELECT max(ts) AS e FROM events)"


_HOURS = (1, 6, 24, 72)
_ROUNDED = ", ".join(f"round(err_{h}h, 6) AS err_{h}h" for h in _HOURS)


def _rates(t):
    return M.trailing_error_rates(t.events, "ts", error(), _HOURS)


def _round(df):
    return df.withColumns({f"err_{h}h": F.round(f"err_{h}h", 6) for h in _HOURS})


@query(f"SELECT {_ROUNDED} FROM ({_trailing(_HOURS)})")
def slo_error_rates(t):
    return _round(_rates(t))


@query(
    f"""SELECT {_ROUNDED}, err_1h > 14.4 * 0.005 AND err_6h > 14.4 * 0.005 AS fast_burn, err_6h > 6 * 0.005 AND err_24h > 6 * 0.005 AS slow_burn,
    (err_1h > 14.4 * 0.005 AND err_6h > 14.4 * 0.005) OR (err_6h > 6 * 0.005 AND err_24h > 6 * 0.005) AS burning FROM ({_trailing(_HOURS)})"""
)
def burn_rate_alerts(t):
    return _round(M.burn_alerts(_rates(t)))


@query(f"SELECT round(err_72h, 6) AS err_72h, round(1 - err_72h / 0.005, 6) AS budget_left, 1 - err_72h / 0.005 < 0.1 AS budget_low, 1 - err_72h / 0.005 <= 0 AS budget_gone FROM ({_trailing(_HOURS)})")
def error_budget(t):
    return M.budget(_rates(t)).select(F.round("err_72h", 6).alias("err_72h"), F.round("budget_left", 6).alias("budget_left"), "budget_low", "budget_gone")


def _shares(good: str, minutes, name: str, counted: str = "true") -> str:
    parts = ", ".join(f"count(*) FILTER (ts > e - INTERVAL {m} MINUTE AND {counted} AND {good}) / nullif(count(*) FILTER (ts > e - INTERVAL {m} MINUTE AND {counted}), 0)::DOUBLE AS {name}_{m}m" for m in minutes)
    return f"SELECT {parts} FROM events, (SELECT max(ts) AS e FROM events)"


@query(f"SELECT round(within_5m, 6) AS within_5m, round(within_60m, 6) AS within_60m, round(within_360m, 6) AS within_360m FROM ({_shares('value <= 120', (5, 60, 360), 'within')})")
def latency_slo(t):
    out = M.trailing_shares(t.events, "ts", F.col("value") <= M.SLOW_SECONDS, (5, 60, 360))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"""SELECT round(1 - within_60m, 6) AS slow_60m, round(1 - within_360m, 6) AS slow_360m, coalesce(1 - within_60m > 0.72 AND 1 - within_360m > 0.72, false) AS fast_burn,
    coalesce(1 - within_360m > 0.3 AND 1 - within_360m < 0.72, false) AS slow_burn FROM ({_shares('value <= 60', (60, 360), 'within')})"""
)
def latency_burn_alerts(t):
    """With a limit of 60, so that the table's values fall into the band."""
    out = M.latency_burn(M.trailing_shares(t.events, "ts", F.col("value") <= 60, (60, 360)))
    return out.select(F.round("slow_60m", 6).alias("slow_60m"), F.round("slow_360m", 6).alias("slow_360m"), "fast_burn", "slow_burn")


@query(f"SELECT round(hits_30m, 6) AS hits_30m, coalesce(hits_30m < 0.75, false) AS alert FROM ({_shares(chr(39) + 'view' + chr(39) + ' = event_type', (30,), 'hits', chr(40) + 'event_type IN (' + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + '))')})")
def cache_hit_ratio(t):
    """Views are hits, clicks are misses."""
    out = M.trailing_shares(t.events, "ts", F.col("event_type") == "view", (30,), "hits", F.col("event_type").isin("view", "click"))
    return out.select(F.round("hits_30m", 6).alias("hits_30m"), F.coalesce(F.col("hits_30m") < M.HIT_RATIO, F.lit(False)).alias("alert"))


@query(
    """SELECT event_type, round(sum(value), 4) AS llm, count(*) FILTER (value > 50) AS n, round((sum(value) + 0.5 * count(*)) / nullif(count(*) FILTER (value > 50), 0) * 100, 4) AS cost_cents FROM events GROUP BY event_type
    UNION ALL SELECT 'none', 0.0, 0, NULL"""
)
def cost_per_query(t):
    costs = t.events.groupBy("event_type").agg(F.sum("value").alias("llm"), (F.count("*") * 0.5).alias("infra"), F.count_if(F.col("value") > 50).alias("n"))
    costs = costs.unionByName(t.spark.createDataFrame([("none", 0.0, 0.0, 0)], "event_type string, llm double, infra double, n long"))
    return M.cost_per_query(costs, "llm", "infra", "n").select("event_type", F.round("llm", 4).alias("llm"), "n", F.round("cost_cents", 4).alias("cost_cents"))


@query(f"SELECT round(err_72h * 30 / 0.005 * 100, 4) AS consumed_percent FROM ({_trailing(_HOURS)})")
def budget_consumed(t):
    return M.budget_consumed(_rates(t)).select(F.round("consumed_percent", 4).alias("consumed_percent"))


@query(
    """SELECT c.event_type, c.n, l.most FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) c
    JOIN (SELECT 'error' AS event_type, 150 AS most UNION ALL SELECT 'view', 10 UNION ALL SELECT 'gone', 0 UNION ALL SELECT NULL, 0) l ON l.event_type = c.event_type WHERE c.n >= l.most"""
)
def replicas_at_max(t):
    limits = t.spark.createDataFrame([("error", 150), ("view", 10), ("gone", 0), (None, 0)], "event_type string, most int")
    return M.at_most(t.events.groupBy("event_type").agg(F.count("*").alias("n")), limits, "event_type", "n", "most")


@query(
    """WITH s AS (SELECT user_id % 10 AS pod, ts, (event_id % 7) AS restarts FROM events), d AS (SELECT pod, ts, restarts, lag(restarts) OVER (PARTITION BY pod ORDER BY ts) AS b FROM s),
    i AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, pod, sum(CASE WHEN restarts >= b THEN restarts - b WHEN b IS NOT NULL THEN restarts ELSE 0 END)::BIGINT AS increase FROM d GROUP BY ALL)
    SELECT * FROM i WHERE increase > 3"""
)
def restart_alerts(t):
    counters = t.events.select((F.col("user_id") % 10).alias("pod"), "ts", (F.col("event_id") % 7).alias("restarts"))
    return M.increase_alerts(counters, "ts", "restarts", "15 minutes", M.RESTARTS, "pod")


@query("SELECT event_type, round(avg(value), 6) AS average, avg(value) > 60 AS alert FROM events WHERE event_type = 'error' GROUP BY event_type UNION ALL SELECT 'none', NULL, false")
def token_alert(t):
    """A limit of 60 in the place of 4,500 tokens; nothing to average is no alert."""
    one = lambda name, rows: M.average_alert(rows, "value", 60).select(F.lit(name).alias("event_type"), F.round("average", 6).alias("average"), "alert")
    return one("error", t.events.filter(error())).unionByName(one("none", t.events.filter("event_type = 'none'")))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) / 300.0 > 0.005")
def error_rate_alerts(t):
    """A limit of 0.005 a second in the place of 0.1, as the table is thin."""
    return M.rate_alerts(t.events.filter(error()), "ts", "5 minutes", 300, 0.005).withColumn("per_second", F.round("per_second", 6))


@query("SELECT user_id, last_value FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id) WHERE last_value > 180")
def client_alerts(t):
    return M.gauge_alerts(t.events, "value", "ts", "event_id", M.CLIENTS, "user_id")


@query(
    """SELECT '# HELP events_total Events by type.' AS line UNION ALL SELECT '# TYPE events_total counter'
    UNION ALL SELECT 'events_total{event_type="' || coalesce(event_type, '') || '",odd="' || odd || '"} ' || n::DOUBLE FROM (SELECT nullif(event_type, 'view') AS event_type, event_id % 2 AS odd, count(*) AS n FROM events GROUP BY ALL)"""
)
def metrics_export(t):
    n = t.events.groupBy(F.expr("nullif(event_type, 'view')").alias("event_type"), (F.col("event_id") % 2).alias("odd")).agg(F.count("*").alias("n"))
    return M.exposition(n, "events_total", "counter", "Events by type.", "n", "event_type", "odd")


@query("SELECT round(coalesce(count(*) FILTER (event_type <> 'error') / nullif(count(*), 0)::DOUBLE, 0), 6) AS success_rate, coalesce(count(*) FILTER (event_type <> 'error') / nullif(count(*), 0)::DOUBLE, 0) < 0.99 AS alert FROM events")
def ingestion_success(t):
    rate = M.share(F.count_if(~error()), F.count("*"))
    return t.events.agg(rate.alias("r")).select(F.round("r", 6).alias("success_rate"), (F.col("r") < 0.99).alias("alert"))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS r FROM events GROUP BY ALL),
    hot AS (SELECT s, epoch(s)::BIGINT // 3600 - row_number() OVER (ORDER BY s) AS run FROM w WHERE r > 0.2)
    SELECT min(s) AS alert_start, max(s) AS alert_end, count(*) AS n_windows FROM hot GROUP BY run HAVING count(*) >= 2"""
)
def alert_for_duration(t):
    windows = M.success_per_window(t.events, "ts", error(), "1 hour")
    return M.sustained(windows, "window_start", M.share(F.col("errors"), F.col("n")) > 0.2, 2, 3600)


@query(
    """WITH w AS (SELECT user_id % 10 AS shard, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS r FROM events GROUP BY ALL),
    hot AS (SELECT shard, s, epoch(s)::BIGINT // 3600 - row_number() OVER (PARTITION BY shard ORDER BY s) AS run FROM w WHERE r > 0.2)
    SELECT shard, min(s) AS alert_start, max(s) AS alert_end, count(*) AS n_windows FROM hot GROUP BY shard, run HAVING count(*) >= 2"""
)
def alert_for_duration_by_key(t):
    windows = t.events.groupBy((F.col("user_id") % 10).alias("shard"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(error()).alias("errors"))
    windows = windows.withColumn("window_start", F.col("w.start"))
    return M.sustained(windows, "window_start", M.share(F.col("errors"), F.col("n")) > 0.2, 2, 3600, "shard")


def _series(shares: str, step: int, key: str = "0") -> str:
    """Shares at every instant of a grid by a range join."""
    return f"""WITH e AS (SELECT *, {key} AS series FROM events), b AS (SELECT series, min(ceil(epoch_us(ts) / {step}000000.0)::BIGINT) AS a, (SELECT max(ceil(epoch_us(ts) / {step}000000.0)::BIGINT) FROM events) AS z FROM e GROUP BY series),
    g AS (SELECT series, make_timestamp(unnest(range(a, z + 1)) * {step}000000) AS moment FROM b)
    SELECT g.series, g.moment, {shares} FROM g LEFT JOIN e ON e.series = g.series AND e.ts <= g.moment AND e.ts > g.moment - INTERVAL 72 HOUR GROUP BY ALL"""


_ERRORS = ", ".join(f"coalesce(count(*) FILTER (ts > moment - INTERVAL {h} HOUR AND event_type = 'error') / nullif(count(*) FILTER (ts > moment - INTERVAL {h} HOUR), 0)::DOUBLE, 0) AS err_{h}h" for h in _HOURS)


@query(
    f"""SELECT moment, {_ROUNDED}, err_1h > 14.4 * 0.005 AND err_6h > 14.4 * 0.005 AS fast_burn, err_6h > 6 * 0.005 AND err_24h > 6 * 0.005 AS slow_burn,
    (err_1h > 14.4 * 0.005 AND err_6h > 14.4 * 0.005) OR (err_6h > 6 * 0.005 AND err_24h > 6 * 0.005) AS burning,
    round(1 - err_72h / 0.005, 6) AS budget_left, 1 - err_72h / 0.005 < 0.1 AS budget_low, 1 - err_72h / 0.005 <= 0 AS budget_gone, round(err_72h * 30 / 0.005 * 100, 4) AS consumed_percent FROM ({_series(_ERRORS, 1800)})"""
)
def rule_series(t):
    """The service level's rules at every half hour, not only at the latest event."""
    out = _round(P.availability_series(t.events, "ts", error(), 1800))
    return out.withColumn("budget_left", F.round("budget_left", 6)).withColumn("consumed_percent", F.round("consumed_percent", 4))


_WITHIN = ", ".join(f"count(*) FILTER (ts > moment - INTERVAL {m} MINUTE AND value <= 60) / nullif(count(*) FILTER (ts > moment - INTERVAL {m} MINUTE), 0)::DOUBLE AS within_{m}m" for m in (30, 360))


@query(f"SELECT series AS shard, moment, round(within_30m, 6) AS within_30m, round(within_360m, 6) AS within_360m FROM ({_series(_WITHIN, 1800, 'user_id % 4')})")
def latency_series(t):
    """Per shard; null where nothing was asked."""
    rows = t.events.withColumn("shard", F.col("user_id") % 4)
    out = P.share_series(rows, "ts", F.col("value") <= 60, (30, 360), 1800, by=("shard",))
    return out.select("shard", "moment", F.round("within_30m", 6).alias("within_30m"), F.round("within_360m", 6).alias("within_360m"))


@query(
    f"""SELECT moment, round(err_1h, 6) AS err_1h, err_1h > 0.2 AS pending, bool_and(err_1h > 0.2) OVER w AND count(*) OVER w = 3 AS firing FROM ({_series(_ERRORS, 1800)})
    WINDOW w AS (ORDER BY moment RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"""
)
def alert_series(t):
    """An alert that must hold for an hour: pending and firing at every half hour."""
    rates = P.error_series(t.events, "ts", error(), (1,), 1800)
    return P.holding_series(rates, F.col("err_1h") > 0.2, 3600, 1800).withColumn("err_1h", F.round("err_1h", 6))


@query(
    """WITH s AS (SELECT user_id % 4 AS pod, ts, epoch_us(ts) / 1e6 AS s, (event_id % 50)::DOUBLE AS v FROM events),
    d AS (SELECT *, lag(v) OVER (PARTITION BY pod ORDER BY ts, v) AS p FROM s),
    b AS (SELECT min(ceil(s / 3600)::BIGINT) AS a, max(ceil(s / 3600)::BIGINT) AS z FROM s),
    g AS (SELECT unnest(range(a, z + 1)) * 3600 AS moment FROM b),
    w AS (SELECT d.pod, g.moment, d.s, d.v, CASE WHEN row_number() OVER (PARTITION BY d.pod, g.moment ORDER BY d.s, d.v) = 1 THEN 0 WHEN d.v >= d.p THEN d.v - d.p ELSE d.v END AS rise FROM d JOIN g ON d.s <= g.moment AND d.s > g.moment - 21600),
    x AS (SELECT pod, moment, count(*) AS n, min(s) AS f, max(s) AS l, arg_min(v, (s, v)) AS fv, sum(rise) AS rise FROM w GROUP BY ALL HAVING count(*) >= 2 AND max(s) > min(s)),
    y AS (SELECT *, l - f AS span, (l - f) / (n - 1) AS mean, f - (moment - 21600) AS ds, moment - l AS de FROM x),
    z AS (SELECT *, CASE WHEN ds >= 1.1 * mean THEN mean / 2 ELSE ds END AS es, CASE WHEN de >= 1.1 * mean THEN mean / 2 ELSE de END AS ee FROM y)
    SELECT pod, make_timestamp(moment * 1000000) AS moment, round(rise * (span + least(es, CASE WHEN rise > 0 AND fv >= 0 THEN span * fv / rise ELSE es END) + ee) / span, 4) AS increase FROM z"""
)
def counter_series(t):
    """What counters that restart rose in six hours, at every hour."""
    counters = t.events.select((F.col("user_id") % 4).alias("pod"), "ts", (F.col("event_id") % 50).alias("v"))
    return P.rate_series(counters, "ts", "v", 21600, 3600, ("pod",)).select("pod", "moment", F.round("increase", 4).alias("increase"))


_TRACE = "user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d')"


@query(f"SELECT event_id, trace FROM (SELECT *, {_TRACE} AS trace FROM events) WHERE trace IN (SELECT {_TRACE} FROM events GROUP BY ALL HAVING bool_or(event_type = 'error' AND value >= 50) OR (('0x' || substr(md5({_TRACE}), 1, 4))::BIGINT % 100) < 5)")
def tail_sample_traces(t):
    """A user's events of a day as a trace, which stays or goes as a whole."""
    rows = t.events.withColumn("trace", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    return M.sampled_tail(rows, error() & (F.col("value") >= 50), F.col("trace"), 5, F.col("trace")).select("event_id", "trace")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR value >= 200 OR (('0x' || substr(md5(event_id::VARCHAR), 1, 4))::BIGINT % 100) < 1")
def tail_sample(t):
    return M.sampled_tail(t.events, error() | (F.col("value") >= 200), F.col("event_id")).select("event_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limit_violations(t):
    return M.over_limit(t.events, "ts", "user_id", "1 hour", 2)


@query("SELECT event_type, ts, event_id, error FROM (SELECT event_type, ts, event_id, CASE WHEN event_type = 'error' AND value > 20 THEN props END AS error FROM events) WHERE error IS NOT NULL ORDER BY ts DESC, event_id LIMIT 20")
def recent_errors(t):
    """Most rows have no error, some errors none either."""
    log = t.events.select("event_type", "ts", "event_id", F.when(error() & (F.col("value") > 20), F.col("props")).alias("error"))
    return S.page(log.filter(F.col("error").isNotNull()), (F.desc("ts"), "event_id"), 20)


@query("SELECT event_id, event_type, 'agent' AS search_type FROM events WHERE event_type = 'click'")
def agent_results(t):
    runs = t.events.filter("event_type = 'click'").select("event_id", "event_type", F.col("props").alias("tool_calls"), F.lit("similarity").alias("search_type"))
    return S.agent_results(runs)


@query("SELECT event_id, user_id, ts, event_type FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id LIMIT 10 OFFSET 2")
def history_page(t):
    return S.page(S.point(t.events, "user_id", 1).select("event_id", "user_id", "ts", "event_type"), (F.desc("ts"), "event_id"), 10, 2)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, grouping(event_type)::BIGINT AS all_types, grouping(user_id % 10)::BIGINT AS all_shards FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def extra_rollup(t):
    """Beyond the surveyed operators: totals and subtotals."""
    e = t.events.select("event_type", (F.col("user_id") % 10).alias("shard"))
    return e.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("all_types"), F.grouping("shard").cast("long").alias("all_shards"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def extra_sessions(t):
    """Beyond the surveyed operators: sessions that end after six idle hours."""
    out = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")
