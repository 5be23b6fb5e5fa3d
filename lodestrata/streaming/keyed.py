"""Streams with state of their own: alerts that must hold for a while, and traces that are kept or dropped whole.

Both use event-time timers: what is decided depends on the events and their times, not
on how they came in batches.  State is bounded by what is open: for alerts the windows
of a key that the watermark hasn't closed and one run; for traces those that wait, of
which a shard holds at most ``most_open``, and the decisions of the last while.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(grouped, spark, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Keyed state needs the state store on disk, so that it may outgrow memory."""
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="eventTime")


class _Holding(StatefulProcessor):
    """Windows of a key that aren't closed, and the run of windows above that the last closed one ends."""

    def __init__(self, least: int, width_ms: int, limit: float) -> None:
        self.least, self.width, self.limit = least, width_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("windows", "slot long", "n long, bad long")
        self.run = handle.getValueState("run", "first long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen: dict[int, list[int]] = {}
        for part in rows:
            slots = part["at_ms"] // self.width
            for slot, n, bad in zip(*(x.tolist() for x in (lambda g: (g.index, g["count"], g["sum"]))(part["was_bad"].astype("int64").groupby(slots).agg(["count", "sum"]))), strict=True):
                have = seen.setdefault(slot, [0, 0])
                have[0], have[1] = have[0] + n, have[1] + bad
        closed = timerValues.getCurrentWatermarkInMs()
        for slot, (n, bad) in seen.items():
            if (slot + 1) * self.width <= closed:
                continue  # late: its window is closed
            if self.open.containsKey((slot,)):
                before = self.open.getValue((slot,))
                n, bad = n + before[0], bad + before[1]
            else:
                self.handle.registerTimer((slot + 1) * self.width)
            self.open.updateValue((slot,), (n, bad))
        yield from ()

    def _row(self, key: tuple, state: str, first: int, last: int) -> pd.DataFrame:
        at = lambda slot: pd.Timestamp(slot * self.width, unit="ms")
        return pd.DataFrame({"key": [key[0]], "state": [state], "alert_start": [at(first)], "alert_end": [at(last)], "n_windows": [last - first + 1]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // self.width  # windows before this one are closed
        done = sorted((slot, n, bad) for (slot,), (n, bad) in self.open.iterator() if slot < closed)
        run = self.run.get() if self.run.exists() else None
        for slot, n, bad in done:
            self.open.removeKey((slot,))
            above = bad > self.limit * n
            if run and not (above and run[1] == slot - 1):
                if run[1] - run[0] + 1 >= self.least:
                    yield self._row(key, "resolved", *run)
                run = None
            if above:
                run = (run[0] if run else slot, slot)
                if run[1] - run[0] + 1 == self.least:
                    yield self._row(key, "firing", *run)
        if run and run[1] + 1 < closed:  # the next window is closed without events
            if run[1] - run[0] + 1 >= self.least:
                yield self._row(key, "resolved", *run)
            run = None
        if run:
            self.run.update(run)
            self.handle.registerTimer((run[1] + 2) * self.width)
        elif self.run.exists():
            self.run.clear()

    def close(self) -> None:
        pass


def alerts(events: DataFrame, key: Column, is_bad: Column, limit: float, least: int, width_seconds: int, time: str = "ts") -> DataFrame:
    """(key, state, alert_start, alert_end, n_windows) of a stream with a watermark: ``firing`` when a key's share of bad events has been above the limit in ``least`` windows in a row, ``resolved`` when that ends.

    The resolved rows are those of monitoring.sustained() over the same events.  Events
    later than the watermark are left out; a null key is a key.
    """
    rows = events.select(key.cast("string").alias("key"), F.col(time), F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"), F.coalesce(is_bad, F.lit(False)).alias("was_bad"))
    schema = "key string, state string, alert_start timestamp_ntz, alert_end timestamp_ntz, n_windows long"
    return _with_state(rows.groupBy("key"), events.sparkSession, _Holding(least, width_seconds * 1000, limit), schema)


class _Tracing(StatefulProcessor):
    """Open traces of a shard with their events, and what was decided of others."""

    def __init__(self, percent: int, wait_ms: int, remember_ms: int, most_open: int) -> None:
        self.percent, self.wait, self.remember, self.most = percent, wait_ms, remember_ms, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "trace string", "due long, keep boolean, events array<string>")
        self.decided = handle.getMapState("decided", "trace string", "keep boolean, until long")

    def _kept(self, trace: str, keep: bool) -> bool:
        return keep or int(hashlib.md5(trace.encode()).hexdigest()[:4], 16) % 100 < self.percent

    def _decide(self, trace: str, entry: tuple, now: int) -> list[str]:
        keep = self._kept(trace, entry[1])
        self.open.removeKey((trace,))
        self.decided.updateValue((trace,), (keep, max(now, entry[0]) + self.remember))
        self.handle.registerTimer(max(now, entry[0]) + self.remember)
        return list(entry[2]) if keep else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        new: dict[str, list] = {}
        for part in rows:
            for trace, ms, keep, event in zip(part["trace"], part["at_ms"].tolist(), part["to_keep"].tolist(), part["event"], strict=True):
                have = new.setdefault(trace, [ms, False, []])
                have[0], have[1] = min(have[0], ms), have[1] or keep
                have[2].append(event)
        for trace, (ms, keep, events) in new.items():
            if self.decided.containsKey((trace,)):
                out += events if self.decided.getValue((trace,))[0] else []  # as its trace was
                continue
            if self.open.containsKey((trace,)):
                due, kept, before = self.open.getValue((trace,))
                self.open.updateValue((trace,), (due, kept or keep, [*before, *events]))
            else:
                due = max(ms, now) + self.wait
                self.handle.registerTimer(due)
                self.open.updateValue((trace,), (due, keep, events))
        waiting = sorted((due, trace) for (trace,), (due, *_) in self.open.iterator()) if new else []
        for _, trace in waiting[: max(0, len(waiting) - self.most)]:  # the oldest are decided by what is known
            out += self._decide(trace, self.open.getValue((trace,)), now)
        if out:
            yield pd.DataFrame({"event": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for (trace,), entry in list(self.open.iterator()):
            if entry[0] <= now:
                out += self._decide(trace, entry, now)
        for (trace,), (_, until) in list(self.decided.iterator()):
            if until <= now:
                self.decided.removeKey((trace,))
        if out:
            yield pd.DataFrame({"event": out})

    def close(self) -> None:
        pass


def sampled_traces(events: DataFrame, trace: Column, keep: Column, percent: int = 1, wait_seconds: int = 10, remember_seconds: int = 3600, most_open: int = 50_000, shards: int = 64, time: str = "ts") -> DataFrame:
    """The events of whole traces: those with an event to keep, and a share of the others by the trace's MD5.

    A trace is decided ``wait_seconds`` of event time after its first event (or earlier,
    as one of a shard's oldest, when more than ``most_open`` wait); events that come
    later within ``remember_seconds`` go the way of their trace.  Traces are dealt to
    ``shards`` by hash.  Null traces are one trace named ''.
    """
    name = F.coalesce(trace.cast("string"), F.lit(""))
    whole = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = events.select(F.pmod(F.xxhash64(name), F.lit(shards)).alias("shard"), F.col(time), name.alias("trace"), F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"), F.coalesce(keep, F.lit(False)).alias("to_keep"), whole.alias("event"))
    kept = _with_state(rows.groupBy("shard"), events.sparkSession, _Tracing(percent, wait_seconds * 1000, remember_seconds * 1000, most_open), "event string")
    parsed = F.from_json("event", json.dumps(json.loads(events.schema.json())), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return kept.select(parsed.alias("e")).select("e.*")


class _Caching(StatefulProcessor):
    """Entries of a shard of a cache, each with the time it ends."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "name string", "value string, until long")

    def _set(self, name: str, value: str, until: int) -> None:
        self.entries.updateValue((name,), (value, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        events = pd.concat(list(rows)).sort_values(["at_ms", "nth"], kind="stable")
        for at, op, name, value, seconds in zip(events["at_ms"].tolist(), events["op"], events["key"], events["value"], events["ttl"], strict=True):
            until = at + (self.ttl if pd.isna(seconds) else int(seconds) * 1000)
            if op == "clear":
                for (n,), entry in list(self.entries.iterator()):
                    if n.startswith(f"{name}:"):
                        self.entries.removeKey((n,))
                        out.append((n, "cleared" if entry[1] > at else "expired", entry[0], at if entry[1] > at else entry[1]))
                continue
            have = self.entries.getValue((name,)) if self.entries.containsKey((name,)) else None
            if have and have[1] <= at:  # over before this event
                self.entries.removeKey((name,))
                out.append((name, "expired", have[0], have[1]))
                have = None
            if op == "set":
                self._set(name, value, until)
                out.append((name, "set", value, at))
            elif op == "touch" and have:
                self._set(name, have[0], until)
                out.append((name, "touched", have[0], at))
            elif op == "delete" and have:
                self.entries.removeKey((name,))
                out.append((name, "deleted", have[0], at))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "state", "value", "at"])
        return out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for (name,), (value, until) in list(self.entries.iterator()):
            if until <= now:
                self.entries.removeKey((name,))
                out.append((name, "expired", value, until))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def cached(changes: DataFrame, ttl_seconds: int = 3600, shards: int = 16, time: str = "ts", order: str | None = None) -> DataFrame:
    """(key, state, value, at) of a stream of a cache's changes (op, key, value, ttl) with a watermark: ``set``, ``touched``, ``deleted``, ``cleared`` and, at its event time, ``expired``.

    op: set; touch (a live entry lives ``ttl`` seconds from then on); delete; clear (of a
    namespace, whose entries are called ``<key>:...``).  A null ttl is ttl_seconds.
    Changes of a batch are taken by time, then ``order``; later batches come after.  Live
    entries are the state ``entries``, which live() reads from a checkpoint.  Null keys
    are left out.
    """
    of = F.when(F.col("op") == "clear", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")))
    nth = (F.col(order) if order else F.lit(0)).cast("long")
    rows = changes.filter(F.col("key").isNotNull()).select(F.explode(of).alias("shard"), F.col(time), F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"), nth.alias("nth"), "op", "key", "value", F.col("ttl").cast("double").alias("ttl"))
    return _with_state(rows.groupBy("shard"), changes.sparkSession, _Caching(ttl_seconds * 1000), "key string, state string, value string, at timestamp_ntz")


def live(spark, checkpoint: str) -> DataFrame:
    """(key, value, expires_at) of the entries that a cached() stream holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    entry = state.select(F.col("user_map_key.name").alias("key"), F.col("user_map_value.value").alias("value"), F.col("user_map_value.until").alias("until"))
    return entry.select("key", "value", F.timestamp_millis("until").cast("timestamp_ntz").alias("expires_at"))
