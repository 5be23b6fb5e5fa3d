"""Metrics that are counted while queries run: observed per micro-batch, added up by a listener, rendered as text.

What is counted is part of the query's own plan, so it costs no second pass: counters
and histograms by the known values of a label.  A batch that is done again after a
failure reports once, as its progress comes with its number.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.monitoring import exposition

#: Bounds of the latency histogram in seconds.
BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


class Metrics:
    """A counter and a histogram per value of a label, named name_total, name_bucket, name_sum and name_count."""

    def __init__(self, name: str, label: str, values: Sequence[str], bounds: Sequence[float] = BOUNDS) -> None:
        self.name, self.label, self.values, self.bounds = name, label, list(values), list(bounds)
        self.totals: dict[str, float] = {}
        self.seen: set[tuple[str, int]] = set()
        self.lock = threading.Lock()

    def _columns(self, label: Column, value: Column) -> list[Column]:
        """A column per number; what is of no known label counts as the last, ``other``."""
        known = label.isin(*self.values)
        own = {str(i): label == v for i, v in enumerate(self.values)} | {str(len(self.values)): F.coalesce(~known, F.lit(True))}
        out = []
        for i, mine in own.items():
            mine = F.coalesce(mine, F.lit(False))
            out += [F.count_if(mine).alias(f"n_{i}"), F.coalesce(F.sum(F.when(mine, value)), F.lit(0.0)).alias(f"s_{i}")]
            out += [F.count_if(mine & (value <= b)).alias(f"b_{i}_{j}") for j, b in enumerate(self.bounds)]
        return out

    def observed(self, rows: DataFrame, label: Column, value: Column) -> DataFrame:
        """rows, counted by a stream's listener as they pass."""
        return rows.observe(self.name, *self._columns(label, value))

    def counted(self, rows: DataFrame, label: Column, value: Column) -> tuple[DataFrame, Observation]:
        """rows of a batch query, and what add() takes once it has run."""
        seen = Observation(self.name)
        return rows.observe(seen, *self._columns(label, value)), seen

    def add(self, counts: dict, of: tuple[str, int] | None = None) -> None:
        """Adds up the numbers of a batch, once for each (run, batch number)."""
        with self.lock:
            if of is not None and of in self.seen:
                return
            if of is not None:
                self.seen = {x for x in self.seen if x[0] != of[0]} | {of}  # batches of a run come in order
            for k, v in counts.items():
                self.totals[k] = self.totals.get(k, 0) + v

    def listener(self) -> StreamingQueryListener:
        """For spark.streams.addListener()."""
        metrics = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                row = event.progress.observedMetrics.get(metrics.name)
                if row is not None:
                    metrics.add(row.asDict(), (str(event.progress.runId), event.progress.batchId))

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                pass

        return Listener()

    def table(self, spark: SparkSession) -> DataFrame:
        """(metric, label, le, value): the numbers so far."""
        rows = []
        for i, v in enumerate([*self.values, "other"]):
            n = float(self.totals.get(f"n_{i}", 0))
            rows += [("total", v, None, n), ("count", v, None, n), ("sum", v, None, float(self.totals.get(f"s_{i}", 0)))]
            rows += [("bucket", v, str(b), float(self.totals.get(f"b_{i}_{j}", 0))) for j, b in enumerate(self.bounds)] + [("bucket", v, "+Inf", n)]
        return spark.createDataFrame(rows, f"metric string, {self.label} string, le string, value double")

    def text(self, spark: SparkSession, about: str = "") -> list[str]:
        """The text format: a counter, and a histogram with its buckets, sums and counts."""
        rows, out = self.table(spark), []
        for metric, kind, labels in (("total", "counter", (self.label,)), ("bucket", "histogram", (self.label, "le")), ("sum", "untyped", (self.label,)), ("count", "untyped", (self.label,))):
            lines = exposition(rows.filter(F.col("metric") == metric), f"{self.name}_{metric}", kind, about, "value", *labels)
            out += [r.line for r in lines.collect()]
        return out
