"""Rules evaluated over time: shares and rates over trailing windows of many lengths, at every step of a grid.

Events are counted once into the grid's steps.  Counts are summed up along the grid,
block by block, and a window's count is the difference of two sums; each sum is sent to
the instants at which windows of the wanted lengths begin, so that windows from
minutes to days come from one aggregation, and no task has the whole grid.

An instant T stands for the events in (T - length, T].  Lengths are multiples of the
step.  Events without a time are left out; a null key is a key; no events give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .monitoring import ALLOWED, budget, budget_consumed, burn_alerts

#: Steps of a block of the grid, within which one task sums up.
BLOCK = 4096


def _slots(lengths: Sequence[int], step: int) -> list[int]:
    if any(n <= 0 or n % step for n in lengths):
        raise ValueError(f"lengths must be multiples of the step of {step} seconds")
    return [n // step for n in lengths]


def slot(time: Column, step: int) -> Column:
    """The number of the first instant of the grid that isn't before a time."""
    return F.ceil(F.unix_micros(time.cast("timestamp")) / F.lit(step * 1_000_000)).cast("long")


def instant(number: Column, step: int) -> Column:
    return F.timestamp_seconds(number * step).cast("timestamp_ntz")


def _dense(counts: DataFrame, by: Sequence[str], last: Column) -> DataFrame:
    """counts on every instant from each key's first to ``last``: the steps between are explicit zeros."""
    ends = counts.groupBy(*by).agg(F.min("slot").alias("__a"), F.max("slot").alias("__b"))
    end = F.broadcast(counts.agg(last.alias("__last")))
    grid = ends.crossJoin(end).select(*by, F.explode(F.sequence("__a", F.greatest("__b", "__last"))).alias("slot"))
    zero = [F.lit(0).cast("long").alias(c) for c in counts.columns if c not in (*by, "slot")]
    both = counts.unionByName(grid.select(*by, "slot", *zero))
    return both.groupBy(*by, "slot").agg(*(F.sum(c).alias(c) for c in counts.columns if c not in (*by, "slot")))


def _running(dense: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """dense with its columns summed up along the grid: within blocks, then by the blocks' totals."""
    placed = dense.withColumn("__block", F.floor(F.col("slot") / BLOCK))
    inside = Window.partitionBy(*by, "__block").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({c: F.sum(c).over(inside) for c in columns})
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # a row per block: its last running sums are its totals
    totals = placed.groupBy(*by, "__block").agg(*(F.max_by(c, "slot").alias(f"__{c}") for c in columns))
    totals = totals.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("__block").alias("__of"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    same = F.col("__block") == F.col("__of")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return placed.join(totals, same).select(*by, "slot", *((F.col(c) + F.col(f"__{c}")).alias(c) for c in columns))


def trailing_counts(events: DataFrame, time: str, conditions: dict[str, Column], lengths: Sequence[int], step: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., moment, <name>_<length>s ...): at every instant of the grid how many events of the last ``length`` seconds fulfil each condition."""
    sizes = _slots(lengths, step)
    names = list(conditions)
    counts = events.filter(F.col(time).isNotNull()).groupBy(*by, slot(F.col(time), step).alias("slot")).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    sums = _running(_dense(counts, by, F.max("slot")), by, names)
    # each sum goes to its own instant and to those whose windows begin there
    sent = sums.select(*by, *names, F.col("slot").alias("__from"), F.explode(F.array(*(F.lit(s) for s in [0, *sizes]))).alias("__after"))
    at = sent.groupBy(*by, (F.col("__from") + F.col("__after")).alias("slot"))
    own = {n: F.max(F.when(F.col("__after") == 0, F.col(n))) for n in names}
    gone = {(n, s): F.max(F.when(F.col("__after") == s, F.col(n))) for n in names for s in sizes}
    wide = at.agg(*(c.alias(n) for n, c in own.items()), *(c.alias(f"{n}__{s}") for (n, s), c in gone.items())).filter(F.col(names[0]).isNotNull())
    columns = [(F.col(n) - F.coalesce(F.col(f"{n}__{s}"), F.lit(0))).alias(f"{n}_{length}s") for n in names for s, length in zip(sizes, lengths, strict=True)]
    return wide.select(*by, instant(F.col("slot"), step).alias("moment"), *columns)


def error_series(events: DataFrame, time: str, is_error: Column, hours: Sequence[int], step: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., moment, err_<h>h ...): the error shares of the trailing hours at every instant, 0 where nothing was asked."""
    lengths = [h * 3600 for h in hours]
    rows = trailing_counts(events, time, {"n": F.lit(True), "bad": is_error}, lengths, step, by)
    return rows.select(*by, "moment", *(F.coalesce(F.try_divide(F.col(f"bad_{s}s").cast("double"), F.col(f"n_{s}s").cast("double")), F.lit(0.0)).alias(f"err_{h}h") for h, s in zip(hours, lengths, strict=True)))


def availability_series(events: DataFrame, time: str, is_error: Column, step: int, allowed: float = ALLOWED, by: Sequence[str] = ()) -> DataFrame:
    """error_series() of 1, 6, 24 and 72 hours with the burn alerts and what is left of the budget, at every instant."""
    return budget_consumed(budget(burn_alerts(error_series(events, time, is_error, (1, 6, 24, 72), step, by), allowed), allowed), allowed)


def share_series(events: DataFrame, time: str, good: Column, minutes: Sequence[int], step: int, name: str = "within", by: Sequence[str] = ()) -> DataFrame:
    """(by..., moment, <name>_<m>m ...): the shares of good events of the trailing minutes at every instant, null where there is none."""
    lengths = [m * 60 for m in minutes]
    rows = trailing_counts(events, time, {"n": F.lit(True), "good": good}, lengths, step, by)
    return rows.select(*by, "moment", *(F.try_divide(F.col(f"good_{s}s").cast("double"), F.col(f"n_{s}s").cast("double")).alias(f"{name}_{m}m") for m, s in zip(minutes, lengths, strict=True)))


def holding_series(series: DataFrame, condition: Column, hold: int, step: int, by: Sequence[str] = ()) -> DataFrame:
    """series with ``pending`` (the condition holds) and ``firing`` (it has held for ``hold`` seconds of instants, this one included)."""
    true = F.coalesce(condition, F.lit(False))
    number = F.floor(F.unix_seconds(F.col("moment").cast("timestamp")) / step)
    need = hold // step + 1
    counted = series.withColumn("pending", true).withColumn("__slot", number).withColumn("__block", F.floor(F.col("__slot") / BLOCK))
    # an instant also belongs to the next block's start, where its window reaches back to it
    copies = F.array_distinct(F.array(F.col("__block"), F.floor((F.col("__slot") + need - 1) / BLOCK)))
    spread = counted.withColumn("__in", F.explode(copies))
    back = Window.partitionBy(*by, "__in").orderBy("__slot").rangeBetween(-(need - 1), 0)
    held = spread.withColumn("firing", F.sum(F.col("pending").cast("int")).over(back) == need).filter(F.col("__in") == F.col("__block"))
    return held.drop("__slot", "__block", "__in")


def rate_series(samples: DataFrame, time: str, value: str, length: int, step: int, by: Sequence[str]) -> DataFrame:
    """(by..., moment, increase, rate) of counters: what a counter rose in the trailing window, carried on to the window's edges, and that a second.

    A fall is a restart from 0.  The rise between the first and the last sample is
    carried on to an edge that is within 1.1 mean distances of samples, else by half
    such a distance, and never below a counter's zero.  Windows with fewer than two
    samples, or samples of one time only, have no row.
    """
    (size,) = _slots([length], step)
    series = Window.partitionBy(*by).orderBy(time, value)
    rows = samples.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(time).alias("__t"), F.col(value).cast("double").alias("__v"), F.lag(F.col(value).cast("double")).over(series).alias("__p"), slot(F.col(time), step).alias("slot"))
    rows = rows.withColumn("__rise", F.when(F.col("__p").isNull(), 0.0).when(F.col("__v") >= F.col("__p"), F.col("__v") - F.col("__p")).otherwise(F.col("__v"))).withColumn("__s", F.unix_micros(F.col("__t").cast("timestamp")) / 1e6)
    order = F.struct("__s", "__v")
    # a row per step: its first and last sample, its rises, and the rise that leads into it
    steps = rows.groupBy(*by, "slot").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sum("__rise").alias("rise"), F.min_by("__rise", order).alias("into"))
    sent = steps.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + size - 1)))
    in_window = sent.groupBy(*by, "slot").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.sum("n").alias("n"), (F.sum("rise") - F.min_by("into", "first")).alias("rise"))
    ends = instant(F.col("slot"), step)
    known = in_window.filter("n >= 2 and l.__s > f.__s").withColumn("span", F.col("l.__s") - F.col("f.__s"))
    mean = F.col("span") / (F.col("n") - 1)
    to_start, to_end = F.col("f.__s") - (F.col("slot") * step - length), F.col("slot") * step - F.col("l.__s")
    near = lambda d: F.when(d >= 1.1 * mean, mean / 2).otherwise(d)
    zero = F.when((F.col("rise") > 0) & (F.col("f.__v") >= 0), F.col("span") * F.col("f.__v") / F.col("rise"))
    whole = (F.col("span") + F.least(near(to_start), F.coalesce(zero, near(to_start))) + near(to_end)) / F.col("span")
    increase = F.col("rise") * whole
    last = F.broadcast(steps.agg(F.max("slot").alias("__last")))
    return known.crossJoin(last).filter("slot <= __last").select(*by, ends.alias("moment"), increase.alias("increase"), (increase / length).alias("rate"))
