"""Smoothing, guards, runs and motion over tracks in time order; each is a window over (track, time)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def trailing_std(df: DataFrame, by: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """Sample deviation of the last `rows` values, 0 where there is none."""
    w = _ordered(by, order).rowsBetween(1 - rows, 0)
    return df.withColumn(f"{value}_std", F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)))


def rolling_median(df: DataFrame, by: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Median of the finite values up to `half` rows to both sides."""
    w = _ordered(by, order).rowsBetween(-half, half)
    kept = F.when(finite(F.col(value)), F.col(value))
    return df.withColumn(f"{value}_median", F.percentile(kept, F.lit(0.5)).over(w))


def kernel(shape: str, half: int, sigma: float | None = None) -> list[float]:
    """Weights of a window of 2 * half + 1 rows that sum to 1: boxcar, triangular or gaussian."""
    if shape == "boxcar":
        raw = [1.0] * (2 * half + 1)
    elif shape == "triangular":
        raw = [half + 1.0 - abs(i) for i in range(-half, half + 1)]
    elif shape == "gaussian":
        s = sigma if sigma and sigma > 0 else max(half / 1.5, 1.0)
        raw = [math.exp(-0.5 * (i / s) ** 2) for i in range(-half, half + 1)]
    else:
        raise ValueError(f"unknown kernel {shape}")
    return [x / sum(raw) for x in raw]


def smooth(df: DataFrame, by: list[str], order: list[str], value: str, weights: list[float]) -> DataFrame:
    """Weighted mean over a centred window; the rows whose window is not whole keep their value."""
    w, half = _ordered(by, order), len(weights) // 2
    at = lambda i: F.col(value) if i == 0 else F.lag(value, -i).over(w) if i < 0 else F.lead(value, i).over(w)
    place = F.row_number().over(w)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    whole = (place > half) & (place <= size - half)
    total = sum((at(i) * F.lit(weights[i + half]) for i in range(-half, half + 1)), F.lit(0.0))
    return df.withColumn(f"{value}_kernel", F.when(whole, total).otherwise(F.col(value)))


def drop_bad_drift(df: DataFrame, by: list[str], order: list[str], drift: str, most: float = 1e3, jump: float = 50.0) -> DataFrame:
    """Null drifts that are too large, and then both ends of a jump; fill_linear() closes the gaps."""
    w = _ordered(by, order)
    fine = F.when(finite(F.col(drift)) & (F.abs(drift) <= most), F.col(drift))
    out = df.withColumn("__d", fine)
    before, after = F.abs(F.col("__d") - F.lag("__d").over(w)) > jump, F.abs(F.lead("__d").over(w) - F.col("__d")) > jump
    bad = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return out.withColumn(f"{drift}_clean", F.when(~bad, F.col("__d"))).drop("__d")


def acceleration_weights(df: DataFrame, by: list[str], order: list[str], value: str, weight: str, threshold: float) -> DataFrame:
    """Weights lowered by the second difference over the last two values of a satellite, in order of arrival."""
    w = _ordered(by, order)
    accel = F.abs(F.col(value) - 2.0 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))
    return df.withColumn(f"{weight}_new", F.col(weight) * F.coalesce(1.0 / (1.0 + (accel / threshold) * (accel / threshold)), F.lit(1.0)))


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: Column, least: int) -> DataFrame:
    """(by, first, last, n) of the longest run of rows with the flag, row numbers from 0; a tie goes to the earlier one."""
    w = _ordered(by, order)
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__r", F.row_number().over(w) - 1)
    runs = rows.where("__f").withColumn("__i", F.col("__r") - F.row_number().over(w))
    runs = runs.groupBy(*by, "__i").agg(F.min("__r").alias("first"), F.max("__r").alias("last"), F.count("*").alias("n"))
    best = runs.groupBy(*by).agg(F.max(F.struct("n", -F.col("first"), "last")).alias("b"))
    return best.select(*by, (-F.col("b").getField("col2")).alias("first"), F.col("b.last").alias("last"), F.col("b.n").alias("n")).where(F.col("n") >= least)


def tail_guard(df: DataFrame, by: list[str], order: list[str], conditions: list[Column], stop: Column, expand: int = 0, expand_if: Column | None = None) -> DataFrame:
    """Flags `guarded` (all conditions hold; none given: never) and `expanded` (within `expand` rows of a guarded one).

    Rows that stand still neither spread the guard nor take it on by spreading.
    """
    all_hold = F.lit(bool(conditions))
    for c in conditions:
        all_hold = all_hold & F.coalesce(c, F.lit(False))
    out = df.withColumn("guarded", all_hold)
    if not expand:
        return out.withColumn("expanded", F.lit(False))
    still = F.coalesce(stop, F.lit(False))
    near = F.max((F.col("guarded") & ~still).cast("int")).over(_ordered(by, order).rowsBetween(-expand, expand)) == 1
    allowed = F.coalesce(expand_if, F.lit(False)) if expand_if is not None else F.lit(True)
    return out.withColumn("expanded", ~F.col("guarded") & near & ~still & allowed)


def motion_stats(df: DataFrame, by: list[str], order: list[str], xyz: list[str]) -> DataFrame:
    """Mean and 95th percentile of the steps and of the second differences of a path; 0 where there are none."""
    w = _ordered(by, order)
    length = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    one = [F.col(c) - F.lag(c).over(w) for c in xyz]
    two = [F.col(c) - 2.0 * F.lag(c).over(w) + F.lag(c, 2).over(w) for c in xyz]
    steps = df.select(*by, length(one).alias("s"), length(two).alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    return steps.groupBy(*by).agg(zero(F.avg("s")).alias("step_mean"), zero(p95("s")).alias("step_p95"), zero(F.avg("a")).alias("accel_mean"), zero(p95("a")).alias("accel_p95"))


def moving(df: DataFrame, by: list[str], order: list[str], at: str, xyz: list[str], rows: int) -> DataFrame:
    """Speed of the velocities averaged over the last `rows` epochs; the first epoch counts as standing."""
    w = _ordered(by, order)
    dt = F.col(at) - F.lag(at).over(w)
    out = df.withColumns({f"__v{i}": F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).otherwise(F.lit(0.0)) for i, c in enumerate(xyz)})
    mean = [F.avg(f"__v{i}").over(w.rowsBetween(1 - rows, 0)) for i in range(len(xyz))]
    return out.withColumn("speed", F.sqrt(sum((m * m for m in mean), F.lit(0.0)))).drop(*[f"__v{i}" for i in range(len(xyz))])


def paired_consistency(df: DataFrame, by: list[str], order: list[str], at: str, value: str, rate: str, weight: str, interval: Column, limit: float, most: float = 30.0) -> DataFrame:
    """Zero the weight of both ends of a step that differs from the mean rate times the interval by more than the limit."""
    w = _ordered(by, order)
    dt = F.lead(at).over(w) - F.col(at)
    live = (F.col(weight) > 0) & (F.lead(weight).over(w) > 0) & (dt > 0) & (dt <= most)
    step = -0.5 * (F.col(rate) + F.lead(rate).over(w)) * interval - (F.lead(value).over(w) - F.col(value))
    out = df.withColumn("__x", F.coalesce(live & (F.abs(step) > limit), F.lit(False)))
    bad = F.col("__x") | F.coalesce(F.lag("__x").over(w), F.lit(False))
    return out.withColumn("rejected", bad).withColumn(f"{weight}_new", F.when(F.col("rejected"), F.lit(0.0)).otherwise(F.col(weight))).drop("__x")


def segments(df: DataFrame, by: list[str], order: list[str], at: str, value: str, threshold: float, gap: float) -> DataFrame:
    """Runs of rows at or over the threshold, cut where rows are missing or the time between two is over the gap."""
    w = _ordered(by, order)
    rows = df.withColumn("__r", F.row_number().over(w) - 1).where(F.col(value) >= threshold)
    new = (F.col("__r") != F.lag("__r").over(w) + 1) | (F.col(at) - F.lag(at).over(w) > gap)
    rows = rows.withColumn("segment", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))
    return rows.groupBy(*by, "segment").agg(
        F.min("__r").alias("start_index"), F.max("__r").alias("end_index"), F.min(at).alias("start_time"), F.max(at).alias("end_time"),
        F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("duration"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def streaks(df: DataFrame, by: list[str], order: list[str], at: str, value: str, limit: float, epoch: str) -> DataFrame:
    """Time since a value last moved by more than the limit, or its satellite was missing from an epoch.

    `epoch` numbers the epochs of a track without gaps; a satellite that skips one starts anew.
    """
    w = _ordered(by, order)
    kept = (F.abs(F.col(value) - F.lag(value).over(w)) <= limit) & (F.col(epoch) == F.lag(epoch).over(w) + 1)
    out = df.withColumn("__new", F.coalesce(~kept, F.lit(True)).cast("int")).withColumn("__g", F.sum("__new").over(w))
    return out.withColumn("streak", F.col(at) - F.min(at).over(Window.partitionBy(*by, "__g"))).drop("__new", "__g")


def past_probabilities(df: DataFrame, by: list[str], order: list[str], value: str, rows: int = 3) -> DataFrame:
    """The last value, the change since and the mean of up to `rows` values before; the first row is its own past."""
    w = _ordered(by, order)
    last = F.lag(value).over(w)
    return df.withColumns({
        f"{value}_prev": F.coalesce(last, F.col(value)), f"{value}_delta_prev": F.coalesce(F.col(value) - last, F.lit(0.0)),
        f"{value}_past_mean": F.coalesce(F.avg(value).over(w.rowsBetween(-rows, -1)), F.col(value))})


def trim_epochs(df: DataFrame, epoch: str, start: int, most: int, following: str | None = None) -> DataFrame:
    """Epochs after `start`, `most` of them; with `following`, rows whose next epoch, if any, is among them too."""
    kept = (F.col(epoch) > start) & (F.col(epoch) <= start + most)
    if following:
        kept = kept & (~(F.col(following) > 0) | (F.col(following) <= start + most))
    return df.where(kept)


def window_starts(count: Column, length: int, step: int) -> Column:
    """Starts every `step`, and one so that the last segment ends at the end; empty for no epochs."""
    step = max(step, 1)
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((count - 1) / step), F.lit(0)).cast("long")), lambda i: i * step)
    last = F.greatest(F.lit(0), count - max(length, 1)).cast("long")
    return F.when(count > 0, F.array_sort(F.array_union(own, F.array(last)))).otherwise(F.array().cast("array<bigint>"))
