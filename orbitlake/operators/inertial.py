"""Inertial samples summed between epochs: ordered products of (time, velocity, position) steps, by slices of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACC, _GYRO = ["ax", "ay", "az"], ["gx", "gy", "gz"]
_BIAS = ["abx", "aby", "abz", "gbx", "gby", "gbz"]


def preintegrate(samples: DataFrame, epochs: DataFrame, width: float = 1000.0) -> DataFrame:
    """(track, t0, t1, samples, dt, dvx.., dpx.., dax.., and means of the biases) for each two epochs in a row of a track.

    samples: track, t (milliseconds), ax to az, gx to gz, and abx to gbz, biases, where there are such columns; epochs:
    track, t. A sample counts for the intervals that hold its time, ends included, for half the time between its
    neighbours there (the ends at the border; the whole interval if it is alone). In time order its step adds velocity, and
    position by the velocity so far; rotation is the sum of rates. Steps compose as (T, v, p) then (T', v', p') =
    (T + T', v + v', p + p' + v T'), an associative product that depends on order: each slice of `width` milliseconds
    makes its own, and an interval's slices are joined by the time left after each. So an interval is as many tasks as it
    has slices, and slices or partitions don't change the result but by rounding.

    Samples with a value that is null or not finite give no step, but are neighbours; those with a null or NaN time or
    track are left out, so are such epochs; repeated epochs are one. Samples of one time are taken as ordered by their
    values. An interval without steps has zeros, and null means. Means weigh finite biases by time.
    """
    have = [c for c in _BIAS if c in samples.columns]
    at = F.col("t").cast("double")
    times = epochs.select("track", at.alias("t0")).where("track is not null and t0 is not null and not isnan(t0)").distinct()
    spans = times.withColumn("t1", F.lead("t0").over(Window.partitionBy("track").orderBy("t0"))).where("t1 is not null")
    own = samples.select("track", at.alias("t"), *[F.col(c).cast("double").alias(c) for c in [*_ACC, *_GYRO, *have]]).where("track is not null and t is not null and not isnan(t)")
    cell = lambda c: F.floor(F.col(c) / width)
    cells = spans.withColumn("cell", F.explode(F.sequence(cell("t0"), cell("t1"))))
    # an interval becomes many cells, far more than its table tells: merged, never broadcast
    met = own.withColumn("cell", cell("t")).join(cells.hint("merge"), ["track", "cell"]).where("t >= t0 and t <= t1")

    # neighbours: within a slice by its order, across slices by their ends
    slices = met.groupBy("track", "t0", "t1", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("held"))
    over = Window.partitionBy("track", "t0").orderBy("cell")
    slices = slices.withColumns({"before": F.coalesce(F.lag("last").over(over), F.col("t0")), "after": F.coalesce(F.lead("first").over(over), F.col("t1")), "all": F.sum("held").over(Window.partitionBy("track", "t0"))})
    run = Window.partitionBy("track", "t0", "cell").orderBy("t", *_ACC, *_GYRO)
    met = met.join(slices.select("track", "t0", "cell", "before", "after", "all"), ["track", "t0", "cell"])
    met = met.withColumns({"p": F.coalesce(F.lag("t").over(run), F.col("before")), "n": F.coalesce(F.lead("t").over(run), F.col("after"))})
    met = met.withColumn("dt", F.when(F.col("all") == 1, F.col("t1") - F.col("t0")).otherwise((F.col("n") - F.col("p")) / 2) * 1e-3)

    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    steps = met
    for c in [*_ACC, *_GYRO]:
        steps = steps.where(fine(c))
    left = F.coalesce(F.sum("dt").over(run.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    steps = steps.withColumn("left", left)
    dt = F.col("dt")

    def mean_parts(names: list[str], key: str) -> list:
        whole = dt > 0
        for c in names:
            whole = whole & fine(c)
        return [F.sum(F.when(whole, dt)).alias(f"w{key}"), *[F.sum(F.when(whole, dt * F.col(c))).alias(f"s{c}") for c in names]]

    kinds = {k: [c for c in have if c.startswith(k)] for k in ("ab", "gb")}
    parts = steps.groupBy("track", "t0", "cell").agg(
        F.count("*").alias("samples"),
        F.sum("dt").alias("dt"),
        *[F.sum(F.col(c) * dt).alias(f"v{c}") for c in _ACC],
        *[F.sum(F.col(c) * dt * F.col("left") + 0.5 * F.col(c) * dt * dt).alias(f"p{c}") for c in _ACC],
        *[F.sum(F.col(c) * dt).alias(f"r{c}") for c in _GYRO],
        *[x for k, names in kinds.items() if names for x in mean_parts(names, k)],
    )
    rest = F.coalesce(F.sum("dt").over(Window.partitionBy("track", "t0").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    parts = parts.withColumn("rest", rest)
    whole = parts.groupBy("track", "t0").agg(
        F.sum("samples").alias("samples"),
        F.sum("dt").alias("dt"),
        *[F.sum(f"v{c}").alias(f"dv{c[1]}") for c in _ACC],
        *[F.sum(F.col(f"p{c}") + F.col(f"v{c}") * F.col("rest")).alias(f"dp{c[1]}") for c in _ACC],
        *[F.sum(f"r{c}").alias(f"da{c[1]}") for c in _GYRO],
        *[(F.sum(f"s{c}") / F.nullif(F.sum(f"w{k}"), F.lit(0.0))).alias(f"{c}_mean") for k, names in kinds.items() for c in names],
    )
    zero = ["dt", *[f"d{k}{c}" for k in "vpa" for c in "xyz"]]
    out = spans.join(whole, ["track", "t0"], "left")
    return out.select("track", "t0", "t1", F.coalesce("samples", F.lit(0)).alias("samples"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero], *[f"{c}_mean" for c in have])


def deltas_for(intervals: DataFrame) -> DataFrame:
    """Intervals that can constrain a solver: with samples and time, and finite velocity and position steps."""
    out = intervals.where((F.col("samples") > 0) & (F.col("dt") > 0))
    for c in [f"d{k}{c}" for k in "vp" for c in "xyz"]:
        out = out.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return out
