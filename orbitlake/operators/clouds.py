"""A particle filter over epochs whose clouds are many tasks: keyed draws, prefix sums by blocks, ancestors and smoothed paths."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, stored
from . import particles

#: Particles of a block: what one window group, or one exploded row, holds at most.
BLOCK = 4096
STATE = ["x", "y", "z", "clock"]


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number over 0 and under 1 by the hash of a seed and keys; the same keys always draw the same one."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *keys), 11).cast("double") + 0.5) * 2.0**-53


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by the hash of a seed and keys, from two uniform ones."""
    return F.sqrt(-2.0 * F.log(uniform(seed, F.lit("radius"), *keys))) * F.cos(2 * math.pi * uniform(seed, F.lit("angle"), *keys))


def gumbel(seed: int, *keys: Column | str) -> Column:
    """A standard Gumbel number: the largest of log weights plus such numbers is a draw by the weights."""
    return -F.log(-F.log(uniform(seed, *keys)))


def _spread_ids(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Each row n times with an id from 0; blocks of ids are dealt over tasks before they are made."""
    blocks = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK)))).repartition(F.xxhash64(*by, "__b"))
    ids = F.sequence(F.col("__b").cast("long") * BLOCK, F.least((F.col("__b").cast("long") + 1) * BLOCK, F.lit(n).cast("long")) - 1)
    return blocks.withColumn("id", F.explode(ids)).drop("__b")


def start_cloud(starts: DataFrame, n: int, spread: float, spread_clock: float, seed: int) -> DataFrame:
    """(track, id, x, y, z, clock, log_weight): n particles about each track's start (track, x, y, z, clock)."""
    wide = _spread_ids(starts.where("track is not null").select("track", *STATE), n, "track")
    at = lambda c: F.col(c) + normal(seed, F.lit(f"start {c}"), "track", "id") * (spread_clock if c == "clock" else spread)
    return wide.select("track", "id", *[at(c).alias(c) for c in STATE], F.lit(0.0).alias("log_weight"))


def predict(cloud: DataFrame, moves: DataFrame, sigma: float, sigma_clock: float, seed: int) -> DataFrame:
    """Particles moved by their track's velocity (track, epoch, dt, vx, vy, vz) with noise of each axis and of the clock.

    The epoch is a column, so that Spark compiles one plan for all epochs.
    """
    met = cloud.join(moves, "track")
    draw = lambda c: normal(seed, F.lit(f"move {c}"), "epoch", "track", "id")
    at = lambda c: F.col(c) + F.col(f"v{c}") * F.col("dt") + draw(c) * sigma
    return met.select("epoch", *[c for c in cloud.columns if c not in STATE], *[at(c).alias(c) for c in "xyz"], (F.col("clock") + draw("clock") * sigma_clock).alias("clock"))


def running_totals(df: DataFrame, by: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """All columns, low and high: the sum of a value before and up to each row by id, and whole, the sum of the group.

    Ids go to blocks of numbers; a window runs within each block, and another over the few sums of a group's blocks.
    A high of one row is the low of the next, bit for bit.
    """
    at = df.withColumn("__block", F.floor(F.col("id") / block))
    run = Window.partitionBy(*by, "__block").orderBy("id")
    inner = at.withColumn("__high", F.sum(value).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    inner = inner.withColumn("__low", F.coalesce(F.lag("__high").over(run), F.lit(0.0)))
    sums = inner.groupBy(*by, "__block").agg(F.max("__high").alias("__sum"))
    over = Window.partitionBy(*by).orderBy("__block")
    before = F.coalesce(F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("__before", before).withColumn("whole", F.max(F.col("__before") + F.col("__sum")).over(Window.partitionBy(*by)))
    out = inner.join(sums.drop("__sum"), [*by, "__block"])
    return out.withColumns({"low": F.col("__before") + F.col("__low"), "high": F.col("__before") + F.col("__high")}).drop("__block", "__low", "__high", "__before")


def resample(cloud: DataFrame, n: int, u0: Column, carry: list[str], block: int = BLOCK) -> DataFrame:
    """(track, id, source, carried columns): n slots of each track, slot j with the particle that (u0 + j) / n falls on.

    A particle's slots are an interval from its running totals; intervals are cut at blocks of slots, which are dealt
    over tasks, so that a particle with all the weight is not copied in one. The source is the particle's id.
    """
    top = cloud.groupBy("track").agg(F.max("log_weight").alias("__top"))
    weighed = cloud.join(top, "track").withColumn("__w", F.exp(F.col("log_weight") - F.col("__top"))).drop("__top")
    run = running_totals(weighed, ["track"], "__w", block)
    slot = lambda v: F.least(F.greatest(F.ceil(v / F.col("whole") * n - u0), F.lit(0)), F.lit(n)).cast("long")
    held = run.select(*[c for c in ("epoch",) if c in cloud.columns], "track", F.col("id").alias("source"), *carry, slot(F.col("low")).alias("__a"), F.when(F.col("high") >= F.col("whole"), F.lit(n).cast("long")).otherwise(slot(F.col("high"))).alias("__b")).where("__b > __a")
    parts = held.withColumn("__part", F.explode(F.sequence(F.floor(F.col("__a") / block), F.floor((F.col("__b") - 1) / block)))).repartition(F.xxhash64("track", "__part"))
    first, last = F.greatest("__a", F.col("__part") * block), F.least("__b", (F.col("__part") + 1) * block) - 1
    return parts.withColumn("id", F.explode(F.sequence(first, last))).select("track", "id", "source", *carry)


def run_filter(
    starts: DataFrame,
    moves: DataFrame,
    observations: DataFrame,
    n: int,
    weigh: Callable[[DataFrame, list[str]], DataFrame],
    spread: float = 50.0,
    spread_clock: float = 100.0,
    sigma: float = 1.0,
    sigma_clock: float = 10.0,
    threshold: float = 0.5,
    seed: int = 42,
) -> list[DataFrame]:
    """Clouds by epoch, each (track, epoch, id, source, x, y, z, clock, log_weight), in the shared folder.

    moves (track, epoch from 0, dt, vx, vy, vz) tells a track's epochs; observations (track, epoch, sx, sy, sz, pr, w) are
    joined with its particles, and weigh(rows with r, keys) gives their log weights, as those of operators.particles.
    A track whose effective size falls under threshold * n is resampled before the next epoch, others keep their
    weights; source is the particle of the epoch before, null at the first one. Draws are hashes of (seed, step, track,
    id), so a lost task draws the same again. All tracks go through an epoch together: a round of Spark jobs an epoch,
    in which the particles of one track are many tasks. Epochs without observations only move the cloud.
    """
    last = moves.agg(F.max("epoch")).first()[0]
    if last is None:
        return []
    cloud = start_cloud(starts, n, spread, spread_clock, seed).withColumn("source", F.lit(None).cast("long"))
    out = []
    for k in range(int(last) + 1):
        here = moves.where(F.col("epoch") == k).select("track", F.col("epoch").cast("int").alias("epoch"), "dt", "vx", "vy", "vz")
        moved = predict(cloud, here, sigma, sigma_clock, seed)
        seen = observations.where(F.col("epoch") == k).drop("epoch")
        # a particle's own columns are the keys of its weight, so that the cloud is made once and not joined with itself
        keys = ["track", "epoch", "id", "source", *STATE, "prior"]
        gained = weigh(particles.residuals(moved.withColumnRenamed("log_weight", "prior"), seen, ["track"], "left"), keys)
        weighed = gained.withColumn("log_weight", F.col("prior") + F.coalesce("log_weight", F.lit(0.0)))
        now = stored(weighed.select("track", "epoch", "id", "source", *STATE, "log_weight"))
        out.append(now)
        if k < last:
            sizes = particles_size(now)
            few = F.col("ess") < threshold * n
            u0 = uniform(seed, F.lit("resample"), "epoch", "track")
            chosen = resample(now.join(sizes.where(few).select("track"), "track", "left_semi"), n, u0, STATE).withColumn("log_weight", F.lit(0.0))
            kept = now.join(sizes.where(few).select("track"), "track", "left_anti").select("track", "id", F.col("id").alias("source"), *STATE, "log_weight")
            cloud = chosen.unionByName(kept)
    return out


def particles_size(cloud: DataFrame) -> DataFrame:
    """(track, ess): effective number of particles."""
    top = cloud.groupBy("track").agg(F.max("log_weight").alias("__top"))
    w = F.exp(F.col("log_weight") - F.col("__top"))
    return cloud.join(top, "track").groupBy("track").agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def final_draws(last: DataFrame, paths: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(track, path, id): for each path a particle of the last cloud, by its weight; by chance alone where no weight is finite."""
    wide = last.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(paths - 1).cast("long"))))
    return _largest(wide, F.col("log_weight"), gumbel(seed, F.lit("final"), "track", "path", "id"))


def _largest(df: DataFrame, log_weight: Column, noise: Column) -> DataFrame:
    told = F.when(~F.isnan(log_weight) & (F.abs(log_weight) < float("inf")), log_weight + noise)
    both = df.select("track", "path", "id", told.alias("__s"), noise.alias("__g")).groupBy("track", "path")
    picked = both.agg(F.max(F.when(F.col("__s").isNotNull(), F.struct("__s", "id"))).alias("__by"), F.max(F.struct("__g", "id")).alias("__any"))
    return picked.select("track", "path", F.coalesce("__by.id", "__any.id").alias("id"))


def trace_lineages(clouds: list[DataFrame], draws: DataFrame) -> DataFrame:
    """(track, path, epoch, id): each drawn particle of the last epoch with its sources in all epochs before.

    Steps back are composed to jumps of 2, 4, 8 ... epochs, half as many rows each time; then paths are filled in from the
    longest jump to the shortest. So the joins grow with the logarithm of the epochs, and no cloud leaves Spark's tasks.
    """
    end = len(clouds) - 1
    steps = None
    for k in range(1, len(clouds)):
        one = clouds[k].select("track", F.lit(end - k).alias("back"), "id", F.col("source").alias("to"))
        steps = one if steps is None else steps.unionByName(one)
    known = draws.select("track", "path", F.lit(0).alias("back"), "id")
    jumps = []
    if steps is not None:
        now = steps
        width = 1
        while width <= end:
            jumps.append((width, now))
            # from `back` by width, and on by width again
            first = now.where(F.col("back") % (2 * width) == 0)
            then = now.select("track", (F.col("back") - width).alias("back"), F.col("id").alias("to"), F.col("to").alias("further"))
            if 2 * width <= end:
                now = stored(first.join(then, ["track", "back", "to"]).select("track", "back", "id", F.col("further").alias("to")))
            width *= 2
    for width, jump in reversed(jumps):
        more = known.join(jump.where(F.col("back") % (2 * width) == 0), ["track", "back", "id"]).select("track", "path", (F.col("back") + width).alias("back"), F.col("to").alias("id"))
        known = stored(known.unionByName(more))
    return known.select("track", "path", (F.lit(end) - F.col("back")).alias("epoch"), "id")


def backward_paths(clouds: list[DataFrame], moves: DataFrame, paths: int, sigma: float, sigma_clock: float, seed: int, block: int = BLOCK) -> DataFrame:
    """(track, path, epoch, id): paths drawn backwards, each step by filter weight times the density of the move to the next state.

    A path draws its particle of an epoch as the largest of log weights plus keyed Gumbel numbers, which is an aggregate
    with partial sums: particles and paths meet by block of ids, and no cloud is gathered. One round of jobs an epoch.
    Where no weight is finite, the draw is by chance alone. sigma and sigma_clock are those of the filter's moves.
    """
    drawn = stored(final_draws(clouds[-1], paths, seed, block).withColumn("epoch", F.lit(len(clouds) - 1)))
    out = [drawn]
    for k in range(len(clouds) - 2, -1, -1):
        step = moves.where(F.col("epoch") == k + 1).select("track", "dt", "vx", "vy", "vz")
        ahead = clouds[k + 1].select("track", "id", *[F.col(c).alias(f"n{c}") for c in STATE])
        told = drawn.select("track", "path", "id").join(ahead, ["track", "id"]).drop("id").join(step, "track")
        cloud = clouds[k].withColumn("__block", F.floor(F.col("id") / block))
        blocks = cloud.select("track", "__block").distinct()
        met = cloud.select("track", "epoch", "__block", "id", *STATE, "log_weight").join(told.join(blocks, "track"), ["track", "__block"])
        off = lambda c: F.col(f"n{c}") - (F.col(c) + F.col(f"v{c}") * F.col("dt"))
        move = sum((off(c) * off(c) for c in "xyz"), F.lit(0.0))
        clock = F.col("nclock") - F.col("clock")
        density = -0.5 * move / sigma**2 - 0.5 * clock * clock / sigma_clock**2
        drawn = stored(_largest(met, F.col("log_weight") + density, gumbel(seed, F.lit("back"), "epoch", "track", "path", "id")).withColumn("epoch", F.lit(k)))
        out.append(drawn)
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole.select("track", "path", "epoch", "id")


def path_states(clouds: list[DataFrame], ids: DataFrame) -> DataFrame:
    """(track, path, epoch, x, y, z, clock) of paths told by ids."""
    whole = clouds[0]
    for one in clouds[1:]:
        whole = whole.unionByName(one)
    return ids.join(whole.select("track", "epoch", "id", *STATE), ["track", "epoch", "id"]).select("track", "path", "epoch", *STATE)


def smooth_both_ways(forward: list[DataFrame], backward: list[DataFrame]) -> DataFrame:
    """(track, epoch, x, y, z): means of the estimates of a filter and of one run over the epochs in reverse."""
    end = len(forward) - 1
    parts = []
    for k, (a, b) in enumerate(zip(forward, reversed(backward))):
        for cloud in (a, b):
            parts.append(particles.posterior(cloud.withColumn("epoch", F.lit(k)), ["track", "epoch"], ["x", "y", "z"]).select("track", "epoch", *[F.col(f"mean_{c}").alias(c) for c in "xyz"]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("track", "epoch").agg(*[F.avg(c).alias(c) for c in "xyz"]).where(F.col("epoch") <= end)


def reversed_moves(moves: DataFrame) -> DataFrame:
    """Moves of the epochs in reverse: velocities change their sign, and each track's last epoch is its first."""
    ends = moves.groupBy("track").agg(F.max("epoch").alias("__end"))
    return moves.join(ends, "track").select("track", (F.col("__end") - F.col("epoch")).alias("epoch"), "dt", *[(-F.col(f"v{c}")).alias(f"v{c}") for c in "xyz"])


def forget(clouds: list[DataFrame]) -> None:
    """Delete the clouds of a filter that nothing reads any more."""
    drop(*clouds)
