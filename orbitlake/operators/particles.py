"""Particle weights, resampling and posterior statistics as joins and aggregates; a particle is a row."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Particles and observations that meet in one group at most.
BLOCK = 4096
#: Pairs whose arrays are held at once.
_PAIRS = 1 << 14
_PLACE, _SKY = ["x", "y", "z", "clock"], ["sx", "sy", "sz", "pr"]


def residuals(particles: DataFrame, observations: DataFrame, epoch: list[str], how: str = "inner") -> DataFrame:
    """Each particle (id, x, y, z, clock) of an epoch with its observations (sx, sy, sz, pr, w) and the residual `r`.

    An equi join on the epoch; the observations of one are few, particles are dealt by their own rows.
    """
    d = F.sqrt(sum(((F.col(p) - F.col(f"s{p}")) * (F.col(p) - F.col(f"s{p}")) for p in "xyz"), F.lit(0.0)))
    return particles.join(observations, epoch, how).withColumn("range", d).withColumn("r", F.col("pr") - (F.col("range") + F.col("clock")))


def _summed(met: DataFrame, keys: list[str], term: Column) -> DataFrame:
    return met.groupBy(*keys).agg(F.sum(term).alias("log_weight"))


def weight_code(met: DataFrame, keys: list[str], sigma: float, nu: float = 0.0, gate: float = 0.0, huber: float = 0.0) -> DataFrame:
    """Log weights of residual rows: Gaussian, Student (nu > 0) or Huber cost.

    With a gate, residuals over it are left out for a particle that keeps four of them (all, if it has fewer).
    """
    q = F.col("w") * F.col("r") * F.col("r") / (sigma * sigma)
    if nu > 0:
        term = -0.5 * (nu + 1.0) * F.log(1.0 + q / nu)
    elif huber > 0:
        u = F.sqrt(F.col("w")) * F.abs("r") / sigma
        term = -F.when(u <= huber, 0.5 * u * u).otherwise(huber * (u - 0.5 * huber))
    else:
        term = -0.5 * q
    if gate <= 0:
        return _summed(met, keys, term)
    inside = F.abs("r") <= gate
    some = met.groupBy(*keys).agg(F.sum(term).alias("__all"), F.sum(F.when(inside, term).otherwise(0.0)).alias("__in"), F.count(F.when(inside, 1)).alias("__n"), F.count("*").alias("__m"))
    return some.select(*keys, F.when(F.col("__n") >= F.least(F.lit(4), F.col("__m")), F.col("__in")).otherwise(F.col("__all")).alias("log_weight"))


def weight_mixture(met: DataFrame, keys: list[str], sigma: float, share: float, bias: float, sigma_far: float) -> DataFrame:
    """Log weights under a mixture of direct and reflected signals."""
    r, w = F.col("r"), F.col("w")
    a = math.log(share) - math.log(sigma) - 0.5 * w * r * r / (sigma * sigma)
    b = math.log(1 - share) - math.log(sigma_far) - 0.5 * w * (r - bias) * (r - bias) / (sigma_far * sigma_far)
    top = F.greatest(a, b)
    return _summed(met, keys, top + F.log(F.exp(a - top) + F.exp(b - top)))


def weight_phase(met: DataFrame, keys: list[str], phase: str, wavelength: float, sigma: float) -> DataFrame:
    """Log weights of the distance of the carrier to whole cycles, to be added to those at hand."""
    c = F.col(phase) - (F.col("range") + F.col("clock")) / wavelength
    afv = c - F.rint(c)
    return _summed(met, keys, -0.5 * F.col("w") * afv * afv / (sigma * sigma))


def _numbers(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns as rows of doubles (columns, n), and which of the n have no null among them; nulls read NaN."""
    arrays = [table.column(c).combine_chunks() for c in columns]
    known = np.ones(table.num_rows, bool)
    for a in arrays:
        known &= ~a.is_null().to_numpy(zero_copy_only=False)
    return np.array([pc.fill_null(a, math.nan).to_numpy(zero_copy_only=False) for a in arrays]).reshape(len(arrays), -1), known


def paired_sums(particles: DataFrame, observations: DataFrame, epoch: list[str], keys: list[str], term: Callable, gate: float | None = None, extra: list[str] = [], block: int = BLOCK) -> DataFrame:
    """Sums of a term over the observations of each particle's epoch: keys, `all`; with a gate also `in`, the sum of terms
    whose residual is within it, `n`, their number, and `m`, that of all observations. Nulls are as in sums of SQL.

    term takes arrays (particles, observations): r, range plus clock, and rows w and extra; it returns terms, NaN for null
    ones with a second array that tells which are not null, or None. Both sides are dealt into parts of about `block` rows
    an epoch, and each two parts of an epoch meet in one group, so pairs are no rows and an epoch of any size is many tasks.
    """
    keys_type = particles.select(*keys).schema
    double = lambda names: [F.col(c).cast("double").alias(c) for c in names]
    on = [F.col(c).alias(f"__e{i}") for i, c in enumerate(epoch)]
    names = [f"__e{i}" for i in range(len(epoch))]
    own = particles.select(*on, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *double(_PLACE))
    sky = observations.select(*on, *double([*_SKY, "w", *extra]))
    parts = lambda df, name: df.groupBy(*names).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    counts = parts(own, "__pn").join(parts(sky, "__on"), names)
    dealt = lambda df, mine, other: df.join(counts, names).withColumns({mine: F.pmod(F.xxhash64(*df.columns), F.col(f"{mine}n")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1))}).drop("__pn", "__on")
    group = [*names, "__p", "__o"]
    sums = ["all"] if gate is None else ["all", "in", "n", "m"]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        place, placed = _numbers(left, _PLACE)
        at, seen = _numbers(right, _SKY)
        rest, weighed = _numbers(right, ["w", *extra])
        at, rest, weighed = at[:, seen], rest[:, seen], weighed[seen]
        n = left.num_rows
        out = {"all": np.zeros(n), "in": np.zeros(n), "n": np.zeros(n, np.int64), "m": np.full(n, right.num_rows)}
        told = np.zeros(n, bool)
        step = max(1, _PAIRS // max(1, at.shape[1]))
        for s in range(0, n if at.shape[1] else 0, step):
            x, y, z, clock = place[:, s : s + step, None]
            x, y, z = x - at[0], y - at[1], z - at[2]
            for d in (x, y, z):
                d *= d
            x += y
            x += z
            far = np.sqrt(x, out=x)
            far += clock
            r = at[3] - far
            with np.errstate(all="ignore"):
                values, fine = term(r, far, *rest)
            fine = weighed if fine is None else fine & weighed
            if not fine.all():
                values = np.where(fine, values, 0.0)
            out["all"][s : s + step] = values.sum(axis=1)
            told[s : s + step] = fine.any(axis=-1)
            if gate is not None:
                inside = np.abs(r) <= gate
                out["in"][s : s + step] = np.where(inside, values, 0.0).sum(axis=1)
                out["n"][s : s + step] = inside.sum(axis=1)
        out["n"][~placed] = 0
        out["in"][~placed] = 0.0
        columns = [left.column(f"__k{i}") for i in range(len(keys))]
        columns += [pa.array(out[c], mask=~(told & placed) if c == "all" else None) for c in sums]
        return pa.table(columns, names=[*keys, *sums])

    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keys_type], *[f"`{c}` {'long' if c in 'nm' else 'double'}" for c in sums]])
    met = dealt(own, "__p", "__o").groupBy(*group).cogroup(dealt(sky, "__o", "__p").groupBy(*group))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return summed(left, right) if left.num_rows and right.num_rows else summed(left.slice(0, 0), right)

    return met.applyInArrow(both, types).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def cloud_code_weights(particles: DataFrame, observations: DataFrame, epoch: list[str], keys: list[str], sigma: float, nu: float = 0.0, gate: float = 0.0, huber: float = 0.0) -> DataFrame:
    """weight_code of residuals(particles, observations, epoch), for epochs of any size."""

    def term(r, far, w):
        if huber > 0 >= nu:
            u = np.sqrt(w) * np.abs(r) / sigma
            return -np.where(u <= huber, 0.5 * u * u, huber * (u - 0.5 * huber)), None
        q = w * r * r / (sigma * sigma)
        if nu > 0:
            x = 1.0 + q / nu
            return -0.5 * (nu + 1.0) * np.log(x), None if (w >= 0).all() else ~(x <= 0)  # the log of none above 0 is null
        return -0.5 * q, None

    if gate <= 0:
        return paired_sums(particles, observations, epoch, keys, term).select(*keys, F.col("all").alias("log_weight"))
    some = paired_sums(particles, observations, epoch, keys, term, gate)
    return some.select(*keys, F.when(F.col("n") >= F.least(F.lit(4), F.col("m")), F.col("in")).otherwise(F.col("all")).alias("log_weight"))


def cloud_mixture_weights(particles: DataFrame, observations: DataFrame, epoch: list[str], keys: list[str], sigma: float, share: float, bias: float, sigma_far: float) -> DataFrame:
    """weight_mixture of residuals(particles, observations, epoch), for epochs of any size."""

    def term(r, far, w):
        a, b = r * r, r - bias
        b *= b
        a *= -0.5 * w / (sigma * sigma)
        b *= -0.5 * w / (sigma_far * sigma_far)
        a += math.log(share) - math.log(sigma)
        b += math.log(1 - share) - math.log(sigma_far)
        top = np.maximum(a, b)
        a -= b
        np.abs(a, out=a)
        np.negative(a, out=a)
        np.exp(a, out=a)
        np.log1p(a, out=a)
        a += top
        return a, None

    return paired_sums(particles, observations, epoch, keys, term).select(*keys, F.col("all").alias("log_weight"))


def cloud_phase_weights(particles: DataFrame, observations: DataFrame, epoch: list[str], keys: list[str], phase: str, wavelength: float, sigma: float) -> DataFrame:
    """weight_phase of residuals(particles, observations, epoch), for epochs of any size."""

    def term(r, far, w, cycles):
        c = cycles - far / wavelength
        afv = c - np.rint(c)
        return -0.5 * w * afv * afv / (sigma * sigma), None

    return paired_sums(particles, observations, epoch, keys, term, extra=[phase]).select(*keys, F.col("all").alias("log_weight"))


def weight_position(particles: DataFrame, at: list[float], sigma: float) -> DataFrame:
    """log_weight lowered by the distance to a reference position."""
    d2 = sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip("xyz", at)), F.lit(0.0))
    return particles.withColumn("log_weight", F.col("log_weight") - 0.5 * d2 / (sigma * sigma))


def posterior(particles: DataFrame, by: list[str], xyz: list[str]) -> DataFrame:
    """Weighted mean of each axis, spread (weighted RMS distance to it), and effective size, from log weights."""
    top = particles.groupBy(*by).agg(F.max("log_weight").alias("__m"))
    p = particles.join(top, by).withColumn("__w", F.exp(F.col("log_weight") - F.col("__m")))
    sums = p.groupBy(*by).agg(F.sum("__w").alias("__sw"), F.sum(F.col("__w") * F.col("__w")).alias("__sw2"), *[F.sum(F.col("__w") * F.col(c)).alias(f"__s{c}") for c in xyz])
    means = sums.select(*by, "__sw", (F.col("__sw") * F.col("__sw") / F.col("__sw2")).alias("ess"), *[(F.col(f"__s{c}") / F.col("__sw")).alias(f"mean_{c}") for c in xyz])
    d2 = sum(((F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}")) for c in xyz), F.lit(0.0))
    far = p.join(means, by).groupBy(*by).agg((F.sum(F.col("__w") * d2) / F.first("__sw")).alias("__v"))
    return means.join(far, by).withColumn("spread", F.sqrt("__v")).drop("__sw", "__v")


def recentre_clock(particles: DataFrame, shift: DataFrame, by: list[str]) -> DataFrame:
    """Clocks moved by each epoch's shift (column `shift`)."""
    return particles.join(shift, by).withColumn("clock", F.col("clock") + F.col("shift")).drop("shift")


def resample(particles: DataFrame, by: list[str], order: list[str], n: int, u0: float) -> DataFrame:
    """Systematic resampling: each particle as many times as positions (u0 + i) / n, i < n, fall on its part of the weights.

    Column `slot` numbers the copies by position. Two prefix sums in one window; no position list is made.
    """
    top = particles.groupBy(*by).agg(F.max("log_weight").alias("__m"))
    p = particles.join(top, by).withColumn("__w", F.exp(F.col("log_weight") - F.col("__m")))
    w = Window.partitionBy(*by)
    run = F.sum("__w").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__w").over(w)
    p = p.withColumn("__hi", run)
    upto = lambda c: F.least(F.greatest(F.ceil(c * n - u0), F.lit(0)), F.lit(n)).cast("long")
    low = F.coalesce(F.lag("__hi").over(w.orderBy(*order)), F.lit(0.0))
    last = F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) == 1
    p = p.withColumns({"__a": upto(low), "__b": F.when(last, F.lit(n).cast("long")).otherwise(upto(F.col("__hi")))})
    out = p.where("__b > __a").withColumn("slot", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)))
    return out.drop("__m", "__w", "__hi", "__a", "__b")
