"""Exclusion of a faulty satellite: solutions without each one, from rank-one changes of an epoch's normal sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estimators import chi_square_limit, normal_sums

_UPPER = [(i, j) for i in range(4) for j in range(i, 4)]


def _inverses(sums: DataFrame) -> DataFrame:
    """The rows with `q`, the inverse of the normal matrix row by row, and `d`, the solution; null where it is as good as singular."""

    @F.pandas_udf("struct<q: array<double>, d: array<double>>")
    def invert(p: pd.DataFrame) -> pd.DataFrame:
        m = np.empty((len(p), 4, 4))
        for i, j in _UPPER:
            m[:, i, j] = m[:, j, i] = p[f"a{i}{j}"]
        v = np.stack([p[f"b{i}"].to_numpy(float) for i in range(4)], axis=1)
        scale = np.sqrt(np.abs(np.diagonal(m, axis1=1, axis2=2)))
        unit = m / np.maximum(scale[:, :, None] * scale[:, None, :], 1e-300)
        fine = np.isfinite(unit).all(axis=(1, 2))
        fine[fine] &= np.abs(np.linalg.det(unit[fine])) > 1e-12
        q = np.linalg.inv(m[fine])
        inverse, step = np.full(len(p), None, object), np.full(len(p), None, object)
        for i, a, x in zip(np.flatnonzero(fine), q.reshape(-1, 16), np.einsum("eij,ej->ei", q, v[fine])):
            inverse[i], step[i] = a, x
        return pd.DataFrame({"q": inverse, "d": step})

    invert = invert.asNondeterministic()  # else a filter on q makes every inverse twice
    used = [*[f"a{i}{j}" for i, j in _UPPER], *[f"b{i}" for i in range(4)]]
    return sums.withColumn("__s", invert(F.struct(*used))).select(*[c for c in sums.columns if c not in used], "__s.*")


def _levels(q: list[list[Column]], receiver: list[Column] | None, p_fa: float) -> tuple[Column, Column]:
    """Horizontal and vertical protection levels of a covariance, along the local axes at the receiver."""
    t = (-2.0 * np.log(p_fa)) ** 0.5
    k = float(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    if receiver is None:
        east, north, up = ([F.lit(float(i == j)) for j in range(3)] for i in range(3))
    else:
        x, y, z = receiver
        lat, lon = F.asin(z / F.sqrt(x * x + y * y + z * z)), F.atan2(y, x)
        east = [-F.sin(lon), F.cos(lon), F.lit(0.0)]
        north = [-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)]
        up = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    along = lambda a: F.abs(sum((a[i] * q[i][j] * a[j] for i in range(3) for j in range(3)), F.lit(0.0)))
    return k * F.sqrt(along(east) + along(north)), k * F.sqrt(along(up))


def exclude_fault(rows: DataFrame, by: list[str], satellite: str, design: list[str], residual: str, weight: str, p_fa: float = 1e-3, receiver: list[str] | None = None) -> DataFrame:
    """(by, n, ok, excluded, statistic, threshold, dx, dy, dz, dclock, hpl, vpl): the chi-square test of each epoch, and where it
    fails, the test without the satellite whose absence leaves the least sum of squares.

    design names the four columns of d range / d (x, y, z, clock) at a position, residual the observed less predicted ranges
    there, dx to dclock the step to the solution of what is kept. One aggregate makes the sums of an epoch; a satellite's
    own share (its leverage and residual) then tells sum, step and covariance without it, so no subset is solved. An
    epoch of under five satellites can't be tested: ok if it has four, and no levels (1e9). Under six none is excluded. A
    failing epoch keeps ok false and names the best exclusion. Equal sums exclude the lowest satellite. A satellite without
    which the others don't tell a position is never excluded. Rows with a null or a weight of 0 or less are left out, so is an
    epoch whose satellites don't tell a position. receiver columns set the local axes; without them the design's are.
    """
    whole = rows.where(F.col(weight) > 0)
    for c in [*design, residual]:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c))
    h, r, w = [F.col(c) for c in design], F.col(residual), F.col(weight)
    extra = [F.first(c).alias(f"__{c}") for c in receiver or []]
    sums = whole.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w * r * r).alias("__ss"), *normal_sums(h, r, w), *extra)
    told = _inverses(sums).where("q is not null")
    met = whole.select(*by, satellite, *design, residual, weight).join(told, by)
    q = [[F.get("q", F.lit(4 * i + j)) for j in range(4)] for i in range(4)]
    d = [F.get("d", F.lit(i)) for i in range(4)]
    g = F.array(*[sum((q[i][j] * h[j] for j in range(4)), F.lit(0.0)) for i in range(4)])
    met = met.withColumn("__g", g).withColumn("__e", r - sum((h[i] * d[i] for i in range(4)), F.lit(0.0)))
    lever = w * sum((h[i] * F.get("__g", F.lit(i)) for i in range(4)), F.lit(0.0))
    met = met.withColumn("__free", 1 - lever).withColumn("__loss", F.when(F.col("__free") > 1e-9, w * F.col("__e") * F.col("__e") / F.col("__free")))
    # the sum of squares of the whole epoch, from residuals of the solution
    keep = F.struct(F.col("__loss"), F.col(satellite).alias("sat"), w.alias("w"), F.col("__e").alias("e"), F.col("__free").alias("free"), F.col("__g").alias("g"))
    # the largest loss, and of equal ones the lowest satellite
    best = F.min_by(F.when(F.col("__loss").isNotNull(), keep), F.when(F.col("__loss").isNotNull(), F.struct(-F.col("__loss"), F.col(satellite))))
    out = met.groupBy(*by).agg(F.first("n").alias("n"), F.sum(w * F.col("__e") * F.col("__e")).alias("__sse"), best.alias("b"), F.first("q").alias("q"), F.first("d").alias("d"), *[F.first(f"__{c}").alias(f"__{c}") for c in receiver or []])
    n = F.col("n")
    limit, limit_less = chi_square_limit(n - 4, p_fa), chi_square_limit(n - 5, p_fa)
    out = out.withColumn("__ok", F.when(n > 4, F.col("__sse") <= limit).otherwise(n >= 4)).withColumn("__cut", ~F.col("__ok") & (n >= 6) & F.col("b").isNotNull())
    cut, b = F.col("__cut"), lambda c: F.col(f"b.{c}")
    less = F.greatest(F.col("__sse") - b("__loss"), F.lit(0.0))
    good = F.when(cut, less <= limit_less).otherwise(F.col("__ok"))
    changed = cut & good  # an exclusion that does not pass changes neither solution nor levels
    gi = [F.get(b("g"), F.lit(i)) for i in range(4)]
    step = [F.when(changed, d[i] - gi[i] * b("w") * b("e") / b("free")).otherwise(d[i]) for i in range(4)]
    spread = [[F.when(changed, q[i][j] + b("w") * gi[i] * gi[j] / b("free")).otherwise(q[i][j]) for j in range(4)] for i in range(4)]
    hpl, vpl = _levels(spread, [F.col(f"__{c}") for c in receiver] if receiver else None, p_fa)
    return out.select(
        *by, "n", good.alias("ok"), F.when(cut, b("sat")).alias("excluded"),
        F.when(cut, less).when(n > 4, F.col("__sse")).otherwise(0.0).alias("statistic"), F.when(cut, limit_less).otherwise(limit).alias("threshold"),
        *[s.alias(c) for s, c in zip(step, ("dx", "dy", "dz", "dclock"))], F.when(n > 4, hpl).otherwise(1e9).alias("hpl"), F.when(n > 4, vpl).otherwise(1e9).alias("vpl"),
    )
