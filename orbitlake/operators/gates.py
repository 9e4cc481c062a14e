"""Masks and gates over observations and epochs: boolean columns, thresholds by aggregates, reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite

# fixed values: bits of the receiver's state words, and the range of pseudoranges
CODE_LOCK, TOW_OK, TOD_OK = 1, 8, 128
ADR_VALID, ADR_RESET, ADR_SLIP = 1, 2, 4
PR_LEAST, PR_MOST = 1.0e7, 4.0e7
GLONASS = 3


def adr_usable(state: Column) -> Column:
    """Valid, not reset and without a slip."""
    s = F.coalesce(state.cast("long"), F.lit(0))
    return (s.bitwiseAND(F.lit(ADR_VALID)) != 0) & (s.bitwiseAND(F.lit(ADR_RESET | ADR_SLIP)) == 0)


def observation_masks(cn0: Column, elevation: Column, multipath: Column, pr: Column, state: Column, constellation: Column, rate: Column, adr: Column, adr_state: Column, least_cn0: float, least_elevation: float) -> dict[str, Column]:
    """p_ok, d_ok and l_ok: whether code, rate and carrier of a row can be used. Not finite counts as not measured."""
    common = F.coalesce(multipath, F.lit(0.0)) != 1.0
    if least_cn0 > 0:
        common = common & finite(cn0) & (cn0 >= least_cn0)
    if least_elevation > 0:
        common = common & finite(elevation) & (elevation >= least_elevation)
    s = F.coalesce(state.cast("long"), F.lit(0))
    timed = F.when(constellation == GLONASS, s.bitwiseAND(F.lit(TOD_OK)) != 0).otherwise(s.bitwiseAND(F.lit(TOW_OK)) != 0)
    tracked = (s.bitwiseAND(F.lit(CODE_LOCK)) != 0) & timed
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "p_ok": sure(common & tracked & finite(pr) & (pr >= PR_LEAST) & (pr <= PR_MOST)),
        "d_ok": sure(common & finite(rate)),
        "l_ok": sure(common & finite(adr) & (adr != 0.0) & adr_usable(adr_state)),
    }


def pair_gate(pairs: DataFrame, by: list[str], metric: str, fixed: float | None = None, floor: float | None = None, mad_mult: float | None = None, median_most: float | None = None, scale: float = 1.0, least: int = 3) -> DataFrame:
    """Pairs with kept and epoch_ok: the metric against a fixed or median-based threshold, then the epoch as a whole.

    An epoch falls if fewer than `least` pairs are kept or the median of those is over median_most. Two aggregations by
    epoch for the median and its deviation, one for the verdict.
    """
    threshold = F.lit(float("inf"))
    out = pairs.withColumn("__m", F.abs(metric))
    if mad_mult is not None:
        mid = out.groupBy(*by).agg(F.percentile("__m", F.lit(0.5)).alias("__med"))
        out = out.join(mid, by)
        mad = out.groupBy(*by).agg(F.percentile(F.abs(F.col("__m") - F.col("__med")), F.lit(0.5)).alias("__mad"))
        out = out.join(mad, by)
        threshold = F.col("__med") + mad_mult * F.col("__mad")
        if floor is not None:
            threshold = F.greatest(threshold, F.lit(floor))
    elif floor is not None:
        threshold = F.lit(floor)
    if fixed is not None:
        threshold = F.least(threshold, F.lit(fixed))
    out = out.withColumn("kept", F.col("__m") <= threshold * scale)
    seen = out.groupBy(*by).agg(F.sum(F.col("kept").cast("int")).alias("__n"), F.percentile(F.when(F.col("kept"), F.col("__m")), F.lit(0.5)).alias("__after"))
    fine = F.col("__n") >= least
    if median_most is not None:
        fine = fine & (F.col("__after") <= median_most * scale)
    return out.join(seen, by).withColumn("epoch_ok", F.coalesce(fine, F.lit(False))).drop("__m", "__med", "__mad", "__n", "__after")


def first_failing(checks: list[tuple[Column, str]], fine: str = "ok") -> Column:
    """The name of the first check that does not hold (null counts as not), or `fine`."""
    return reduce(lambda rest, c: F.when(~F.coalesce(c[0], F.lit(False)), F.lit(c[1])).otherwise(rest), reversed(checks), F.lit(fine))


def accept_multi(extra: Column, p95: Column, largest: Column, bias_range: Column, extra_least: int = 2, p95_most: float = 100.0, most: float = 250.0, bias_most: float = 100.0) -> Column:
    """Whether a solution with several systems clears the veto."""
    return F.coalesce((extra >= extra_least) & (p95 <= p95_most) & (largest <= most) & (bias_range <= bias_most), F.lit(False))


def combined_scale(scales: list[Column], most: float | None = None) -> Column:
    """Product of the scales that are not null, not over `most`."""
    product = reduce(lambda a, b: a * b, [F.coalesce(s, F.lit(1.0)) for s in scales], F.lit(1.0))
    return product if most is None else F.least(product, F.lit(most))


def zero_listed(rows: DataFrame, listed: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """Weights set to 0 where a diagnostics table names the row."""
    named = listed.select(*keys).distinct().withColumn("__bad", F.lit(True))
    out = rows.join(named, keys, "left")
    return out.withColumns({w: F.when(F.col("__bad"), F.lit(0.0)).otherwise(F.col(w)) for w in weights}).drop("__bad")


def residual_outliers(rows: DataFrame, epoch: list[str], group: str, residual: str, weight: str, limit: float) -> DataFrame:
    """Zero weights of residuals over the limit after taking off the weighted median clock of their epoch and group."""
    from .aggregates import weighted_median

    clock = weighted_median(rows, [*epoch, group], residual, weight).withColumnRenamed("weighted_median", "__clock")
    out = rows.join(clock, [*epoch, group], "left")
    bad = F.coalesce(F.abs(F.col(residual) - F.col("__clock")) > limit, F.lit(False)) & (F.col(weight) > 0)
    return out.withColumn("rejected", bad).withColumn(weight, F.when(F.col("rejected"), F.lit(0.0)).otherwise(F.col(weight))).drop("__clock")


def hysteresis(df: DataFrame, by: list[str], order: list[str], candidate: Column, enter: int, leave: int) -> DataFrame:
    """`active`: on once `enter` rows in a row are candidates, off once `leave` rows in a row are not.

    A run's length at each row, and the last row at which one of the two was reached, are windows: no state is replayed.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(candidate, F.lit(False))
    rows = df.withColumn("__f", flag).withColumn("__g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "__f").orderBy(*order)))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__f", "__g").orderBy(*order)))
    turn = F.when(F.col("__f") & (F.col("__k") == enter), True).when(~F.col("__f") & (F.col("__k") == leave), False)
    rows = rows.withColumn("__t", turn)
    return rows.withColumn("active", F.coalesce(F.last("__t", True).over(w), F.lit(False))).drop("__f", "__g", "__k", "__t")


def adaptive_weight(residual: Column, sigma: float, base: Column) -> Column:
    """Base weight times the chance of a larger residual under chi square with one degree of freedom, 0.01 at least.

    That chance is erfc(|residual| / sigma / sqrt 2), by a rational approximation that is right to 2e-7.
    """
    x = F.abs(residual) / (sigma * 2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return base * F.least(F.greatest(poly * F.exp(-x * x), F.lit(0.01)), F.lit(1.0))


def veto_modes(x: dict[str, Column], close: dict[str, float], far: dict[str, float]) -> Column:
    """A candidate for blocking: close to the reference with few blocked rays, or far from it with many positive ones."""
    near = (x["blocked"] >= close["low"]) & (x["blocked"] <= close["high"]) & (x["disagreement"] <= close["most"]) & (x["residual"] <= close["residual"])
    away = (x["blocked"] <= far["blocked"]) & (x["positive"] >= far["positive"]) & (x["disagreement"] >= far["least"])
    return F.coalesce(near, F.lit(False)) | F.coalesce(away, F.lit(False))


def carrier_steps(df: DataFrame, by: list[str], order: list[str], at: str, adr: str, usable: Column, rate: str, uncertainty: str, interval: Column, limit: float, sigma: float = 0.02) -> DataFrame:
    """(.., step, weight) of carrier differences to the next row of a satellite; weight 0 where there is none.

    A step that the rates contradict by more than the limit makes both of its ends unusable, and so the steps beside it.
    The weight is one over the variance, from the uncertainties of both ends if they are positive.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("__ok", F.coalesce(usable & finite(F.col(adr)), F.lit(False)))
    step = F.lead(adr).over(w) - F.col(adr)
    both = F.col("__ok") & F.coalesce(F.lead("__ok").over(w), F.lit(False)) & F.coalesce(F.lead(at).over(w) - F.col(at) > 0, F.lit(False))
    off = F.abs(step + 0.5 * (F.col(rate) + F.lead(rate).over(w)) * interval) > limit
    out = out.withColumn("__bad", both & F.coalesce(off & (interval > 0), F.lit(False)))
    out = out.withColumn("__ok", F.col("__ok") & ~F.col("__bad") & ~F.coalesce(F.lag("__bad").over(w), F.lit(False)))
    u0, u1 = F.col(uncertainty), F.lead(uncertainty).over(w)
    s = F.greatest(F.when((u0 > 0) & (u1 > 0), F.sqrt(u0 * u0 + u1 * u1)).otherwise(F.lit(sigma)), F.lit(1e-3))
    live = F.col("__ok") & F.coalesce(F.lead("__ok").over(w), F.lit(False)) & F.coalesce(F.lead(at).over(w) - F.col(at) > 0, F.lit(False))
    return out.withColumns({"step": F.when(live, F.lead(adr).over(w) - F.col(adr)).otherwise(0.0), "weight": F.when(live, 1.0 / (s * s)).otherwise(0.0)}).drop("__ok", "__bad")
