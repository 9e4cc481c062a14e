"""Features, labels and folds of the fix-rate product, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite

#: Weight, floor of the baseline for each metric of a chunk.
QUALITY = {"mse": (0.40, 10.0), "step_mean": (0.10, 0.25), "step_p95": (0.10, 0.5), "accel_p95": (0.10, 0.5)}


def chunk_quality(prefix: str = "b_", metrics: dict[str, tuple[float, float]] = QUALITY) -> Column:
    """Sum of weighted ratios of a chunk's metrics to the baseline's; missing baselines make 1."""
    parts = [w * F.col(m) / F.greatest(F.col(f"{prefix}{m}"), F.lit(floor)) for m, (w, floor) in metrics.items()]
    return F.coalesce(sum(parts, F.lit(0.0)), F.lit(1.0))


def diagnostic_rate(base: Column, reject: Column, lift: Column, hold: Column, strict: Column, carry: Column) -> tuple[Column, Column]:
    """Rate and reason: cut to 5 where validation rejects, lifted by the hold scores where it holds, else the base rate."""
    lifted = F.greatest(base, F.least(F.lit(95.0), 20.0 + 70.0 * hold + 20.0 * strict + 2.0 * F.least(carry, F.lit(5.0))))
    return F.when(reject, F.least(base, F.lit(5.0))).when(lift, lifted).otherwise(base), F.when(reject, "high_pred_reject").when(lift, "low_pred_hold_lift").otherwise("base")


def compounds(strict: Column, ready_pass: Column, reject: Column, spike: Column, carry: Column, jumps: Column) -> dict[str, Column]:
    """Products of readiness, validation and risk; inputs that are not finite count 0."""
    z = lambda c: F.when(finite(c.cast("double")), c).otherwise(F.lit(0.0))
    s, p, r = z(strict), z(ready_pass), z(reject)
    clipped = F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))
    return {"readiness_net": s * p * (1.0 - clipped), "readiness_carry": s * z(carry), "validation_clean": p - r - z(spike), "jump_risk": z(jumps) * (1.0 - s)}


def targets(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Binary labels from predicates; unknown is 0."""
    return df.withColumns({n: F.coalesce(p, F.lit(False)).cast("int") for n, p in predicates.items()})


def curate(df: DataFrame, keys: list[str], allowed: list[str], neutral: float = 0.0) -> DataFrame:
    """The keys and the allowed features, missing ones and values that are not finite as the neutral value."""
    own = lambda c: F.when(finite(F.col(c).cast("double")), F.col(c)).otherwise(F.lit(neutral)) if c in df.columns else F.lit(neutral)
    return df.select(*keys, *[own(c).alias(c) for c in allowed])


def out_of_fold_rate(df: DataFrame, run: str, label: str) -> DataFrame:
    """`prior`: the mean label of all other runs; null with a single run."""
    per = df.groupBy(run).agg(F.sum(label).alias("__s"), F.count(label).alias("__n"))
    total = per.agg(F.sum("__s").alias("S"), F.sum("__n").alias("N"))
    rate = per.crossJoin(total).select(run, F.when(F.col("N") > F.col("__n"), (F.col("S") - F.col("__s")) / (F.col("N") - F.col("__n"))).alias("prior"))  # one row
    return df.join(rate, run)


def window_statistics(df: DataFrame, by: list[str], at: str, order: list[str], columns: list[str], width: int) -> DataFrame:
    """(by, window_index, n) and, for each column, statistics of its values, of their steps, and counts of signs.

    Windows tumble from the first time of each track; steps stay within a window.
    """
    first = df.groupBy(*by).agg(F.min(at).alias("__lo"))
    rows = df.join(first, by).withColumn("window_index", F.floor((F.col(at) - F.col("__lo")) / width).cast("long"))
    w = Window.partitionBy(*by, "window_index").orderBy(at, *order)
    rows = rows.withColumns({f"__d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    rows = rows.withColumns({f"__c_{c}": F.signum(f"__d_{c}") != F.lag(F.signum(f"__d_{c}")).over(w) for c in columns})
    aggs = [F.count("*").alias("n")]
    n = lambda x: F.count(F.when(x, 1))
    for c in columns:
        d = f"__d_{c}"
        pct = lambda v, q: F.percentile(v, F.lit(q))
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), *[pct(c, q / 100).alias(f"{c}_p{q}") for q in (10, 25, 50, 75, 90, 95)]]
        aggs += [F.coalesce(F.avg(d), F.lit(0.0)).alias(f"{c}_delta_mean"), F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias(f"{c}_delta_std"), F.min(d).alias(f"{c}_delta_min"), F.max(d).alias(f"{c}_delta_max")]
        aggs += [n(F.col(d) < 0).alias(f"{c}_delta_neg_count"), n(F.col(d) > 0).alias(f"{c}_delta_pos_count"), n(F.col(f"__c_{c}")).alias(f"{c}_delta_sign_change_count")]
    return rows.groupBy(*by, "window_index").agg(*aggs)
