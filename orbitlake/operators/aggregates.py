"""Error metrics, robust statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite
from .windows import ranked


def error_metrics(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """n, RMS, mean, population deviation, P50, P67, P95 (straight-line percentiles) and maximum of finite errors."""
    fine = df.where(F.col(error).isNotNull() & ~F.isnan(error) & (F.abs(error) < float("inf")))
    pct = lambda q: F.percentile(error, F.lit(q))
    return fine.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rms"), F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"),
        pct(0.5).alias("p50"), pct(0.67).alias("p67"), pct(0.95).alias("p95"), F.max(error).alias("max"),
    )


def rank_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Straight-line percentiles of the values that are not null, under the names given, for groups of any size.

    Each lies between two ranks of its group, and only those rows are aggregated: no group is one task.
    """
    rows = ranked(df.select(*by, F.col(value).alias("__v")).where("__v is not null"), by, ["__v"])
    at = {n: F.lit(q) * (F.col("rank_of") - 1) for n, q in shares.items()}
    near = F.lit(False)
    for x in at.values():
        near = near | (F.col("rank") == F.floor(x)) | (F.col("rank") == F.ceil(x))
    aggs = []
    for n, x in at.items():
        low, high = F.max(F.when(F.col("rank") == F.floor(x), F.col("__v"))), F.max(F.when(F.col("rank") == F.ceil(x), F.col("__v")))
        aggs.append((low + (high - low) * F.max(x - F.floor(x))).alias(n))
    return rows.where(near).groupBy(*by).agg(*aggs)


def with_overall(df: DataFrame, by: str, aggs: list[Column], name: str = "OVERALL") -> DataFrame:
    """Aggregates for each value of `by` and for all rows."""
    return df.rollup(by).agg(*aggs, F.grouping(by).alias("__all")).withColumn(by, F.when(F.col("__all") == 1, name).otherwise(F.col(by).cast("string"))).drop("__all")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value whose cumulative weight reaches half; rows without a positive finite weight and a finite value count for nothing."""
    fine = df.where((F.col(weight) > 0) & finite(F.col(weight).cast("double")) & finite(F.col(value).cast("double"))).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*by)
    run = fine.withColumns({"__c": F.sum("__w").over(w.orderBy(value)), "__t": F.sum("__w").over(w)})
    return run.where(F.col("__c") * 2 >= F.col("__t")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def median_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation from it."""
    mid = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return df.join(mid, by).groupBy(*by).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))


def effective_size(df: DataFrame, by: list[str], log_weight: str) -> DataFrame:
    """(sum w)^2 / sum w^2 of log weights, shifted by their maximum."""
    top = df.groupBy(*by).agg(F.max(log_weight).alias("__m"))
    w = F.exp(F.col(log_weight) - F.col("__m"))
    return df.join(top, by).groupBy(*by).agg((F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)).alias("ess"))


def best_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def win_rates(metrics: DataFrame, keys: list[str], method: str, baseline: str, columns: list[str]) -> DataFrame:
    """For each method, windows compared with the baseline method and the share where each metric is lower."""
    base = metrics.where(F.col(method) == baseline).select(*keys, *[F.col(c).alias(f"base_{c}") for c in columns])
    met = metrics.where(F.col(method) != baseline).join(base, keys)
    return met.groupBy(method).agg(F.count("*").alias("windows"), *[F.avg((F.col(c) < F.col(f"base_{c}")).cast("double")).alias(f"{c}_win_rate") for c in columns])


def carrier_to_noise(df: DataFrame, by: list[str], inphase: str, quadrature: str, interval: float) -> DataFrame:
    """C/N0 in dB-Hz from the ratio of narrow to wide power of a channel's correlations; 0 where it can't be told."""
    i, q = F.col(inphase), F.col(quadrature)
    s = df.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(i).alias("__i"), F.sum(q).alias("__q"), F.sum(i * i + q * q).alias("__p"))
    ratio = (F.col("__i") * F.col("__i") + F.col("__q") * F.col("__q")) / F.nullif(F.col("__p"), F.lit(0.0))
    told = (ratio > 1.0) & (ratio < F.col("__n"))
    return s.select(*by, F.when(told, 10.0 * F.log10((ratio - 1.0) / (F.col("__n") - ratio) / interval)).otherwise(F.lit(0.0)).alias("cn0"))


def first_preferred(df: DataFrame, by: list[str], preferred: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each group among the preferred ones, or of all where there is none."""
    key = F.struct((~F.coalesce(preferred, F.lit(False))).alias("p"), *order, *[c for c in columns if c not in order])
    best = df.groupBy(*by).agg(F.min(key).alias("b"))
    return best.select(*by, *[F.col(f"b.{c}").alias(c) for c in columns])
