"""Audit, rules and budgets over result tables."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite
from .aggregates import rank_percentiles

_OPS = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def expand_windows(epochs: DataFrame, windows: DataFrame, by: list[str], elapsed: str, index: str, value: str, width: float = 30.0) -> DataFrame:
    """Each epoch with the value of its window; null outside of all.

    Windows are many (often exploded from one row a track), so they are merged with the epochs and never broadcast.
    """
    w = windows.select(*by, F.col(index).cast("long").alias("__w"), value).hint("merge")
    return epochs.withColumn("__w", F.floor(F.col(elapsed) / width).cast("long")).join(w, [*by, "__w"], "left").withColumnRenamed("__w", index)


def budgeted_top(epochs: DataFrame, by: list[str], rate_pct: str, probability: str, order: list[str]) -> DataFrame:
    """Flag `chosen`: the round(rate * n) epochs of a window with the highest probability; not finite ranks last."""
    p = F.when(finite(F.col(probability)), F.col(probability)).otherwise(F.lit(-1.0))
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(p.desc(), *order))
    return epochs.withColumn("chosen", F.coalesce(rank <= F.rint(F.col(rate_pct) / 100.0 * F.count(F.lit(1)).over(w)), F.lit(False)))


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """n, tp, tn, fp, fn and match_rate over rows where both are known."""
    n = lambda c: F.count(F.when(c, 1))
    rows = df.select(*by, predicted.alias("__p"), actual.alias("__a")).where("__p is not null and __a is not null")
    p, a = F.col("__p"), F.col("__a")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), n(p & a).alias("tp"), n(~p & ~a).alias("tn"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    return counts.withColumn("match_rate", (F.col("tp") + F.col("tn")) / F.col("n"))


def rule(conditions: list[tuple[str, str, float]]) -> Column:
    """All of (feature, op, threshold); a feature that is not finite fails."""
    return reduce(operator.and_, [F.coalesce(finite(F.col(f).cast("double")) & _OPS[op](F.col(f), F.lit(t)), F.lit(False)) for f, op, t in conditions])


def rule_gain(df: DataFrame, selected: Column, gain: str, positive: Column, group: str) -> DataFrame:
    """One row: total gain of the selected rows, tp, fp, fn, and the least and mean gain with one group left out."""
    x = df.select(F.col(group).alias("__g"), selected.alias("__s"), F.coalesce(positive, F.lit(False)).alias("__p"), F.when(selected & finite(F.col(gain)), F.col(gain)).otherwise(0.0).alias("__v"))
    n = lambda c: F.sum(c.cast("long"))
    s, p = F.col("__s"), F.col("__p")
    per = x.groupBy("__g").agg(F.sum("__v").alias("v"), n(s).alias("sel"), n(s & p).alias("tp"), n(s & ~p).alias("fp"), n(~s & p).alias("fn"))
    t = F.sum("v")
    total = per.agg(t.alias("gain"), F.sum("sel").alias("selected"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), (t - F.max("v")).alias("loo_min"), (t - t / F.count("*")).alias("loo_mean"), F.count("*").alias("__n"))
    alone = F.col("__n") > 1
    return total.withColumns({c: F.when(alone, F.col(c)) for c in ("loo_min", "loo_mean")}).drop("__n")


def rule_search(df: DataFrame, cuts: dict[str, list[float]], gain: str, wins: Column, group: str) -> DataFrame:
    """Every single rule (feature, op, threshold) with its gain, tp, fp and leave-one-group-out gains, best first.

    A row is dealt to the rules it fulfils in one pass; only sums by (rule, group) are shuffled.
    """
    rules = F.array(*[F.when(rule([(f, op, t)]), F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold"))) for f, ts in cuts.items() for t in ts for op in ("<=", ">=")])
    x = df.select(F.col(group).alias("__g"), F.when(finite(F.col(gain)), F.col(gain)).otherwise(0.0).alias("__v"), F.coalesce(wins, F.lit(False)).alias("__p"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    per = x.groupBy("r", "__g").agg(F.sum("__v").alias("v"), F.count(F.when(F.col("__p"), 1)).alias("tp"), F.count(F.when(~F.col("__p"), 1)).alias("fp"))
    groups = df.select(group).distinct().count()
    # a group without selected rows leaves the whole gain when left out
    worst = F.greatest(F.max("v"), F.when(F.count("*") < groups, F.lit(0.0)).otherwise(F.max("v")))
    out = per.groupBy("r").agg(F.sum("v").alias("gain"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("v") - worst).alias("loo_min"), (F.sum("v") * (1.0 - 1.0 / max(groups, 1))).alias("loo_mean"))
    told = out.select("r.feature", "r.op", "r.threshold", "gain", "tp", "fp", "loo_min", "loo_mean")
    return told.orderBy(F.desc("gain"), "feature", "op", "threshold")  # a row a rule


def replay(epochs: DataFrame, chunks: DataFrame, by: list[str], epoch: str, base: str, other: str) -> DataFrame:
    """Epochs with `error`: that of the other source inside the chosen chunks [start, end], of the base one elsewhere.

    Chunks become a row an epoch, far more than their table tells, so they are merged with the epochs and never broadcast.
    """
    spans = chunks.select(*by, F.explode(F.sequence("start", "end")).alias(epoch)).distinct().withColumn("__on", F.lit(True)).hint("merge")
    return epochs.join(spans, [*by, epoch], "left").withColumn("error", F.when(F.col("__on"), F.col(other)).otherwise(F.col(base))).drop("__on")


def value_deltas(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each column: matched rows, rows of one side only, mean, 95th percentile and largest absolute difference."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("__a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("__b"))
    both = a.join(b, keys, "full_outer")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d")) for c in columns])
    long = both.select("__a", "__b", F.explode(pairs).alias("x")).select("__a", "__b", "x.*")
    n = lambda c: F.count(F.when(c, 1))
    ha, hb = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    sums = long.groupBy("field").agg(n(ha & hb).alias("matched"), n(ha & ~hb).alias("left_only"), n(~ha & hb).alias("right_only"), F.avg("d").alias("mean"), F.max("d").alias("max"))
    return sums.join(rank_percentiles(long, ["field"], "d", {"p95": 0.95}), "field", "left").select("field", "matched", "left_only", "right_only", "mean", "p95", "max")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Keys that only one side has, or whose counts differ, with what is wrong; empty if the sides agree."""
    a, b = left.select(*keys, F.col(count).alias("n_left")), right.select(*keys, F.col(count).alias("n_right"))
    both = a.join(b, keys, "full_outer")
    what = F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").when(F.col("n_left") != F.col("n_right"), "count")
    return both.withColumn("problem", what).where("problem is not null")


def best_source(df: DataFrame, chunk: list[str], source: str, error: str) -> DataFrame:
    """For each chunk the source with the least mean error, ties by name, and that error."""
    m = df.groupBy(*chunk, source).agg(F.avg(error).alias("mean"), F.count("*").alias("n"))
    best = m.groupBy(*chunk).agg(F.min(F.struct("mean", source, "n")).alias("b"))
    return best.select(*chunk, "b.*")


def weighted_scores(df: DataFrame, by: list[str], predicted: str, actual: str, weight: str, over: float = 20.0) -> DataFrame:
    """Weighted MAE and RMSE, correlation, and rows off by more than `over`; weights that are not positive count 1."""
    w = F.when(finite(F.col(weight)) & (F.col(weight) > 0), F.col(weight)).otherwise(F.lit(1.0))
    e = F.abs(F.col(predicted) - F.col(actual))
    return df.groupBy(*by).agg((F.sum(w * e) / F.sum(w)).alias("mae"), F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"), F.corr(predicted, actual).alias("corr"), F.count(F.when(e > over, 1)).alias("over"))


def position_errors(df: DataFrame, by: list[str], estimate: list[Column], truth: list[Column]) -> DataFrame:
    """Errors in the plane and in space of positions against truth, in the local frame of the truth."""
    from ..functions import geodesy as G

    lat, lon, _ = G.ecef_to_lla(*truth)
    east, north, up = G.ecef_to_enu(*[a - b for a, b in zip(estimate, truth)], lat, lon)
    rows = df.select(*by, F.sqrt(east * east + north * north).alias("d2"), F.sqrt(east * east + north * north + up * up).alias("d3"))
    p = lambda q: F.percentile("d2", F.lit(q))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("d2") * F.col("d2"))).alias("rms_2d"), F.sqrt(F.avg(F.col("d3") * F.col("d3"))).alias("rms_3d"), F.avg("d2").alias("mean_2d"),
        F.stddev_pop("d2").alias("std_2d"), p(0.5).alias("p50"), p(0.67).alias("p67"), p(0.95).alias("p95"), F.max("d2").alias("max_2d"))
