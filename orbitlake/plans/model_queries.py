"""Boosted trees and the fix-rate product over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import product, trees, windows
from .queries import _EV, _events, _query, _r

_WEIGHT = "(1 + event_id % 3)"


@_query(f"""WITH {_EV},
b AS (SELECT user_id % 5 AS fold, {_WEIGHT} AS w, CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END AS y, [user_id % 16, us // 3600000000 % 24, coalesce(floor(value / 10)::BIGINT + 1, 0)] AS bins FROM ev),
m AS (SELECT k AS model, round(w * (0.25 - y) * 1e6)::BIGINT AS g, round(w * 0.1875 * 1e6)::BIGINT AS h, bins FROM b, range(6) r(k) WHERE fold <> k),
x AS (SELECT model, unnest(range(3)) AS feature, unnest(bins) AS bin, g, h FROM m),
s AS (SELECT model, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT model, feature, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER a AS g, sum(h) OVER a AS h FROM s WINDOW u AS (PARTITION BY model, feature ORDER BY bin), a AS (PARTITION BY model, feature))
SELECT model::INT AS model, feature::INT AS feature, bin::INT AS bin, nl::BIGINT AS rows_left, round((gl / 1e6) ^ 2 / (hl / 1e6 + 1) + ((g - gl) / 1e6) ^ 2 / ((h - hl) / 1e6 + 1) - (g / 1e6) ^ 2 / (h / 1e6 + 1), 4) AS gain FROM c""")
def split_gains(spark, sf_dir):
    """Gain of every cut of the first node, of five models that leave a fold out and of one over all rows."""
    us = F.expr("cast(us div 3600000000 % 24 as int)")
    bins = {"__b0": (F.col("user_id") % 16).cast("int"), "__b1": us, "__b2": F.coalesce(F.floor(F.col("value") / 10).cast("int") + 1, F.lit(0))}
    rows = _events(spark, sf_dir).withColumns(bins)
    w, y, node = 1 + F.col("event_id") % 3, F.coalesce(F.col("value") > 30, F.lit(False)).cast("double"), F.lit(1)
    models = [((F.col("user_id") % 5 != k), node, w * (0.25 - y), w * F.lit(0.1875)) for k in range(6)]
    g = trees.split_gains(trees.histogram(rows, models, 3), 1.0)
    return g.select("model", "feature", "bin", F.col("nl").alias("rows_left"), _r("gain", 4).alias("gain"))


def _windows(spark, sf_dir):
    """A row an event: what its track held before, its hour, a base rate from the mean so far and the rate to predict."""
    rows = windows.past_features(_events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 5)
    hour = F.expr("cast(us div 3600000000 % 24 as double)")
    base = F.coalesce(F.least(F.greatest(F.col("value_mean") / 100, F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    actual = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({"hour": hour, "fold": (F.col("user_id") % 5).cast("int"), "base": base, "actual": actual, "weight": F.lit(1.0) + F.col("event_id") % 3})


_FEATURES = ["value_mean", "value_std", "value_max", "hour"]


@_query(None)
def out_of_fold_trees(spark, sf_dir):
    """Probability that the value is over 30, from boosted trees of all runs but the event's own."""
    rows = _windows(spark, sf_dir).withColumn("y", F.when(F.col("value").isNotNull(), (F.col("value") > 30).cast("int")))
    model = trees.fit(rows, _FEATURES, "y", None, "fold", 5, rounds=4, depth=3)
    return trees.predict(rows, model, "p", "fold").select("event_id", "fold", _r("p").alias("probability"))


@_query(None)
def fix_rate_product(spark, sf_dir):
    """The whole product out of fold: transition classifiers, corrector, calibrator and one guard."""
    rows = windows.jumps(_windows(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 25.0)
    targets = {"high": F.col("value") > 40, "jumped": F.col("jump")}
    model = product.fit(rows, _FEATURES, targets, "base", "actual", "weight", ["user_id"], ["us", "event_id"], "fold", 5, calibrated=True, rounds=3, depth=2)
    guards = [{"feature": "value_std", "operator": ">=", "threshold": 60.0, "cap": 0.6}]
    out = product.predict(rows, model, guards, 0.5, "fold")
    return out.select("event_id", "fold", *[_r(c).alias(c) for c in ("high", "jumped", "residual", "rate")])
