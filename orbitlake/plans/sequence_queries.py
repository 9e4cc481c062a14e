"""Smoothing, guards, runs and motion over the tracks of events, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, sequences, windows
from .queries import _EV, _ORD, _events, _query, _r, _read

_BY, _IN = ["user_id"], ["us", "event_id"]


@_query(f"WITH {_EV} SELECT event_id, round(coalesce(stddev_samp(value) OVER ({_ORD} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0), 6) AS value_std FROM ev")
def trailing_deviation(spark, sf_dir):
    return sequences.trailing_std(_events(spark, sf_dir), _BY, _IN, "value", 10).select("event_id", _r("value_std").alias("value_std"))


@_query(f"WITH {_EV} SELECT event_id, round(median(value) OVER ({_ORD} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS value_median FROM ev")
def rolling_medians(spark, sf_dir):
    return sequences.rolling_median(_events(spark, sf_dir), _BY, _IN, "value", 3).select("event_id", _r("value_median").alias("value_median"))


def _kernel_sql(weights: str) -> str:
    return f"""WITH {_EV}, r AS (SELECT *, row_number() OVER ({_ORD}) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
k(o, w) AS (VALUES {weights}), j AS (SELECT a.event_id, sum(b.value * k.w) / sum(k.w) AS v FROM r a JOIN k ON true JOIN r b ON b.user_id = a.user_id AND b.place = a.place + k.o WHERE a.place > 2 AND a.place <= a.n - 2 GROUP BY a.event_id)
SELECT r.event_id, round(coalesce(j.v, r.value), 5) AS value_kernel FROM r LEFT JOIN j USING (event_id)"""


def _kernel(spark, sf_dir, shape):
    return sequences.smooth(_events(spark, sf_dir), _BY, _IN, "value", sequences.kernel(shape, 2)).select("event_id", _r("value_kernel", 5).alias("value_kernel"))


@_query(_kernel_sql("(-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)"))
def triangular_smoothing(spark, sf_dir):
    """The first and last rows, whose window is not whole, keep their value."""
    return _kernel(spark, sf_dir, "triangular")


@_query(_kernel_sql("(-2, exp(-0.5 * (2 / (2 / 1.5)) ^ 2)), (-1, exp(-0.5 * (1 / (2 / 1.5)) ^ 2)), (0, 1.0), (1, exp(-0.5 * (1 / (2 / 1.5)) ^ 2)), (2, exp(-0.5 * (2 / (2 / 1.5)) ^ 2))"))
def gaussian_smoothing(spark, sf_dir):
    return _kernel(spark, sf_dir, "gaussian")


@_query(_kernel_sql("(-2, 1), (-1, 1), (0, 1), (1, 1), (2, 1)"))
def boxcar_smoothing(spark, sf_dir):
    return _kernel(spark, sf_dir, "boxcar")


@_query(f"""WITH {_EV}, s AS (SELECT *, CASE WHEN value <= 20 THEN NULL ELSE value END AS v FROM ev), u AS (SELECT user_id, us, avg(v) AS v FROM s GROUP BY ALL),
q AS (SELECT *, CASE WHEN v IS NOT NULL THEN us END AS k FROM u),
p AS (SELECT *, last_value(k IGNORE NULLS) OVER a AS pt, last_value(v IGNORE NULLS) OVER a AS pv, last_value(k IGNORE NULLS) OVER d AS nt, last_value(v IGNORE NULLS) OVER d AS nv FROM q
  WINDOW a AS (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY user_id ORDER BY us DESC ROWS UNBOUNDED PRECEDING))
SELECT user_id, us, round(CASE WHEN v IS NOT NULL THEN v WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * (us - pt) / (nt - pt) END, 6) AS v_filled FROM p""")
def filled_gaps(spark, sf_dir):
    """Weak readings dropped and filled on the line between their neighbours."""
    u = _events(spark, sf_dir).groupBy("user_id", "us").agg(F.avg(F.when(F.col("value") > 20, F.col("value"))).alias("v"))
    return windows.fill_linear(u, "user_id", "us", "v").select("user_id", "us", _r("v_filled").alias("v_filled"))


@_query(f"""WITH {_EV}, d AS (SELECT *, CASE WHEN abs(value * 12) <= 1000 THEN value * 12 END AS d FROM ev),
j AS (SELECT *, coalesce(abs(d - lag(d) OVER w) > 300, false) OR coalesce(abs(lead(d) OVER w - d) > 300, false) AS bad FROM d WINDOW w AS ({_ORD}))
SELECT event_id, CASE WHEN NOT bad THEN round(d, 6) END AS drift_clean FROM j""")
def drift_cleaning(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("drift", F.col("value") * 12)
    return sequences.drop_bad_drift(ev, _BY, _IN, "drift", 1000.0, 300.0).select("event_id", _r("drift_clean").alias("drift_clean"))


@_query(f"""WITH {_EV}, a AS (SELECT *, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) / 30 AS a FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))
SELECT event_id, round(2 * coalesce(1 / (1 + a * a), 1), 6) AS weight FROM a""")
def acceleration_weighting(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("w", F.lit(2.0))
    return sequences.acceleration_weights(ev, ["user_id", "event_type"], _IN, "value", "w", 30.0).select("event_id", _r("w_new").alias("weight"))


@_query(f"""WITH {_EV}, f AS (SELECT *, value < 45 OR event_id % 11 = 0 AS f, row_number() OVER ({_ORD}) - 1 AS r FROM ev),
i AS (SELECT user_id, r, r - row_number() OVER ({_ORD}) AS i FROM f WHERE f), g AS (SELECT user_id, i, min(r) AS first, max(r) AS last, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM g) WHERE k = 1 AND n >= 4""")
def longest_weak_run(spark, sf_dir):
    """The longest run of epochs with few pairs, or pairs that were not used."""
    weak = (F.col("value") < 45) | (F.col("event_id") % 11 == 0)
    return sequences.longest_run(_events(spark, sf_dir), _BY, _IN, weak, 4)


@_query(f"""WITH {_EV}, g AS (SELECT *, value <= 20 AND event_id % 3 <> 0 AS guarded, event_id % 5 = 0 AS still FROM ev),
n AS (SELECT *, bool_or(guarded AND NOT still) OVER ({_ORD} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM g)
SELECT event_id, guarded, NOT guarded AND near AND NOT still AND value >= 30 AS expanded FROM n""")
def tail_guards(spark, sf_dir):
    """Forward values in place of smoothed ones where all conditions hold, and around there."""
    out = sequences.tail_guard(_events(spark, sf_dir), _BY, _IN, [F.col("value") <= 20, F.col("event_id") % 3 != 0], F.col("event_id") % 5 == 0, 2, F.col("value") >= 30)
    return out.select("event_id", "guarded", "expanded")


@_query(f"""WITH {_EV}, d AS (SELECT user_id, abs(value - lag(value) OVER w) AS s, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) AS a FROM ev WINDOW w AS ({_ORD}))
SELECT user_id, round(coalesce(avg(s), 0), 6) AS step_mean, round(coalesce(quantile_cont(s, 0.95), 0), 6) AS step_p95, round(coalesce(avg(a), 0), 6) AS accel_mean, round(coalesce(quantile_cont(a, 0.95), 0), 6) AS accel_p95 FROM d GROUP BY user_id""")
def path_motion(spark, sf_dir):
    m = sequences.motion_stats(_events(spark, sf_dir), _BY, _IN, ["value"])
    return m.select("user_id", *[_r(c).alias(c) for c in ("step_mean", "step_p95", "accel_mean", "accel_p95")])


@_query(f"""WITH {_EV}, v AS (SELECT event_id, user_id, us, CASE WHEN t - lag(t) OVER w > 0 THEN (value - lag(value) OVER w) / (t - lag(t) OVER w) ELSE 0 END AS v FROM ev WINDOW w AS ({_ORD}))
SELECT event_id, round(abs(avg(v) OVER ({_ORD} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), 8) AS speed, event_id % 2 = 0 AND abs(avg(v) OVER ({_ORD} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) < 0.001 AS stopped FROM v""")
def speed_and_stops(spark, sf_dir):
    """Smoothed speed, and stops that both a sensor and the speed agree on."""
    out = sequences.moving(_events(spark, sf_dir), _BY, _IN, "t", ["value"], 4)
    return out.select("event_id", _r("speed", 8).alias("speed"), ((F.col("event_id") % 2 == 0) & (F.col("speed") < 0.001)).alias("stopped"))


@_query(f"""WITH {_EV}, s AS (SELECT *, abs(-0.5 * (value * 0.01 + lead(value) OVER w * 0.01) * 60 - (lead(value) OVER w - value)) > 40 AND (lead(t) OVER w - t) > 0 AND (lead(t) OVER w - t) <= 86400
  AND (event_id % 4 <> 0) AND lead(event_id) OVER w % 4 <> 0 AS x FROM ev WINDOW w AS ({_ORD})),
b AS (SELECT *, coalesce(x, false) OR coalesce(lag(x) OVER ({_ORD}), false) AS rejected FROM s)
SELECT event_id, rejected, CASE WHEN rejected THEN 0.0 ELSE (event_id % 4)::DOUBLE END AS weight FROM b""")
def range_rate_consistency(spark, sf_dir):
    """Both ends of a step lose their weight where ranges and rates disagree."""
    ev = _events(spark, sf_dir).withColumns({"rate": F.col("value") * 0.01, "w": (F.col("event_id") % 4).cast("double")})
    out = sequences.paired_consistency(ev, _BY, _IN, "t", "value", "rate", "w", F.lit(60.0), 40.0, 86400.0)
    return out.select("event_id", "rejected", F.col("w_new").alias("weight"))


@_query(f"""WITH {_EV}, r AS (SELECT *, row_number() OVER ({_ORD}) - 1 AS r FROM ev), h AS (SELECT * FROM r WHERE value >= 60),
c AS (SELECT *, coalesce(r <> lag(r) OVER ({_ORD}) + 1 OR t - lag(t) OVER ({_ORD}) > 36000, false)::INT AS new FROM h), s AS (SELECT *, sum(new) OVER ({_ORD}) AS segment FROM c)
SELECT user_id, segment::BIGINT AS segment, min(r) AS start_index, max(r) AS end_index, count(*) AS n, round(max(t) - min(t), 3) AS duration, round(avg(value), 6) AS mean, max(value) AS max FROM s GROUP BY ALL""")
def outlier_segments(spark, sf_dir):
    """Runs of large errors, cut at missing epochs and long gaps."""
    s = sequences.segments(_events(spark, sf_dir), _BY, _IN, "t", "value", 60.0, 36000.0)
    return s.select("user_id", "segment", "start_index", "end_index", "n", _r("duration", 3).alias("duration"), _r("mean").alias("mean"), "max")


@_query(f"""WITH {_EV}, e AS (SELECT DISTINCT user_id, us // 86400000000 AS d FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS epoch FROM e),
m AS (SELECT ev.user_id, event_type, epoch, min(us) AS us, max(value) AS v FROM ev JOIN k ON k.user_id = ev.user_id AND k.d = us // 86400000000 GROUP BY ALL),
n AS (SELECT *, coalesce(NOT (abs(v - lag(v) OVER w) <= 60 AND epoch = lag(epoch) OVER w + 1), true)::INT AS new FROM m WINDOW w AS (PARTITION BY user_id, event_type ORDER BY epoch)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY epoch) AS g FROM n)
SELECT user_id, event_type, epoch, us - min(us) OVER (PARTITION BY user_id, event_type, g) AS streak FROM g""")
def lock_streaks(spark, sf_dir):
    """How long each signal has been followed without a jump or a missing epoch."""
    ev = _events(spark, sf_dir).withColumn("d", F.expr("us div 86400000000"))
    epochs = ev.select("user_id", "d").distinct().withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("d")).cast("long"))
    m = ev.join(epochs, ["user_id", "d"]).groupBy("user_id", "event_type", "epoch").agg(F.min("us").alias("us"), F.max("value").alias("v"))
    return sequences.streaks(m, ["user_id", "event_type"], ["epoch"], "us", "v", 60.0, "epoch").select("user_id", "event_type", "epoch", "streak")


@_query(f"""WITH {_EV} SELECT event_id, coalesce(lag(value) OVER w, value) AS value_prev, round(coalesce(value - lag(value) OVER w, 0), 6) AS value_delta_prev,
round(coalesce(avg(value) OVER ({_ORD} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), value), 6) AS value_past_mean FROM ev WINDOW w AS ({_ORD})""")
def temporal_probabilities(spark, sf_dir):
    out = sequences.past_probabilities(_events(spark, sf_dir), _BY, _IN, "value")
    return out.select("event_id", "value_prev", _r("value_delta_prev").alias("value_delta_prev"), _r("value_past_mean").alias("value_past_mean"))


@_query(f"""WITH {_EV}, r AS (SELECT *, row_number() OVER ({_ORD}) AS epoch, coalesce(row_number() OVER ({_ORD}) + (lead(us) OVER ({_ORD}) IS NOT NULL)::INT, 0) AS x FROM ev)
SELECT event_id, epoch FROM r WHERE epoch > 5 AND epoch <= 25 AND x <= 25""")
def epoch_window(spark, sf_dir):
    """Twenty epochs from the sixth on, whose next epoch is among them."""
    w = Window.partitionBy("user_id").orderBy(*_IN)
    n = F.row_number().over(w).cast("long")
    rows = _events(spark, sf_dir).withColumns({"epoch": n, "following": n + F.lead("us").over(w).isNotNull().cast("int")})
    return sequences.trim_epochs(rows, "epoch", 5, 20, "following").select("event_id", "epoch")


@_query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT user_id, unnest(list_concat(range(0, n, 25), [greatest(0, n - 40)])) AS start FROM n) SELECT DISTINCT user_id, start FROM s""")
def segment_starts(spark, sf_dir):
    n = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(sequences.window_starts(F.col("n"), 40, 25)).alias("start"))


@_query("""WITH s AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, event_type, value FROM s WHERE k <= 3""")
def strongest_three(spark, sf_dir):
    """Top three readings of each track and signal."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return _read(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id", "event_type", "value")


@_query(f"""WITH {_EV}, b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM ev WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id)
SELECT ev.user_id, ev.event_id FROM ev JOIN b USING (user_id) WHERE event_type = (SELECT max(event_type) FROM events) AND us BETWEEN lo - 180000000 AND hi + 180000000""")
def span_trim(spark, sf_dir):
    """Base rows within three minutes of the rover's time span."""
    ev = _events(spark, sf_dir)
    lo, hi = ev.agg(F.min("event_type"), F.max("event_type")).first()
    return joins.trim_to_span(ev.where(F.col("event_type") == hi), ev.where(F.col("event_type") == lo), "user_id", "us", 180_000_000).select("user_id", "event_id")


@_query(f"""WITH {_EV}, a AS (SELECT user_id, us, event_id FROM ev WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, us, max(value) > 50 AS f FROM ev WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL),
p AS (SELECT a.*, b.us AS pu, b.f AS pf FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.us), n AS (SELECT p.*, b.us AS nu, b.f AS nf FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.us <= b.us)
SELECT event_id, CASE WHEN pu IS NULL OR nu - us < us - pu THEN nf ELSE pf END AS stopped FROM n""")
def nearest_flag(spark, sf_dir):
    """The stop flag of the nearest sensor sample, ties to the earlier one."""
    ev = _events(spark, sf_dir)
    lo, hi = ev.agg(F.min("event_type"), F.max("event_type")).first()
    flags = ev.where(F.col("event_type") == hi).groupBy("user_id", "us").agg((F.max("value") > 50).alias("stopped"))
    return joins.nearest_asof(ev.where(F.col("event_type") == lo).select("user_id", "us", "event_id"), flags, "user_id", "us", "stopped").select("event_id", "stopped")


@_query(f"""WITH {_EV}, a AS (SELECT DISTINCT user_id, us // 3600000000 AS h FROM ev WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, us // 3600000000 AS h, max(value) AS v FROM ev WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL),
o(o, k) AS (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4)), m AS (SELECT a.user_id, a.h, b.v, o.o, row_number() OVER (PARTITION BY a.user_id, a.h ORDER BY k) AS r FROM a, o, b WHERE b.user_id = a.user_id AND b.h = a.h + o.o)
SELECT a.user_id, a.h, m.v, m.o AS shift FROM a LEFT JOIN m ON m.user_id = a.user_id AND m.h = a.h AND m.r = 1""")
def rounded_key_lookup(spark, sf_dir):
    """The reading at a rounded time, else at the nearest of a list of offsets."""
    ev = _events(spark, sf_dir).withColumn("h", F.expr("us div 3600000000"))
    lo, hi = ev.agg(F.min("event_type"), F.max("event_type")).first()
    b = ev.where(F.col("event_type") == hi).groupBy("user_id", "h").agg(F.max("value").alias("v"))
    return joins.offset_lookup(ev.where(F.col("event_type") == lo).select("user_id", "h").distinct(), b, "user_id", "h", "v", [0, 1, -1, 2, -2])


@_query(f"""WITH {_EV}, m AS (SELECT user_id, event_type, us // 86400000000 AS d, max(value) AS v FROM ev GROUP BY ALL)
SELECT b.user_id, b.event_type, b.d, round(b.v - a.v, 6) AS step FROM m b JOIN m a ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.d = b.d - 1""")
def common_satellites(spark, sf_dir):
    """Signals of a track that both of two epochs in a row have, with the step between them."""
    m = _events(spark, sf_dir).groupBy("user_id", "event_type", F.expr("us div 86400000000").alias("d")).agg(F.max("value").alias("v"))
    return joins.in_both_epochs(m, ["user_id", "event_type"], "d", "v").select("user_id", "event_type", "d", _r("step").alias("step"))
