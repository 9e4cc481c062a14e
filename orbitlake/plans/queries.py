"""Registered queries over the driver's tables, each with its DuckDB SQL.

events stands for measurements: user_id is a track, ts its time, event_type a method or signal, value an error or reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atmosphere, signals
from ..functions import geodesy as G
from ..operators import aggregates, estimators, joins, slips, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SECONDS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t: seconds since 2024 began, and us: the same in whole microseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return _read(spark, sf_dir, "events").withColumn("us", us).withColumn("t", F.col("us") / F.lit(1e6))


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_EV = f"ev AS (SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, {SECONDS} AS t FROM events)"

_WINDOWED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev),
win AS (SELECT *, unnest(range(greatest(0, ceil((r - 499) / 250.0))::BIGINT, least(r // 250, (n - 500) // 250) + 1)) AS w FROM ranked WHERE n >= 500)"""


@_query(f"""WITH {_EV}, {_WINDOWED}
SELECT event_type, w::INT AS window_index, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM win GROUP BY event_type, w""")
def window_error_report(spark, sf_dir):
    """Error metrics of windows of 500 epochs, one every 250."""
    rows = windows.count_windows(_events(spark, sf_dir), ["event_type"], ["us", "event_id"], 500, 250)
    m = aggregates.error_metrics(rows, ["event_type", "window"], "value")
    return m.select("event_type", F.col("window").alias("window_index"), "n", _r("rms").alias("rms"), _r("p50").alias("p50"), _r("p95").alias("p95"), "max")


@_query(f"""WITH {_EV}, {_WINDOWED},
m AS (SELECT event_type, w, sqrt(avg(value * value)) AS rms, quantile_cont(value, 0.95) AS p95 FROM win GROUP BY ALL),
b AS (SELECT w, rms AS rb, p95 AS pb FROM m WHERE event_type = (SELECT min(event_type) FROM events))
SELECT event_type, count(*) AS windows, round(avg((rms < rb)::INT), 6) AS rms_win_rate, round(avg((p95 < pb)::INT), 6) AS p95_win_rate
FROM m JOIN b USING (w) WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY event_type""")
def window_win_rates(spark, sf_dir):
    """Share of windows where a method beats the first method by name."""
    ev = _events(spark, sf_dir)
    base = ev.agg(F.min("event_type")).first()[0]
    m = aggregates.error_metrics(windows.count_windows(ev, ["event_type"], ["us", "event_id"], 500, 250), ["event_type", "window"], "value")
    w = aggregates.win_rates(m, ["window"], "event_type", base, ["rms", "p95"])
    return w.select("event_type", "windows", _r("rms_win_rate").alias("rms_win_rate"), _r("p95_win_rate").alias("p95_win_rate"))


@_query("""SELECT user_id, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.67), 6) AS p67, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def track_error_metrics(spark, sf_dir):
    m = aggregates.error_metrics(_read(spark, sf_dir, "events"), ["user_id"], "value")
    return m.select("user_id", "n", *[_r(c).alias(c) for c in ("rms", "mean", "std", "p50", "p67", "p95")], "max")


@_query("""SELECT round(0.5 * (quantile_cont(value, 0.5) + quantile_cont(value, 0.95)), 6) AS score FROM events WHERE value IS NOT NULL""")
def competition_score(spark, sf_dir):
    m = aggregates.rank_percentiles(_read(spark, sf_dir, "events").where(signals.finite(F.col("value"))), [], "value", {"p50": 0.5, "p95": 0.95})
    return m.select(_r((F.col("p50") + F.col("p95")) * 0.5).alias("score"))


@_query("""SELECT coalesce(event_type, 'OVERALL') AS event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY ROLLUP (event_type)""")
def overall_summary(spark, sf_dir):
    s = aggregates.with_overall(_read(spark, sf_dir, "events"), "event_type", [F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")])
    return s.select("event_type", "n", _r("mean").alias("mean"), "max")


@_query("""WITH s AS (SELECT l_orderkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_orderkey) AS total FROM s)
SELECT l_orderkey, min(v) AS weighted_median FROM c WHERE run * 2 >= total GROUP BY l_orderkey""")
def weighted_median_price(spark, sf_dir):
    return aggregates.weighted_median(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_quantity")


@_query("""WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM events GROUP BY user_id)
SELECT user_id, round(any_value(med), 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id""")
def track_median_mad(spark, sf_dir):
    m = aggregates.median_mad(_read(spark, sf_dir, "events"), ["user_id"], "value")
    return m.select("user_id", _r("median").alias("median"), _r("mad").alias("mad"))


@_query("""WITH m AS (SELECT user_id, max(-value / 50) AS m FROM events GROUP BY user_id)
SELECT user_id, round(sum(exp(-value / 50 - m)) ^ 2 / sum(exp(-value / 50 - m) ^ 2), 4) AS ess FROM events JOIN m USING (user_id) GROUP BY user_id""")
def effective_sample_size(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").withColumn("lw", -F.col("value") / 50)
    return aggregates.effective_size(ev, ["user_id"], "lw").select("user_id", _r("ess", 4).alias("ess"))


@_query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def strongest_per_signal(spark, sf_dir):
    """One row for each track and signal: the one with the highest reading."""
    best = aggregates.best_of(_read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")])
    return best.select("user_id", "event_type", "event_id", "value")


_ASOF = f"""WITH {_EV}, a AS (SELECT user_id, us, event_id FROM ev WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT user_id, us, max(value) AS value FROM ev WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL),
p AS (SELECT a.*, b.us AS pu, b.value AS pv FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.us),
n AS (SELECT p.*, b.us AS nu, b.value AS nv FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.us <= b.us),
j AS (SELECT user_id, us, event_id, CASE WHEN pu IS NULL OR nu - us < us - pu THEN nu ELSE pu END AS mu, CASE WHEN pu IS NULL OR nu - us < us - pu THEN nv ELSE pv END AS mv FROM n)"""


def _two(spark, sf_dir):
    ev = _events(spark, sf_dir)
    lo, hi = ev.agg(F.min("event_type"), F.max("event_type")).first()
    return ev.where(F.col("event_type") == lo).select("user_id", "us", "event_id"), ev.where(F.col("event_type") == hi).groupBy("user_id", "us").agg(F.max("value").alias("value"))


@_query(_ASOF + " SELECT user_id, us, event_id, mv AS value, mu AS us_right FROM j")
def nearest_asof(spark, sf_dir):
    """Nearest reading of another signal of the track; ties go to the earlier one."""
    a, b = _two(spark, sf_dir)
    return joins.nearest_asof(a, b, "user_id", "us", "value")


@_query(_ASOF + " SELECT user_id, us, event_id, CASE WHEN abs(mu - us) <= 36e8 THEN mv END AS value, CASE WHEN abs(mu - us) <= 36e8 THEN mu END AS us_right FROM j")
def nearest_asof_tolerance(spark, sf_dir):
    """The same within an hour."""
    a, b = _two(spark, sf_dir)
    return joins.nearest_asof(a, b, "user_id", "us", "value", 3.6e9)


@_query(_ASOF + """, pp AS (SELECT a.user_id, a.us, b.us AS pu, b.value AS pv FROM (SELECT DISTINCT user_id, us FROM a) a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us > b.us),
nn AS (SELECT pp.*, b.us AS nu, b.value AS nv FROM pp ASOF LEFT JOIN b ON pp.user_id = b.user_id AND pp.us < b.us)
SELECT user_id, us, round(CASE WHEN nu - pu <= 864e8 THEN pv + (us - pu) / (nu - pu)::DOUBLE * (nv - pv) END, 6) AS value FROM nn""")
def interpolated_join(spark, sf_dir):
    """A reading between the ones before and after, a day apart at most."""
    a, b = _two(spark, sf_dir)
    out = joins.interpolated_join(a.select("user_id", "us").distinct(), b, "user_id", "us", "value", 8.64e10)
    return out.select("user_id", "us", _r("value").alias("value"))


@_query(f"""WITH {_EV}, w AS (SELECT DISTINCT user_id, us // 43200000000 * 43200000000 + 3600000000 AS lo FROM ev)
SELECT ev.user_id, ev.event_id, w.lo FROM ev JOIN w ON ev.user_id = w.user_id AND ev.us >= w.lo AND ev.us < w.lo + 21600000000""")
def interval_join(spark, sf_dir):
    """Epochs in the six-hour windows of their track."""
    ev = _events(spark, sf_dir)
    lo = F.expr("us div 43200000000") * 43200000000 + 3600000000
    w = ev.select("user_id", lo.alias("lo")).distinct().withColumn("hi", F.col("lo") + 21600000000)
    return joins.interval_join(ev.select("user_id", "event_id", "us"), w, "user_id", "us", "lo", "hi", 21600000000).select("user_id", "event_id", "lo")


_SIDES = """WITH a AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
s AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.d, b.d)::VARCHAR AS day, CASE WHEN b.d IS NULL THEN 'left_only' WHEN a.d IS NULL THEN 'right_only' ELSE 'both' END AS side
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.d = b.d)"""


def _sides(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("day", F.col("ts").cast("date").cast("string"))
    lo, hi = ev.agg(F.min("event_type"), F.max("event_type")).first()
    return joins.sides(ev.where(F.col("event_type") == lo), ev.where(F.col("event_type") == hi), ["user_id", "day"])


@_query(_SIDES + " SELECT user_id, day, side FROM s")
def key_sides(spark, sf_dir):
    """Which of two signals each track has on each day."""
    return _sides(spark, sf_dir)


@_query(_SIDES + " SELECT user_id, count(*) FILTER (WHERE side = 'both') AS n_both, count(*) FILTER (WHERE side = 'left_only') AS n_left, count(*) FILTER (WHERE side = 'right_only') AS n_right, round(count(*) FILTER (WHERE side = 'both') / count(*), 6) AS jaccard FROM s GROUP BY user_id")
def side_counts(spark, sf_dir):
    n = lambda x: F.sum(F.when(F.col("side") == x, 1).otherwise(0)).cast("long")
    out = _sides(spark, sf_dir).groupBy("user_id").agg(n("both").alias("n_both"), n("left_only").alias("n_left"), n("right_only").alias("n_right"), F.count("*").alias("n"))
    return out.select("user_id", "n_both", "n_left", "n_right", _r(F.col("n_both") / F.col("n")).alias("jaccard"))


@_query("""SELECT c_custkey, n_name, r_name, coalesce(s.total, 0.0) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey""")
def feature_left_join(spark, sf_dir):
    """Base rows with features, missing ones as zero."""
    c, n, r, o = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    totals = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    base = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return base.join(totals, "c_custkey", "left").na.fill(0.0, ["total"]).select("c_custkey", "n_name", "r_name", "total")


@_query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def semi_anti_filters(spark, sf_dir):
    c, n, o = (_read(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    near = n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.join(o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").join(near, "c_nationkey", "left_semi").select("c_custkey")


_ORD = "PARTITION BY user_id ORDER BY us, event_id"


@_query(f"""WITH {_EV} SELECT event_id, round(avg(value) OVER w, 6) AS value_mean, round(stddev_samp(value) OVER w, 6) AS value_std, max(value) OVER w AS value_max FROM ev
WINDOW w AS ({_ORD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def lag_features(spark, sf_dir):
    out = windows.past_features(_events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 5)
    return out.select("event_id", _r("value_mean").alias("value_mean"), _r("value_std").alias("value_std"), "value_max")


@_query(f"WITH {_EV} SELECT event_id, round(avg(value) OVER ({_ORD} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS value_smooth FROM ev")
def centred_rolling_mean(spark, sf_dir):
    return windows.centred_mean(_events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 3).select("event_id", _r("value_smooth").alias("value_smooth"))


@_query(f"""WITH {_EV}, g AS (SELECT event_id, value AS v, lag(value) OVER w AS v0, lead(value) OVER w AS v1, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1 FROM ev WINDOW w AS ({_ORD}))
SELECT event_id, round(CASE WHEN h0 IS NULL AND h1 IS NULL THEN 0 WHEN h0 IS NULL THEN (v1 - v) / h1 WHEN h1 IS NULL THEN (v - v0) / h0
  ELSE (h0 * h0 * v1 + (h1 * h1 - h0 * h0) * v - h1 * h1 * v0) / (h0 * h1 * (h0 + h1)) END, 6) AS value_rate FROM g""")
def value_gradient(spark, sf_dir):
    return windows.gradient(_events(spark, sf_dir), "user_id", ["us", "event_id"], "t", "value").select("event_id", _r("value_rate").alias("value_rate"))


@_query(f"""WITH {_EV}, j AS (SELECT *, coalesce(round_even((value - lag(value) OVER ({_ORD})) / 40, 0), 0) AS jump FROM ev)
SELECT event_id, round(value - 40 * sum(jump) OVER ({_ORD} ROWS UNBOUNDED PRECEDING), 6) AS value_unwrapped FROM j""")
def phase_unwrap(spark, sf_dir):
    return windows.unwrap(_events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 40.0).select("event_id", _r("value_unwrapped").alias("value_unwrapped"))


@_query(f"""WITH {_EV}, f AS (SELECT *, value > 50 AS f, row_number() OVER ({_ORD}) AS r FROM ev),
i AS (SELECT *, r - row_number() OVER ({_ORD}) AS i FROM f WHERE f)
SELECT user_id, count(*) AS n, min(us) AS first, max(us) AS last FROM i GROUP BY user_id, i HAVING count(*) >= 3""")
def weak_runs(spark, sf_dir):
    """Runs of three or more epochs over the limit."""
    return windows.islands(_events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("value") > 50, 3)


@_query(f"""WITH {_EV} SELECT event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id)) > 30, false) AS jump FROM ev""")
def clock_jumps(spark, sf_dir):
    """Steps over the limit within a track and signal, as in cycle-slip and clock-jump tests."""
    return windows.jumps(_events(spark, sf_dir), ["user_id", "event_type"], ["us", "event_id"], "value", 30.0).select("event_id", "jump")


@_query(f"""WITH {_EV}, m AS (SELECT user_id, min(us) AS lo FROM ev GROUP BY user_id)
SELECT ev.user_id, (us - lo) // 86400000000 AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM ev JOIN m USING (user_id) GROUP BY ALL""")
def time_bins(spark, sf_dir):
    """Tumbling days from the first epoch of each track."""
    ev = _events(spark, sf_dir)
    lo = ev.groupBy("user_id").agg(F.min("us").alias("lo"))
    out = ev.join(lo, "user_id").groupBy("user_id", F.expr("(us - lo) div 86400000000").alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select("user_id", "bin", "n", _r("mean").alias("mean"))


@_query("""SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) ^ 2 <> 0 THEN
(count(*) * sum(l_quantity * l_extendedprice) - sum(l_quantity) * sum(l_extendedprice)) / (count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) ^ 2) END, 3) AS slope FROM lineitem GROUP BY l_orderkey""")
def grouped_line_fit(spark, sf_dir):
    """Least squares for each group by normal equations."""
    return estimators.line_fit(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity"), F.col("l_extendedprice")).select("l_orderkey", "n", _r("slope", 3).alias("slope"))


_GEO = "g AS (SELECT c_custkey, radians((c_custkey * 37 % 17000) / 100.0 - 85) AS lat, radians((c_custkey * 53 % 36000) / 100.0 - 180) AS lon, c_acctbal AS alt FROM customer)"
_XYZ = f"""x AS (SELECT *, ({G.A!r} / sqrt(1 - {G.E2!r} * sin(lat) * sin(lat)) + alt) * cos(lat) * cos(lon) AS x, ({G.A!r} / sqrt(1 - {G.E2!r} * sin(lat) * sin(lat)) + alt) * cos(lat) * sin(lon) AS y,
({G.A!r} / sqrt(1 - {G.E2!r} * sin(lat) * sin(lat)) * (1 - {G.E2!r}) + alt) * sin(lat) AS z FROM g)"""


def _geo(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    lat, lon = F.radians((F.col("c_custkey") * 37 % 17000) / 100.0 - 85), F.radians((F.col("c_custkey") * 53 % 36000) / 100.0 - 180)
    out = c.select("c_custkey", lat.alias("lat"), lon.alias("lon"), F.col("c_acctbal").alias("alt"))
    x, y, z = G.lla_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    return out.withColumns({"x": x, "y": y, "z": z})


@_query(f"WITH {_GEO}, {_XYZ} SELECT c_custkey, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM x")
def geodetic_to_ecef(spark, sf_dir):
    return _geo(spark, sf_dir).select("c_custkey", *[(_r(c, 3) + 0.0).alias(c) for c in "xyz"])


@_query(f"WITH {_GEO} SELECT c_custkey, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 3) AS alt FROM g")
def ecef_to_geodetic(spark, sf_dir):
    """There and back."""
    lat, lon, alt = G.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))
    return _geo(spark, sf_dir).select("c_custkey", _r(lat, 8).alias("lat"), _r(lon, 8).alias("lon"), _r(alt, 3).alias("alt"))


@_query(f"""WITH {_GEO}, o AS (SELECT *, radians(35.0) AS la, radians(139.0) AS lo FROM g)
SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(least(sin((lat - la) / 2) ^ 2 + cos(la) * cos(lat) * sin((lon - lo) / 2) ^ 2, 1.0))), 2) AS metres FROM o""")
def haversine_distance(spark, sf_dir):
    g = _geo(spark, sf_dir)
    return g.select("c_custkey", _r(G.haversine(F.radians(F.lit(35.0)), F.radians(F.lit(139.0)), F.col("lat"), F.col("lon")), 2).alias("metres"))


@_query(f"""WITH {_GEO}, {_XYZ}, s AS (SELECT *, {G.OMEGA!r} * sqrt((2e7 - x) * (2e7 - x) + (1e7 - y) * (1e7 - y) + (1.2e7 - z) * (1.2e7 - z)) / {G.LIGHT!r} AS a FROM x)
SELECT c_custkey, round(sqrt((cos(a) * 2e7 + sin(a) * 1e7 - x) ^ 2 + (cos(a) * 1e7 - sin(a) * 2e7 - y) ^ 2 + (1.2e7 - z) ^ 2), 3) AS metres FROM s""")
def sagnac_ranges(spark, sf_dir):
    g = _geo(spark, sf_dir)
    return g.select("c_custkey", _r(G.sagnac_range(F.col("x"), F.col("y"), F.col("z"), F.lit(2e7), F.lit(1e7), F.lit(1.2e7)), 3).alias("metres"))


@_query("SELECT event_id, round(value - round_even(value, 0), 6) AS cycles FROM events")
def cycle_residuals(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", _r(G.wrap_cycles(F.col("value"))).alias("cycles"))


@_query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def worst_epochs(spark, sf_dir):
    """Top-k report."""
    return _read(spark, sf_dir, "events").orderBy(F.col("value").desc(), "event_id").limit(20).select("event_id", "user_id", "value")


@_query("SELECT n_regionkey AS region, 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'region', r_name FROM region")
def union_frames(spark, sf_dir):
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    a = n.select(F.col("n_regionkey").alias("region"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return a.unionByName(r.select(F.col("r_regionkey").alias("region"), F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@_query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def value_histogram(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@_query(None)
def track_kalman(spark, sf_dir):
    """Constant-velocity filter over the readings of each track; tested against a plain loop."""
    from ..streaming.kalman import filter_batch

    return filter_batch(_events(spark, sf_dir).select(F.col("user_id").alias("track"), (F.col("t") / 3600).alias("t"), F.col("value").alias("z")))


@_query(None)
def epoch_positions(spark, sf_dir):
    """Weighted least-squares positions of synthetic epochs built on lineitem: a line is a satellite of its order."""
    li = _read(spark, sf_dir, "lineitem")
    az, el = (F.col("l_partkey") * 61 + F.col("l_linenumber") * 97) % 360, F.col("l_suppkey") * 29 % 70 + 15
    # directions around the receiver's zenith
    x = -1e7 + 1.6e7 * F.cos(F.radians(el)) * F.cos(F.radians(az))
    y = 8.4e6 + 1.6e7 * F.cos(F.radians(el)) * F.sin(F.radians(az))
    z = 9.5e6 + 1.6e7 * F.sin(F.radians(el)) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-0.4)
    at = (F.lit(-3957199.0), F.lit(3310205.0), F.lit(3737911.0))
    sats = li.select("l_orderkey", x.alias("sx"), y.alias("sy"), z.alias("sz"), F.col("l_quantity").alias("w"))
    return estimators.wls_positions(sats.withColumn("pr", G.sagnac_range(*at, F.col("sx"), F.col("sy"), F.col("sz")) + 3000.0), ["l_orderkey"])


#: Broadcast ionosphere parameters of a made-up day.
_ALPHA, _BETA = [1.1e-8, 1.5e-8, -6.0e-8, -1.2e-7], [9.6e4, 1.3e5, -6.6e4, -3.3e5]
_SKY = """sky AS (SELECT c_custkey AS k, radians(c_custkey * 37 % 120 - 60) AS lat, radians(c_custkey * 53 % 360 - 180) AS lon, (c_custkey * 13 % 3000)::DOUBLE AS alt,
  radians(c_custkey * 61 % 360) AS az, radians(c_custkey * 7 % 90) AS el, (c_custkey * 977 % 604800)::DOUBLE AS tow FROM customer)"""


def _sky(spark, sf_dir):
    """A receiver, a direction and a time for each customer."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.alias("k"), F.radians(k * 37 % 120 - 60).alias("lat"), F.radians(k * 53 % 360 - 180).alias("lon"), (k * 13 % 3000).cast("double").alias("alt"),
        F.radians(k * 61 % 360).alias("az"), F.radians(k * 7 % 90).alias("el"), (k * 977 % 604800).cast("double").alias("tow"))


@_query(f"""WITH {_SKY}, air AS (SELECT *, 1013.25 * pow(1 - 2.2557e-5 * alt, 5.2568) AS p, 15 - 6.5e-3 * alt AS c, greatest(el, radians(2.0)) AS low FROM sky)
SELECT k, round(0.002277 * (p + (1255 / (c + 273.15) + 0.05) * 0.5 * 6.108 * exp(17.15 * c / (c + 234.7))) / (1 - 0.00266 * cos(2 * lat) - 0.00028 * alt / 1000)
  / sin(sqrt(low * low + 6.25 * radians(1.0) * radians(1.0))), 6) AS delay FROM air""")
def troposphere_delay(spark, sf_dir):
    return _sky(spark, sf_dir).select("k", _r(atmosphere.troposphere(F.col("lat"), F.col("alt"), F.col("el"))).alias("delay"))


@_query(f"""WITH {_SKY}, a AS (SELECT *, 0.0137 / (el / pi() + 0.11) - 0.022 AS psi FROM sky),
b AS (SELECT *, least(greatest(lat / pi() + psi * cos(az), -0.416), 0.416) AS fi FROM a), c AS (SELECT *, lon / pi() + psi * sin(az) / cos(fi * pi()) AS li FROM b),
d AS (SELECT *, fi + 0.064 * cos((li - 1.617) * pi()) AS m, 43200 * li + tow AS s FROM c),
e AS (SELECT *, greatest({_BETA[0]} + {_BETA[1]} * m + {_BETA[2]} * m * m + {_BETA[3]} * m * m * m, 72000) AS per,
  greatest({_ALPHA[0]} + {_ALPHA[1]} * m + {_ALPHA[2]} * m * m + {_ALPHA[3]} * m * m * m, 0) AS amp, s - 86400 * floor(s / 86400) AS t FROM d),
f AS (SELECT *, 2 * pi() * (t - 50400) / per AS x FROM e)
SELECT k, round(299792458.0 * (1 + 16 * pow(0.53 - el / pi(), 3)) * (5e-9 + CASE WHEN abs(x) < 1.57 THEN amp * (1 - x * x / 2 + x * x * x * x / 24) ELSE 0 END), 6) AS delay FROM f""")
def ionosphere_delay(spark, sf_dir):
    c = {n: F.col(n) for n in ("lat", "lon", "az", "el", "tow")}
    return _sky(spark, sf_dir).select("k", _r(atmosphere.ionosphere(_ALPHA, _BETA, **c)).alias("delay"))


@_query("""WITH u AS (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '1980-01-06') AS us FROM events)
SELECT event_id, us // 604800000000 AS week, round((us % 604800000000) / 1e6, 6) AS tow FROM u""")
def gps_week_tow(spark, sf_dir):
    week, tow = signals.gps_week_tow(F.col("ts"))
    return _read(spark, sf_dir, "events").select("event_id", week.alias("week"), _r(tow).alias("tow"))


@_query(f"""WITH {_EV}, c AS (SELECT event_id, user_id, us, value AS l1, value * 0.75 AS l2, value * 0.5 AS p1, value * 0.25 AS p2 FROM ev),
x AS (SELECT *, l1 * (299792458.0 / 1575.42e6) - l2 * (299792458.0 / 1227.60e6) AS gf,
  l1 - l2 - (1575.42e6 * p1 + 1227.60e6 * p2) / (1575.42e6 + 1227.60e6) / (299792458.0 / (1575.42e6 - 1227.60e6)) AS mw FROM c)
SELECT event_id, round(mw, 6) AS ambiguity, coalesce(abs(gf - lag(gf) OVER w) > 0.05, false) AS slip_gf, coalesce(abs(mw - lag(mw) OVER w) > 1.0, false) AS slip_mw,
  coalesce(abs(l1 - lag(l1) OVER w) > 0.5, false) AS slip_td FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def cycle_slips(spark, sf_dir):
    """Three slip tests over each track, its readings standing for phases and ranges."""
    v = F.col("value")
    gf, mw = signals.geometry_free(v, v * 0.75), signals.wide_lane(v, v * 0.75, v * 0.5, v * 0.25)
    rows = _events(spark, sf_dir).select("event_id", "user_id", "us", "value")
    out = slips.jumps_over(rows, ["user_id"], ["us", "event_id"], {"slip_gf": (gf, 0.05), "slip_mw": (mw, 1.0), "slip_td": (v, 0.5)})
    return out.select("event_id", _r(mw).alias("ambiguity"), "slip_gf", "slip_mw", "slip_td")


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount < 0.05 AS los, l_quantity AS cn0, l_partkey % 90 AS el FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN cn0 IS NULL OR el < 15 THEN 'ambiguous' WHEN los AND cn0 < 25 THEN 'missing_building' WHEN NOT los AND cn0 >= 35 THEN 'phantom_building'
  WHEN los AND cn0 >= 35 OR NOT los AND cn0 < 25 THEN 'consistent' ELSE 'ambiguous' END AS label,
  round(0.2 + 0.8 * least(greatest((cn0 - 10.0) / 30.0, 0.0), 1.0), 6) AS scale FROM s""")
def sight_consistency(spark, sf_dir):
    """Sight label and gate scale of each line, its quantity standing for signal strength."""
    cn0 = F.col("l_quantity").cast("double")
    label = signals.sight_label(F.col("l_discount") < 0.05, cn0, F.col("l_partkey") % 90, 35.0, 25.0, 15.0)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), _r(signals.ramp(cn0, 10.0, 40.0, 0.2)).alias("scale"))


@_query("""SELECT l_orderkey, l_suppkey % 8 AS satellite, max_by(l_partkey, struct_pack(a := l_quantity, b := -l_linenumber, c := -l_partkey)) AS l_partkey, max(l_quantity) AS strength
FROM lineitem GROUP BY ALL""")
def strongest_per_satellite(spark, sf_dir):
    """One line for each order and satellite, the strongest; a tie goes to the first line, then to the smallest part."""
    rank = F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))
    li = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 8).alias("satellite"))
    return li.agg(F.max_by("l_partkey", rank).alias("l_partkey"), F.max("l_quantity").alias("strength"))
