"""Gates, rules, budgets and reconciliations over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import orbits, signals
from ..functions import geodesy as G
from ..operators import aggregates, audit, features, gates, sequences, windows
from .queries import _EV, _ORD, _events, _query, _r, _read

_OBS = """o AS (SELECT l_orderkey, l_linenumber, l_quantity AS cn0, l_partkey % 90 AS el, l_linenumber % 3 AS mp, l_extendedprice * 500 AS pr, l_suppkey % 16 AS st, l_partkey % 7 AS const,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END AS rate, l_tax - 0.03 AS adr, l_suppkey % 8 AS ast FROM lineitem)"""


def _observations(spark, sf_dir):
    li, c = _read(spark, sf_dir, "lineitem"), F.col
    return li.select("l_orderkey", "l_linenumber", c("l_quantity").alias("cn0"), (c("l_partkey") % 90).cast("double").alias("el"), (c("l_linenumber") % 3).cast("double").alias("mp"), (c("l_extendedprice") * 500).alias("pr"), (c("l_suppkey") % 16).alias("st"),
                     (c("l_partkey") % 7).alias("const"), F.when(c("l_linenumber") != 5, c("l_discount")).alias("rate"), (c("l_tax") - 0.03).alias("adr"), (c("l_suppkey") % 8).alias("ast"))


@_query(f"""WITH {_OBS}, c AS (SELECT *, cn0 >= 18 AND el >= 10 AND mp <> 1 AS common FROM o)
SELECT l_orderkey, l_linenumber, common AND st & 1 <> 0 AND CASE WHEN const = 3 THEN st & 128 <> 0 ELSE st & 8 <> 0 END AND pr BETWEEN 1e7 AND 4e7 AS p_ok, common AND rate IS NOT NULL AS d_ok, common AND adr <> 0 AND ast & 1 <> 0 AND ast & 6 = 0 AS l_ok FROM c""")
def observation_masks(spark, sf_dir):
    """Which of code, rate and carrier of each row can be used."""
    o = _observations(spark, sf_dir)
    masks = gates.observation_masks(*[F.col(c) for c in ("cn0", "el", "mp", "pr", "st", "const", "rate", "adr", "ast")], 18.0, 10.0)
    return o.select("l_orderkey", "l_linenumber", *[m.alias(n) for n, m in masks.items()])


@_query("SELECT l_orderkey, l_linenumber, l_suppkey & 1 <> 0 AND l_suppkey & 6 = 0 AS usable FROM lineitem")
def carrier_states(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gates.adr_usable(F.col("l_suppkey")).alias("usable"))


@_query("""WITH p AS (SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) * 100 AS m FROM lineitem), a AS (SELECT l_orderkey, median(m) AS med FROM p GROUP BY ALL), b AS (SELECT l_orderkey, any_value(med) AS med, median(abs(m - med)) AS mad FROM p JOIN a USING (l_orderkey) GROUP BY ALL),
k AS (SELECT p.*, m <= least(4.5, greatest(med + 1.5 * mad, 2.0)) AS kept FROM p JOIN b USING (l_orderkey)), e AS (SELECT l_orderkey, count(*) FILTER (WHERE kept) AS n, median(m) FILTER (WHERE kept) AS after FROM k GROUP BY ALL)
SELECT l_orderkey, l_linenumber, kept, n >= 3 AND coalesce(after <= 3.5, false) AS epoch_ok FROM k JOIN e USING (l_orderkey)""")
def pair_gates(spark, sf_dir):
    """Pairs against a threshold from median and deviation, epochs by what is kept."""
    p = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.abs(F.col("l_discount") - 0.05) * 100).alias("m"))
    return gates.pair_gate(p, ["l_orderkey"], "m", 4.5, 2.0, 1.5, 3.5).select("l_orderkey", "l_linenumber", "kept", "epoch_ok")


@_query("""WITH g AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS spread, count(*) FILTER (WHERE value > 40) / count(*)::DOUBLE AS ratio FROM events GROUP BY user_id),
s AS (SELECT *, 0.5 + 0.5 * least(greatest((ratio - 0.15) / 0.6, 0), 1) AS a, 1 + 0.8 * least(greatest((spread - 15) / 20, 0), 1) AS b, 1 + 1.5 * least(greatest((80 - n) / 60.0, 0), 1) AS c FROM g)
SELECT user_id, round(a, 4) AS ess_scale, round(b, 4) AS spread_scale, round(c, 4) AS pair_scale, round(least(a * b * c, 2.0), 4) AS scale FROM s""")
def gate_scales(spark, sf_dir):
    """Ramps of effective size, spread and pair count, and their clipped product."""
    g = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("spread"), (F.count(F.when(F.col("value") > 40, 1)) / F.count("*")).alias("ratio"))
    a, b = signals.ramp(F.col("ratio"), 0.15, 0.75, 0.5, 1.0), signals.ramp(F.col("spread"), 15.0, 35.0, 1.0, 1.8)
    c = signals.ramp(F.col("n").cast("double"), 20.0, 80.0, 2.5, 1.0)
    return g.select("user_id", _r(a, 4).alias("ess_scale"), _r(b, 4).alias("spread_scale"), _r(c, 4).alias("pair_scale"), _r(gates.combined_scale([a, b, c], 2.0), 4).alias("scale"))


@_query("""WITH g AS (SELECT user_id, count(*) AS pairs, count(*) FILTER (WHERE value > 30) / count(*)::DOUBLE AS rate, stddev_pop(value) AS spread, median(value) AS med FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN pairs < 55 THEN 'gate_min_fixed_pairs' WHEN rate < 0.7 THEN 'gate_min_fix_rate' WHEN spread IS NULL THEN 'gate_missing_spread' WHEN spread < 25 THEN 'gate_min_spread' WHEN med > 55 THEN 'gate_epoch_median_residual' ELSE 'ok' END AS reason FROM g""")
def wide_lane_gate(spark, sf_dir):
    """The first test that an epoch fails."""
    g = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("pairs"), (F.count(F.when(F.col("value") > 30, 1)) / F.count("*")).alias("rate"), F.stddev_pop("value").alias("spread"), F.percentile("value", F.lit(0.5)).alias("med"))
    c = F.col
    checks = [(c("pairs") >= 55, "gate_min_fixed_pairs"), (c("rate") >= 0.7, "gate_min_fix_rate"), (c("spread").isNotNull(), "gate_missing_spread"), (c("spread") >= 25, "gate_min_spread"), (c("med") <= 55, "gate_epoch_median_residual")]
    return g.select("user_id", gates.first_failing(checks).alias("reason"))


@_query("""WITH g AS (SELECT l_orderkey, count(*) - 2 AS extra, quantile_cont(l_discount * 1000, 0.95) AS p95, max(l_discount * 1000) AS most, max(l_tax) * 1000 - min(l_tax) * 1000 AS b, avg(l_extendedprice) AS multi, max(l_extendedprice) AS ref FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, extra >= 2 AND p95 <= 89.5 AND most <= 94.5 AND b <= 59.5 AS use_multi, round(CASE WHEN extra >= 2 AND p95 <= 89.5 AND most <= 94.5 AND b <= 59.5 THEN multi ELSE ref END, 6) AS solution FROM g""")
def quality_veto(spark, sf_dir):
    """The solution of all systems where it clears the veto, else that of the first one."""
    c = F.col
    g = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") - 2).alias("extra"), F.percentile(c("l_discount") * 1000, F.lit(0.95)).alias("p95"), F.max(c("l_discount") * 1000).alias("most"), (F.max("l_tax") * 1000 - F.min("l_tax") * 1000).alias("b"),
                                                                   F.avg("l_extendedprice").alias("multi"), F.max("l_extendedprice").alias("ref"))
    use = gates.accept_multi(c("extra"), c("p95"), c("most"), c("b"), 2, 89.5, 94.5, 59.5)
    return g.select("l_orderkey", use.alias("use_multi"), _r(F.when(use, c("multi")).otherwise(c("ref"))).alias("solution"))


@_query(f"WITH {_EV} SELECT event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id)) > CASE WHEN user_id % 3 = 0 THEN 10 ELSE 50 END, false) AS jump FROM ev")
def phone_clock_jumps(spark, sf_dir):
    """Clock jumps with a limit of each phone's own."""
    ev = _events(spark, sf_dir).withColumn("limit", F.when(F.col("user_id") % 3 == 0, 10.0).otherwise(50.0))
    return windows.jumps(ev, ["user_id", "event_type"], ["us", "event_id"], "value", F.col("limit")).select("event_id", "jump")


@_query("""SELECT l.l_orderkey, l.l_linenumber, CASE WHEN b.o_orderkey IS NOT NULL THEN 0.0 ELSE l_quantity END AS weight FROM lineitem l LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice > 300000) b ON b.o_orderkey = l.l_orderkey""")
def diagnostics_mask(spark, sf_dir):
    """Weights set to zero where a table of diagnostics says so."""
    bad = _read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("weight"))
    return gates.zero_listed(rows, bad, ["l_orderkey"], ["weight"])


@_query("""WITH s AS (SELECT user_id, event_type, value, sum(1 + event_id % 3) AS w FROM events GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY user_id, event_type ORDER BY value) AS run, sum(w) OVER (PARTITION BY user_id, event_type) AS total FROM s),
m AS (SELECT user_id, event_type, min(value) AS clock FROM c WHERE run * 2 >= total GROUP BY ALL)
SELECT event_id, abs(value - clock) > 60 AS rejected, (CASE WHEN abs(value - clock) > 60 THEN 0.0 ELSE 1.0 + event_id % 3 END)::DOUBLE AS w FROM events JOIN m USING (user_id, event_type)""")
def residual_outliers(spark, sf_dir):
    """Residuals far from the weighted median clock of their epoch and group."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (1.0 + F.col("event_id") % 3).alias("w"))
    return gates.residual_outliers(rows, ["user_id"], "event_type", "value", "w", 60.0).select("event_id", "rejected", "w")


@_query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F'), o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderdate::VARCHAR AS day, o_orderkey, o_orderstatus FROM f WHERE k = 1""")
def first_with_fallback(spark, sf_dir):
    """The first row among the preferred ones, else the first of all."""
    o = _read(spark, sf_dir, "orders")
    out = aggregates.first_preferred(o, ["o_custkey"], F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey", "o_orderstatus"])
    return out.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"), "o_orderkey", "o_orderstatus")


@_query(f"""WITH g AS (SELECT c_custkey, c_nationkey, radians((c_custkey * 37 % 17000) / 100.0 - 85) AS lat, radians((c_custkey * 53 % 36000) / 100.0 - 180) AS lon FROM customer), e AS (SELECT *, c_custkey % 19 - 9.0 AS de, c_custkey % 23 - 11.0 AS dn, c_custkey % 7 - 3.0 AS du FROM g),
d AS (SELECT c_nationkey, sqrt(de * de + dn * dn) AS d2, sqrt(de * de + dn * dn + du * du) AS d3 FROM e)
SELECT c_nationkey, count(*) AS n, round(sqrt(avg(d2 * d2)), 4) AS rms_2d, round(sqrt(avg(d3 * d3)), 4) AS rms_3d, round(avg(d2), 4) AS mean_2d, round(stddev_pop(d2), 4) AS std_2d, round(quantile_cont(d2, 0.5), 4) AS p50, round(quantile_cont(d2, 0.67), 4) AS p67, round(quantile_cont(d2, 0.95), 4) AS p95, round(max(d2), 4) AS max_2d FROM d GROUP BY c_nationkey""")
def position_error_metrics(spark, sf_dir):
    """Errors of positions displaced by known offsets, found again from ECEF."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    lat, lon = F.radians((k * 37 % 17000) / 100.0 - 85), F.radians((k * 53 % 36000) / 100.0 - 180)
    truth = G.lla_to_ecef(lat, lon, F.lit(0.0))
    moved = G.enu_to_ecef(k % 19 - 9.0, k % 23 - 11.0, k % 7 - 3.0, lat, lon)
    m = audit.position_errors(c, ["c_nationkey"], [a + b for a, b in zip(truth, moved)], list(truth))
    return m.select("c_nationkey", "n", *[_r(x, 4).alias(x) for x in ("rms_2d", "rms_3d", "mean_2d", "std_2d", "p50", "p67", "p95", "max_2d")])


@_query("""WITH w AS (SELECT o_custkey % 5 AS run, o_totalprice / 5000 AS p, o_custkey % 100 AS a, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey % 7 + 1 END AS c FROM orders), f AS (SELECT *, CASE WHEN c > 0 THEN c ELSE 1 END AS w FROM w)
SELECT run, round(sum(w * abs(p - a)) / sum(w), 6) AS mae, round(sqrt(sum(w * (p - a) ^ 2) / sum(w)), 6) AS rmse, round(corr(p, a), 6) AS corr, count(*) FILTER (WHERE abs(p - a) > 20) AS over FROM f GROUP BY run""")
def weighted_scores(spark, sf_dir):
    c = F.col
    w = _read(spark, sf_dir, "orders").select((c("o_custkey") % 5).alias("run"), (c("o_totalprice") / 5000).alias("p"), (c("o_custkey") % 100).cast("double").alias("a"), F.when(c("o_orderkey") % 10 == 0, -1.0).otherwise(c("o_orderkey") % 7 + 1.0).alias("c"))
    return audit.weighted_scores(w, ["run"], "p", "a", "c").select("run", _r("mae").alias("mae"), _r("rmse").alias("rmse"), _r("corr").alias("corr"), "over")


@_query("""WITH e AS (SELECT event_id, user_id, event_id % 3000 / 10.0 AS s FROM events), w AS (SELECT c_custkey AS user_id, unnest(range(8)) AS i FROM customer)
SELECT event_id, floor(s / 30)::BIGINT AS window_index, CASE WHEN w.i IS NOT NULL THEN (w.user_id * 13 + w.i * 7) % 100 END AS rate FROM e LEFT JOIN w ON w.user_id = e.user_id AND w.i = floor(s / 30)""")
def window_expansion(spark, sf_dir):
    """Epochs with the rate of their 30-second window."""
    e, w = _epochs_and_windows(spark, sf_dir)
    return audit.expand_windows(e, w, ["user_id"], "s", "window_index", "rate").select("event_id", "window_index", "rate")


def _epochs_and_windows(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("event_id") % 3000 / 10.0).alias("s"))
    w = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("window_index"))
    return e, w.withColumn("rate", (F.col("user_id") * 13 + F.col("window_index") * 7) % 100)


@_query("""WITH e AS (SELECT event_id, user_id, value, floor(event_id % 3000 / 10.0 / 30)::BIGINT AS i FROM events), w AS (SELECT *, (user_id * 13 + i * 7) % 100 AS rate FROM e WHERE i < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id, i) AS n FROM w)
SELECT event_id, k <= round_even(rate / 100.0 * n, 0) AS chosen FROM r""")
def budgeted_epochs(spark, sf_dir):
    """The likeliest epochs of each window, as many as its rate allows."""
    e, w = _epochs_and_windows(spark, sf_dir)
    met = audit.expand_windows(e, w, ["user_id"], "s", "window_index", "rate").where("rate is not null")
    return audit.budgeted_top(met, ["user_id", "window_index"], "rate", "value", ["event_id"]).select("event_id", "chosen")


@_query("""WITH r AS (SELECT l_shipmode AS m, p, a FROM (SELECT l_returnflag AS l_shipmode, l_quantity > 25 AS p, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice > 40000 END AS a FROM lineitem) WHERE a IS NOT NULL)
SELECT m AS l_returnflag, count(*) AS n, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, round(count(*) FILTER (WHERE p = a) / count(*), 6) AS match_rate FROM r GROUP BY m""")
def confusion_counts(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    c = audit.confusion(li, ["l_returnflag"], F.col("l_quantity") > 25, F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") > 40000))
    return c.select("l_returnflag", "n", "tp", "tn", "fp", "fn", _r("match_rate").alias("match_rate"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 40 AND l_discount <= 0.02 AND l_tax >= 0.04")
def rule_predicate(spark, sf_dir):
    """Rows that fulfil a conjunction of conditions."""
    picked = audit.rule([("l_quantity", ">=", 40.0), ("l_discount", "<=", 0.02), ("l_tax", ">=", 0.04)])
    return _read(spark, sf_dir, "lineitem").where(picked).select("l_orderkey", "l_linenumber")


_GAINS = "x AS (SELECT l_suppkey % 6 AS trip, l_quantity AS q, l_discount * 100 AS d, (l_partkey % 21 - 10) / 4.0 AS gain FROM lineitem)"


def _gains(spark, sf_dir):
    c = F.col
    return _read(spark, sf_dir, "lineitem").select((c("l_suppkey") % 6).alias("trip"), c("l_quantity").alias("q"), (c("l_discount") * 100).alias("d"), ((c("l_partkey") % 21 - 10) / 4.0).alias("gain"))


@_query(f"""WITH {_GAINS}, p AS (SELECT trip, sum(CASE WHEN q >= 30 THEN gain ELSE 0 END) AS v, count(*) FILTER (WHERE q >= 30) AS s, count(*) FILTER (WHERE q >= 30 AND gain > 0) AS tp, count(*) FILTER (WHERE q >= 30 AND NOT gain > 0) AS fp, count(*) FILTER (WHERE q < 30 AND gain > 0) AS fn FROM x GROUP BY trip)
SELECT round(sum(v), 4) AS gain, sum(s)::BIGINT AS selected, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(min((SELECT sum(v) FROM p) - v), 4) AS loo_min, round(avg((SELECT sum(v) FROM p) - v), 4) AS loo_mean FROM p""")
def rule_evaluation(spark, sf_dir):
    """Gain of a rule, and the least and mean gain when one trip is left out."""
    out = audit.rule_gain(_gains(spark, sf_dir), audit.rule([("q", ">=", 30.0)]), "gain", F.col("gain") > 0, "trip")
    return out.select(_r("gain", 4).alias("gain"), "selected", "tp", "fp", "fn", _r("loo_min", 4).alias("loo_min"), _r("loo_mean", 4).alias("loo_mean"))


@_query(f"""WITH {_GAINS}, c(feature, threshold) AS (VALUES ('q', 10.0), ('q', 25.0), ('q', 40.0), ('d', 2.5), ('d', 5.5), ('d', 8.5)), o(op) AS (VALUES ('<='), ('>=')),
s AS (SELECT feature, op, threshold, trip, gain FROM x, c, o WHERE CASE WHEN op = '<=' THEN CASE feature WHEN 'q' THEN q ELSE d END <= threshold ELSE CASE feature WHEN 'q' THEN q ELSE d END >= threshold END),
t AS (SELECT feature, op, threshold, trip, sum(gain) AS v, count(*) FILTER (WHERE gain > 0) AS tp, count(*) FILTER (WHERE NOT gain > 0) AS fp FROM s GROUP BY ALL), g AS (SELECT count(DISTINCT trip) AS g FROM x)
SELECT feature, op, threshold::DOUBLE AS threshold, round(sum(v), 4) AS gain, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, round(sum(v) - CASE WHEN count(*) < any_value(g) THEN greatest(max(v), 0) ELSE max(v) END, 4) AS loo_min, round(sum(v) * (1 - 1.0 / any_value(g)), 4) AS loo_mean FROM t, g GROUP BY feature, op, threshold""")
def rule_search(spark, sf_dir):
    """All rules over cut points, in one pass."""
    out = audit.rule_search(_gains(spark, sf_dir), {"q": [10.0, 25.0, 40.0], "d": [2.5, 5.5, 8.5]}, "gain", F.col("gain") > 0, "trip")
    return out.select("feature", "op", "threshold", _r("gain", 4).alias("gain"), "tp", "fp", _r("loo_min", 4).alias("loo_min"), _r("loo_mean", 4).alias("loo_mean"))


@_query(f"""WITH {_EV}, e AS (SELECT user_id, value, row_number() OVER ({_ORD}) - 1 AS k FROM ev), c AS (SELECT DISTINCT c_custkey AS user_id, c_custkey * 3 % 20 AS lo FROM customer WHERE c_acctbal > 3000),
x AS (SELECT e.user_id, CASE WHEN c.lo IS NOT NULL THEN value * 0.5 ELSE value END AS error FROM e LEFT JOIN c ON c.user_id = e.user_id AND k BETWEEN lo AND lo + 14)
SELECT user_id, round(0.5 * (quantile_cont(error, 0.5) + quantile_cont(error, 0.95)), 6) AS score FROM x GROUP BY user_id""")
def rule_replay(spark, sf_dir):
    """Scores of tracks with another source inside the chosen chunks."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, sf_dir).select("user_id", F.col("value").alias("base"), (F.col("value") * 0.5).alias("other"), (F.row_number().over(w) - 1).cast("long").alias("k"))
    lo = F.col("c_custkey") * 3 % 20
    chunks = _read(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("user_id"), lo.alias("start"), (lo + 14).alias("end"))
    m = aggregates.error_metrics(audit.replay(e, chunks, ["user_id"], "k", "base", "other"), ["user_id"], "error")
    return m.select("user_id", _r((F.col("p50") + F.col("p95")) * 0.5).alias("score"))


@_query("""WITH c AS (SELECT l_suppkey % 50 AS sat, CASE WHEN l_linenumber % 3 = 0 THEN 'L5' ELSE 'L1' END AS freq, l_quantity > 10 AS p, l_discount > 0.02 AS d, l_tax > 0.04 AS l FROM lineitem)
SELECT freq, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE d) AS d, count(*) FILTER (WHERE l) AS l, count(*) FILTER (WHERE p) = count(*) FILTER (WHERE d) AS parity FROM c GROUP BY freq""")
def factor_counts(spark, sf_dir):
    """Usable codes, rates and carriers by frequency, and whether the first two agree."""
    c = F.col
    rows = _read(spark, sf_dir, "lineitem").select(orbits.signal_band(F.when(c("l_linenumber") % 3 == 0, "GPS_L5").otherwise("GPS_L1")).alias("freq"), F.array(F.when(c("l_quantity") > 10, "p"), F.when(c("l_discount") > 0.02, "d"), F.when(c("l_tax") > 0.04, "l")).alias("f"))
    out = rows.select("freq", F.explode("f").alias("field")).where("field is not null").groupBy("freq").pivot("field", ["p", "d", "l"]).count()
    return out.withColumn("parity", c("p") == c("d"))


@_query("""WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS v FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL), b AS (SELECT l_orderkey, sum(l_quantity) * 1.01 AS q, sum(l_extendedprice) + 5 AS v FROM lineitem WHERE l_quantity > 12 GROUP BY ALL),
j AS (SELECT a.l_orderkey AS ka, b.l_orderkey AS kb, abs(a.q - b.q) AS dq, abs(a.v - b.v) AS dv FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey), u AS (SELECT ka, kb, 'q' AS c, dq AS d FROM j UNION ALL SELECT ka, kb, 'v', dv FROM j)
SELECT c AS field, count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) AS matched, count(*) FILTER (WHERE kb IS NULL) AS left_only, count(*) FILTER (WHERE ka IS NULL) AS right_only, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.95), 4) AS p95, round(max(d), 4) AS max FROM u GROUP BY c""")
def value_deltas(spark, sf_dir):
    """Two versions of a table, column by column."""
    li, s = _read(spark, sf_dir, "lineitem"), F.sum
    a = li.where("l_linenumber < 6").groupBy("l_orderkey").agg(s("l_quantity").alias("q"), s("l_extendedprice").alias("v"))
    b = li.where("l_quantity > 12").groupBy("l_orderkey").agg((s("l_quantity") * 1.01).alias("q"), (s("l_extendedprice") + 5).alias("v"))
    return audit.value_deltas(a, b, ["l_orderkey"], ["q", "v"]).select("field", "matched", "left_only", "right_only", *[_r(c, 4).alias(c) for c in ("mean", "p95", "max")])


@_query("""WITH m AS (SELECT user_id, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean, event_type) AS k FROM m) SELECT user_id, event_type, round(mean, 6) AS mean, n FROM k WHERE k = 1""")
def chunk_diagnostics(spark, sf_dir):
    """The best source of each chunk by mean error."""
    return audit.best_source(_read(spark, sf_dir, "events"), ["user_id"], "event_type", "value").select("user_id", "event_type", _r("mean").alias("mean"), "n")


@_query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type < 'p' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type < 's' GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS n_left, b.n AS n_right, CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' ELSE 'count' END AS problem FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n""")
def reconciliation(spark, sf_dir):
    """Keys and counts in which two inputs differ."""
    side = lambda to: _read(spark, sf_dir, "events").where(F.col("event_type") < to).groupBy("user_id").agg(F.count("*").alias("n"))
    return audit.reconcile(side("p"), side("s"), ["user_id"], "n")


@_query(f"""WITH {_EV}, m AS (SELECT user_id, min(us) AS lo FROM ev GROUP BY user_id), w AS (SELECT ev.user_id, event_id, us, value, (us - lo) // 604800000000 AS i FROM ev JOIN m USING (user_id)), d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, i ORDER BY us, event_id) AS d FROM w),
s AS (SELECT *, sign(d) <> lag(sign(d)) OVER (PARTITION BY user_id, i ORDER BY us, event_id) AS c FROM d)
SELECT user_id, i AS window_index, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.9), 6) AS value_p90, max(value) AS value_max,
  round(coalesce(avg(d), 0), 6) AS value_delta_mean, round(coalesce(stddev_pop(d), 0), 6) AS value_delta_std, count(*) FILTER (WHERE d < 0) AS value_delta_neg_count, count(*) FILTER (WHERE d > 0) AS value_delta_pos_count, count(*) FILTER (WHERE c) AS value_delta_sign_change_count FROM s GROUP BY user_id, i""")
def window_features(spark, sf_dir):
    """Statistics of values and of their steps in windows of a week from the first epoch."""
    out = features.window_statistics(_events(spark, sf_dir), ["user_id"], "us", ["event_id"], ["value"], 604_800_000_000)
    names = ["value_mean", "value_std", "value_p10", "value_p50", "value_p90", "value_delta_mean", "value_delta_std"]
    return out.select("user_id", "window_index", "n", *[_r(c).alias(c) for c in names], "value_max", "value_delta_neg_count", "value_delta_pos_count", "value_delta_sign_change_count")


_READY = """r AS (SELECT o_orderkey, o_totalprice / 5000 AS base, o_custkey % 3 = 0 AS reject, o_custkey % 4 = 0 AS lift, o_custkey % 11 / 10.0 AS hold, o_custkey % 7 / 10.0 AS strict, o_custkey % 13 / 2.0 AS carry, o_orderkey % 9 / 10.0 AS pass, o_orderkey % 5 / 10.0 AS rej FROM orders)"""


def _ready(spark, sf_dir):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("base"), (c % 3 == 0).alias("reject"), (c % 4 == 0).alias("lift"), (c % 11 / 10.0).alias("hold"), (c % 7 / 10.0).alias("strict"), (c % 13 / 2.0).alias("carry"), (k % 9 / 10.0).alias("pass"), (k % 5 / 10.0).alias("rej"))


@_query(f"WITH {_READY} SELECT o_orderkey, round(CASE WHEN reject THEN least(base, 5.0) WHEN lift THEN greatest(base, least(95.0, 20 + 70 * hold + 20 * strict + 2 * least(carry, 5.0))) ELSE base END, 6) AS rate, CASE WHEN reject THEN 'high_pred_reject' WHEN lift THEN 'low_pred_hold_lift' ELSE 'base' END AS reason FROM r")
def diagnostic_prediction(spark, sf_dir):
    """Rates cut down where validation rejects, and lifted where it holds."""
    rate, reason = features.diagnostic_rate(*[F.col(x) for x in ("base", "reject", "lift", "hold", "strict", "carry")])
    return _ready(spark, sf_dir).select("o_orderkey", _r(rate).alias("rate"), reason.alias("reason"))


@_query(f"WITH {_READY} SELECT o_orderkey, round(strict * pass * (1 - least(greatest(rej, 0), 1)), 6) AS readiness_net, round(strict * carry, 6) AS readiness_carry, round(pass - rej - hold, 6) + 0.0 AS validation_clean, round(base * (1 - strict), 6) AS jump_risk FROM r")
def compound_features(spark, sf_dir):
    f = features.compounds(strict=F.col("strict"), ready_pass=F.col("pass"), reject=F.col("rej"), spike=F.col("hold"), carry=F.col("carry"), jumps=F.col("base"))
    return _ready(spark, sf_dir).select("o_orderkey", *[(_r(c) + 0.0).alias(n) for n, c in f.items()])


@_query(f"WITH {_READY} SELECT o_orderkey, (base >= 30)::INT AS ratio_high, (base >= 30 OR carry >= 5)::INT AS ratio_or_carry, (base < 20 AND carry < 3)::INT AS quiet FROM r")
def transition_targets(spark, sf_dir):
    """Binary labels from threshold predicates."""
    b, c = F.col("base"), F.col("carry")
    return features.targets(_ready(spark, sf_dir), {"ratio_high": b >= 30, "ratio_or_carry": (b >= 30) | (c >= 5), "quiet": (b < 20) & (c < 3)}).select("o_orderkey", "ratio_high", "ratio_or_carry", "quiet")


@_query("""WITH r AS (SELECT event_id, user_id % 5 AS run, value AS x, CASE WHEN value > 30 THEN 1 ELSE 0 END AS y FROM events), t AS (SELECT run, count(*) AS n, sum(y) AS s FROM r GROUP BY run)
SELECT event_id, r.run, round((SELECT sum(s) FROM t t2 WHERE t2.run <> r.run) / (SELECT sum(n) FROM t t2 WHERE t2.run <> r.run), 6) AS prior FROM r""")
def leave_one_run_out(spark, sf_dir):
    """The rate of label 1 over all other runs, as the fold's model without features."""
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("run"), (F.col("value") > 30).cast("int").alias("y"))
    return features.out_of_fold_rate(rows, "run", "y").select("event_id", "run", _r("prior").alias("prior"))


@_query("""SELECT event_id, CASE WHEN value > 60 THEN 0.0 ELSE coalesce(value, 0) END AS value, CASE WHEN user_id % 9 = 0 THEN 0.0 ELSE user_id::DOUBLE END AS track FROM events""")
def curated_features(spark, sf_dir):
    """Allowed columns, with what is not finite set to a neutral value."""
    bad = F.when(F.col("value") > 60, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = _read(spark, sf_dir, "events").select("event_id", bad.alias("value"), F.when(F.col("user_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double")).alias("track"), F.lit(1).alias("leak"))
    return features.curate(rows, ["event_id"], ["value", "track"], 0.0)


@_query("""WITH s AS (SELECT event_type AS strategy, user_id % 4 AS split, value FROM events) SELECT strategy, split, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - avg(avg(value)) OVER (PARTITION BY split), 6) AS against_split FROM s GROUP BY strategy, split""")
def family_validation(spark, sf_dir):
    """Metrics by strategy and split, and against the mean of the split's strategies."""
    m = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy"), (F.col("user_id") % 4).alias("split")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return m.select("strategy", "split", "n", _r("m").alias("mean"), _r(F.col("m") - F.avg("m").over(Window.partitionBy("split"))).alias("against_split"))


@_query("""WITH p AS (SELECT o_custkey AS epoch, o_totalprice AS v FROM orders), q AS (SELECT epoch, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS spread, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM p GROUP BY epoch)
SELECT epoch, n, round(mean, 6) AS mean, round(spread, 4) AS spread, round(lo, 6) AS lo, round(hi, 6) AS hi, 150000 BETWEEN lo AND hi AS covers FROM q""")
def posterior_intervals(spark, sf_dir):
    """Spread and 95 % interval of each cloud, and whether it covers the truth."""
    p = lambda q: F.percentile("o_totalprice", F.lit(q))
    q = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("epoch")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("spread"), p(0.025).alias("lo"), p(0.975).alias("hi"))
    return q.select("epoch", "n", _r("mean").alias("mean"), _r("spread", 4).alias("spread"), _r("lo").alias("lo"), _r("hi").alias("hi"), F.lit(150000.0).between(F.col("lo"), F.col("hi")).alias("covers"))


@_query("""SELECT user_id, event_type, NULL::DOUBLE AS score, value FROM events WHERE value > 60 UNION ALL SELECT c_custkey, NULL, c_acctbal, NULL FROM customer""")
def union_with_missing(spark, sf_dir):
    """Frames of different columns on top of each other."""
    a = _read(spark, sf_dir, "events").where("value > 60").select("user_id", "event_type", "value")
    b = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("score"))
    return a.unionByName(b, allowMissingColumns=True)


@_query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@_query("""SELECT o_orderkey, l.n, l.q FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey WHERE o_totalprice > 100000""")
def adopted_pool(spark, sf_dir):
    """Rows of a pool that were adopted."""
    a = _read(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return _read(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey").join(a, "o_orderkey")


@_query(f"""WITH {_EV}, c AS (SELECT user_id, us // 604800000000 AS chunk, value, us, event_id FROM ev), d AS (SELECT *, abs(value - lag(value) OVER w) AS s, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) AS a, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY user_id, chunk ORDER BY us, event_id)),
m AS (SELECT user_id, chunk, avg(value * value) AS mse, coalesce(avg(s), 0) AS sm, coalesce(quantile_cont(s, 0.95), 0) AS sp, coalesce(quantile_cont(a, 0.95), 0) AS ap FROM d GROUP BY ALL), b AS (SELECT chunk, avg(mse) AS mse, avg(sm) AS sm, avg(sp) AS sp, avg(ap) AS ap FROM m GROUP BY chunk)
SELECT m.user_id, m.chunk, round(0.4 * m.mse / greatest(b.mse, 10) + 0.1 * m.sm / greatest(b.sm, 0.25) + 0.1 * m.sp / greatest(b.sp, 0.5) + 0.1 * m.ap / greatest(b.ap, 0.5), 6) AS quality FROM m JOIN b USING (chunk)""")
def chunk_quality(spark, sf_dir):
    """Weighted ratios of a chunk's metrics to those of its baseline (the mean of all tracks here)."""
    ev = _events(spark, sf_dir).withColumn("chunk", F.expr("us div 604800000000"))
    motion = sequences.motion_stats(ev, ["user_id", "chunk"], ["us", "event_id"], ["value"])
    m = ev.groupBy("user_id", "chunk").agg(F.avg(F.col("value") * F.col("value")).alias("mse")).join(motion, ["user_id", "chunk"])
    base = m.groupBy("chunk").agg(*[F.avg(c).alias(f"b_{c}") for c in ("mse", "step_mean", "step_p95", "accel_p95")])
    return m.join(base, "chunk").select("user_id", "chunk", _r(features.chunk_quality()).alias("quality"))


@_query(f"""WITH {_EV}, f AS (SELECT *, value > 45 AS f FROM ev), g AS (SELECT *, row_number() OVER ({_ORD}) - row_number() OVER (PARTITION BY user_id, f ORDER BY us, event_id) AS g FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, f, g ORDER BY us, event_id) AS k FROM g), t AS (SELECT *, CASE WHEN f AND k = 2 THEN 1 WHEN NOT f AND k = 3 THEN 0 END AS turn FROM k)
SELECT event_id, coalesce(last_value(turn IGNORE NULLS) OVER ({_ORD} ROWS UNBOUNDED PRECEDING) = 1, false) AS active FROM t""")
def hysteresis_gate(spark, sf_dir):
    """Blocked after two candidates in a row, free again after three clear epochs."""
    return gates.hysteresis(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("value") > 45, 2, 3).select("event_id", "active")


@_query("""SELECT o_orderkey, coalesce(o_custkey % 10 BETWEEN 1 AND 4 AND o_totalprice <= 150000 AND o_orderkey % 7 <= 3, false) OR coalesce(o_custkey % 10 <= 2 AND o_orderkey % 5 >= 3 AND o_totalprice >= 300000, false) AS candidate FROM orders""")
def veto_candidates(spark, sf_dir):
    x = {"blocked": F.col("o_custkey") % 10, "positive": F.col("o_orderkey") % 5, "disagreement": F.col("o_totalprice"), "residual": F.col("o_orderkey") % 7}
    flag = gates.veto_modes(x, {"low": 1, "high": 4, "most": 150000, "residual": 3}, {"blocked": 2, "positive": 3, "least": 300000})
    return _read(spark, sf_dir, "orders").select("o_orderkey", flag.alias("candidate"))


@_query(f"""WITH {_EV}, a AS (SELECT *, event_id % 8 & 1 <> 0 AND event_id % 8 & 6 = 0 OR event_id % 3 = 0 AS ok, lead(value) OVER w - value AS step, lead(t) OVER w - t AS dt FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
b AS (SELECT *, ok AND coalesce(lead(ok) OVER w, false) AND coalesce(dt > 0, false) AND coalesce(abs(step + 0.5 * (value * 0.001 + lead(value) OVER w * 0.001) * 60) > 50, false) AS bad FROM a WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
c AS (SELECT *, ok AND NOT bad AND NOT coalesce(lag(bad) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id), false) AS fine FROM b),
d AS (SELECT *, fine AND coalesce(lead(fine) OVER w, false) AND coalesce(dt > 0, false) AS live, event_id % 4 / 100.0 AS u0, lead(event_id % 4 / 100.0) OVER w AS u1 FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))
SELECT event_id, round(CASE WHEN live THEN step ELSE 0 END, 6) AS step, round(CASE WHEN live THEN 1 / greatest(CASE WHEN u0 > 0 AND u1 > 0 THEN sqrt(u0 * u0 + u1 * u1) ELSE 0.02 END, 1e-3) ^ 2 ELSE 0 END, 4) AS weight FROM d""")
def carrier_steps(spark, sf_dir):
    """Carrier differences with weights; a step against the rates spoils both of its ends."""
    s = F.col("event_id") % 8
    usable = gates.adr_usable(s) | (F.col("event_id") % 3 == 0)
    ev = _events(spark, sf_dir).withColumns({"rate": F.col("value") * 0.001, "u": F.col("event_id") % 4 / 100.0})
    out = gates.carrier_steps(ev, ["user_id", "event_type"], ["us", "event_id"], "t", "value", usable, "rate", "u", F.lit(60.0), 50.0)
    return out.select("event_id", _r("step").alias("step"), _r("weight", 4).alias("weight"))
