"""Solvers, particles and joins of satellites over the driver's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..operators import aggregates, estimators, joins, particles
from .queries import _events, _query, _r, _read

_LINES = """s AS (SELECT l_orderkey, l_linenumber, radians(l_partkey * 61 % 360) AS az, radians(l_suppkey * 29 % 70 + 15) AS el, l_quantity AS q, l_extendedprice / 1000 AS d, 1.0 / l_linenumber AS w FROM lineitem),
h AS (SELECT *, cos(el) * cos(az) AS lx, cos(el) * sin(az) AS ly, sin(el) AS lz FROM s)"""


def _det(m: list[list[str]]) -> str:
    """Text of a determinant, by the first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {m[0][j]} * {_det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"


_A = [[f"a{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_SUMS = ", ".join(f"sum(w * h{i} * h{j}) AS a{i}{j}" for i in range(4) for j in range(i, 4))


def _cramer(k: int) -> str:
    return _det([[f"b{i}" if j == k else _A[i][j] for j in range(4)] for i in range(4)]) + " / det"


@_query(f"""WITH {_LINES}, m AS (SELECT l_orderkey, w, -lx AS h0, -ly AS h1, -lz AS h2, 1.0::DOUBLE AS h3, d * 0.19 - (q * lx - 10 * l_linenumber * ly + 5 * lz) AS y FROM h),
n AS (SELECT l_orderkey, count(*) AS n, {_SUMS}, {', '.join(f'sum(w * h{i} * y) AS b{i}' for i in range(4))} FROM m GROUP BY l_orderkey HAVING count(*) >= 6), t AS (SELECT *, {_det(_A)} AS det FROM n)
SELECT l_orderkey, n, {', '.join(f'round({_cramer(k)}, 3) AS {c}' for k, c in enumerate(('vx', 'vy', 'vz', 'drift')))} FROM t WHERE det > 1e-3""")
def doppler_velocities(spark, sf_dir):
    """Velocity and clock drift of each order's epoch from made-up Doppler shifts."""
    li = _read(spark, sf_dir, "lineitem")
    az, el = F.radians(F.col("l_partkey") * 61 % 360), F.radians(F.col("l_suppkey") * 29 % 70 + 15)
    sats = li.select("l_orderkey", (F.cos(el) * F.cos(az)).alias("sx"), (F.cos(el) * F.sin(az)).alias("sy"), F.sin(el).alias("sz"), F.col("l_quantity").alias("svx"), (-10.0 * F.col("l_linenumber")).alias("svy"), F.lit(5.0).alias("svz"),
                     (F.col("l_extendedprice") / 1000).alias("doppler"), (1.0 / F.col("l_linenumber")).alias("w"))
    out = estimators.doppler_velocity(sats, ["l_orderkey"], [F.lit(0.0)] * 3, 0.19, 6)
    good = sats.groupBy("l_orderkey").agg(*estimators.normal_sums([-F.col("sx"), -F.col("sy"), -F.col("sz"), F.lit(1.0)], F.lit(0.0), F.col("w")))
    det = F.expr(_det(_A))
    return out.join(good.where(det > 1e-3).select("l_orderkey"), "l_orderkey").select("l_orderkey", "n", *[_r(c, 3).alias(c) for c in ("vx", "vy", "vz", "drift")])


_MINOR = [[_A[i][j] for j in range(4)] for i in range(4)]


def _inverse_diagonal(k: int) -> str:
    return _det([[_A[i][j] for j in range(4) if j != k] for i in range(4) if i != k]) + " / det"


@_query(f"""WITH {_LINES}, m AS (SELECT l_orderkey, 1.0::DOUBLE AS w, cos(el) * sin(az) AS h0, cos(el) * cos(az) AS h1, sin(el) AS h2, 1.0::DOUBLE AS h3 FROM h),
n AS (SELECT l_orderkey, count(*) AS n, {_SUMS} FROM m GROUP BY l_orderkey HAVING count(*) >= 5), t AS (SELECT *, {_det(_A)} AS det FROM n), q AS (SELECT l_orderkey, n, {', '.join(f'{_inverse_diagonal(k)} AS q{k}' for k in range(4))} FROM t WHERE det > 1e-2)
SELECT l_orderkey, n, round(sqrt(q0 + q1 + q2 + q3), 4) AS gdop, round(sqrt(q0 + q1 + q2), 4) AS pdop, round(sqrt(q0 + q1), 4) AS hdop, round(sqrt(q2), 4) AS vdop FROM q""")
def dilution_of_precision(spark, sf_dir):
    """DOP of each order's satellites."""
    li = _read(spark, sf_dir, "lineitem")
    az, el = F.radians(F.col("l_partkey") * 61 % 360), F.radians(F.col("l_suppkey") * 29 % 70 + 15)
    sats = li.select("l_orderkey", az.alias("az"), el.alias("el"))
    h = [F.cos("el") * F.sin("az"), F.cos("el") * F.cos("az"), F.sin("el"), F.lit(1.0)]
    good = sats.groupBy("l_orderkey").agg(F.count("*").alias("m"), *estimators.normal_sums(h, F.lit(0.0), F.lit(1.0))).where("m >= 5").where(F.expr(_det(_A)) > 1e-2)
    return estimators.dilution(sats, ["l_orderkey"], "az", "el").join(good.select("l_orderkey"), "l_orderkey").select("l_orderkey", "n", *[_r(c, 4).alias(c) for c in ("gdop", "pdop", "hdop", "vdop")])


@_query("""WITH r AS (SELECT user_id, (value - 50) / 20 AS r, 1.0 + event_id % 3 AS w FROM events), s AS (SELECT user_id, count(*) AS n, sum(w * r * r) AS s FROM r GROUP BY user_id), t AS (SELECT sqrt(-2 * ln(1e-3)) AS t),
z AS (SELECT t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z FROM t)
SELECT user_id, n, round(s, 4) AS statistic, round((n - 4) * pow(1 - 2 / (9.0 * (n - 4)) + z * sqrt(2 / (9.0 * (n - 4))), 3), 6) AS threshold, s <= (n - 4) * pow(1 - 2 / (9.0 * (n - 4)) + z * sqrt(2 / (9.0 * (n - 4))), 3) AS ok FROM s, z WHERE n > 4""")
def integrity_check(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", ((F.col("value") - 50) / 20).alias("r"), (1.0 + F.col("event_id") % 3).alias("w"))
    return estimators.integrity(rows, ["user_id"], "r", "w").where("n > 4").select("user_id", "n", _r("statistic", 4).alias("statistic"), _r("threshold").alias("threshold"), "ok")


@_query("""SELECT user_id, event_type, round(sum(value * (event_id % 4)) / sum(event_id % 4), 6) AS clock, count(*) AS n FROM events WHERE event_id % 4 > 0 AND value IS NOT NULL GROUP BY ALL""")
def fixed_position_clock(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("w", (F.col("event_id") % 4).cast("double"))
    return estimators.weighted_clock(rows, ["user_id", "event_type"], "value", "w").select("user_id", "event_type", _r("clock").alias("clock"), "n")


_PARTICLES = """p AS (SELECT c_nationkey AS epoch, c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 97)::DOUBLE AS y, (c_custkey % 53)::DOUBLE AS z, (c_custkey % 11)::DOUBLE AS clock FROM customer),
o AS (SELECT s_nationkey AS epoch, s_acctbal AS sx, 1000.0 + s_suppkey AS sy, 2000.0 - s_suppkey AS sz, sqrt(s_acctbal * s_acctbal + 1000.0 * 1000 + 2000.0 * 2000) + s_suppkey % 60 AS pr, 1.0 + s_suppkey % 2 AS w FROM supplier),
m AS (SELECT *, sqrt((x - sx) ^ 2 + (y - sy) ^ 2 + (z - sz) ^ 2) AS rng FROM p JOIN o USING (epoch)), r AS (SELECT *, pr - rng - clock AS r FROM m)"""


def _particles(spark, sf_dir):
    k = F.col("c_custkey")
    d = lambda c: c.cast("double")
    p = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("epoch"), k.alias("id"), (F.col("c_acctbal") / 100).alias("x"), d(k % 97).alias("y"), d(k % 53).alias("z"), d(k % 11).alias("clock"))
    s, b = F.col("s_suppkey"), F.col("s_acctbal")
    o = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("epoch"), b.alias("sx"), (1000.0 + s).alias("sy"), (2000.0 - s).alias("sz"), (F.sqrt(b * b + 1000.0 * 1000 + 2000.0 * 2000) + s % 60).alias("pr"), (1.0 + s % 2).alias("w"))
    return p, o


def _weights(out):
    return out.select("epoch", "id", _r("log_weight", 4).alias("log_weight"))


@_query(f"WITH {_PARTICLES}, g AS (SELECT epoch, id, sum(-0.5 * w * r * r / 900) AS a, sum(CASE WHEN abs(r) <= 40 THEN -0.5 * w * r * r / 900 ELSE 0 END) AS i, count(*) FILTER (WHERE abs(r) <= 40) AS n, count(*) AS m FROM r GROUP BY ALL) SELECT epoch, id, round(CASE WHEN n >= least(4, m) THEN i ELSE a END, 4) AS log_weight FROM g")
def particle_code_weights(spark, sf_dir):
    """Gaussian weights with a gate that needs four satellites."""
    return _weights(particles.cloud_code_weights(*_particles(spark, sf_dir), ["epoch"], ["epoch", "id"], 30.0, gate=40.0))


@_query(f"WITH {_PARTICLES} SELECT epoch, id, round(sum(-2.0 * ln(1 + w * r * r / (3 * 900))), 4) AS log_weight FROM r GROUP BY ALL")
def particle_student_weights(spark, sf_dir):
    return _weights(particles.cloud_code_weights(*_particles(spark, sf_dir), ["epoch"], ["epoch", "id"], 30.0, nu=3.0))


@_query(f"WITH {_PARTICLES}, u AS (SELECT *, sqrt(w) * abs(r) / 30 AS u FROM r) SELECT epoch, id, round(sum(-CASE WHEN u <= 1.5 THEN 0.5 * u * u ELSE 1.5 * (u - 0.75) END), 4) AS log_weight FROM u GROUP BY ALL")
def particle_huber_weights(spark, sf_dir):
    return _weights(particles.cloud_code_weights(*_particles(spark, sf_dir), ["epoch"], ["epoch", "id"], 30.0, huber=1.5))


@_query(f"WITH {_PARTICLES} SELECT epoch, id, round(sum(ln(0.7 / 10 * exp(-0.5 * w * r * r / 100 - k) + 0.3 / 50 * exp(-0.5 * w * (r - 20) ^ 2 / 2500 - k)) + k), 3) AS log_weight FROM (SELECT *, greatest(-0.5 * w * r * r / 100, -0.5 * w * (r - 20) ^ 2 / 2500) AS k FROM r) GROUP BY ALL")
def particle_mixture_weights(spark, sf_dir):
    out = particles.cloud_mixture_weights(*_particles(spark, sf_dir), ["epoch"], ["epoch", "id"], 10.0, 0.7, 20.0, 50.0)
    return out.select("epoch", "id", _r("log_weight", 3).alias("log_weight"))


@_query(f"WITH {_PARTICLES}, c AS (SELECT *, pr / 0.7 - (rng + clock) / 0.7 AS c FROM r) SELECT epoch, id, round(sum(-0.5 * w * (c - round_even(c, 0)) ^ 2 / 0.01), 3) AS log_weight FROM c GROUP BY ALL")
def particle_phase_weights(spark, sf_dir):
    p, o = _particles(spark, sf_dir)
    return particles.cloud_phase_weights(p, o.withColumn("phase", F.col("pr") / 0.7), ["epoch"], ["epoch", "id"], "phase", 0.7, 0.1).select("epoch", "id", _r("log_weight", 3).alias("log_weight"))


_CLOUD = "c AS (SELECT c_nationkey AS epoch, c_custkey AS id, c_acctbal AS x, (c_custkey % 97)::DOUBLE AS y, (c_custkey % 53)::DOUBLE AS z, -(c_custkey % 17) / 4.0 AS lw FROM customer)"


def _cloud(spark, sf_dir):
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("epoch"), k.alias("id"), F.col("c_acctbal").alias("x"), (k % 97).cast("double").alias("y"), (k % 53).cast("double").alias("z"), (-(k % 17) / 4.0).alias("log_weight"))


@_query(f"""WITH {_CLOUD}, w AS (SELECT *, exp(lw) AS w FROM c), s AS (SELECT epoch, sum(w) AS sw, sum(w) ^ 2 / sum(w * w) AS ess, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM w GROUP BY epoch)
SELECT epoch, round(any_value(ess), 5) AS ess, round(any_value(mx), 5) AS mean_x, round(any_value(my), 5) AS mean_y, round(any_value(mz), 5) AS mean_z, round(sqrt(sum(w * ((x - mx) ^ 2 + (y - my) ^ 2 + (z - mz) ^ 2)) / any_value(sw)), 5) AS spread FROM w JOIN s USING (epoch) GROUP BY epoch""")
def particle_posterior(spark, sf_dir):
    """Mean, spread and effective size of each cloud."""
    return particles.posterior(_cloud(spark, sf_dir), ["epoch"], ["x", "y", "z"]).select("epoch", *[_r(c, 5).alias(c) for c in ("ess", "mean_x", "mean_y", "mean_z", "spread")])


@_query(f"WITH {_CLOUD} SELECT epoch, id, round(lw - 0.5 * ((x - 1000) ^ 2 + (y - 50) ^ 2 + (z - 20) ^ 2) / 90000, 4) AS log_weight FROM c")
def particle_position_update(spark, sf_dir):
    return particles.weight_position(_cloud(spark, sf_dir), [1000.0, 50.0, 20.0], 300.0).select("epoch", "id", _r("log_weight", 4).alias("log_weight"))


@_query(f"""WITH {_PARTICLES}, s AS (SELECT epoch, median(pr - sqrt(sx * sx + sy * sy + sz * sz)) - 5 AS shift FROM o GROUP BY epoch) SELECT epoch, id, round(clock + shift, 6) AS clock FROM p JOIN s USING (epoch)""")
def particle_clock_recentre(spark, sf_dir):
    """Clocks moved by the median residual at the present estimate, less its clock."""
    p, o = _particles(spark, sf_dir)
    shift = o.groupBy("epoch").agg((F.percentile(F.col("pr") - F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")), F.lit(0.5)) - 5).alias("shift"))
    return particles.recentre_clock(p, shift, ["epoch"]).select("epoch", "id", _r("clock").alias("clock"))


@_query(f"""WITH {_CLOUD}, w AS (SELECT *, sum(exp(lw)) OVER (PARTITION BY epoch ORDER BY id) / sum(exp(lw)) OVER (PARTITION BY epoch) AS hi FROM c), b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY epoch ORDER BY id), 0) AS lo FROM w),
s AS (SELECT unnest(range(64)) AS slot) SELECT b.epoch, b.id, s.slot FROM b JOIN s ON (0.37 + slot) / 64 >= lo AND (0.37 + slot) / 64 < hi""")
def systematic_resampling(spark, sf_dir):
    return particles.resample(_cloud(spark, sf_dir), ["epoch"], ["id"], 64, 0.37).select("epoch", "id", "slot")


@_query("""WITH q AS (SELECT o_orderkey, o_custkey % 8 AS prn, (o_orderkey * 977 % 604800)::DOUBLE AS t FROM orders), r AS (SELECT s_suppkey AS rec, s_suppkey % 8 AS prn, (s_suppkey * 7211 % 604800)::DOUBLE AS toe, s_suppkey % 3 AS priority FROM supplier),
m AS (SELECT q.*, rec, least(abs(t - toe), 604800 - abs(t - toe)) AS dt, priority FROM q JOIN r USING (prn) WHERE least(abs(t - toe), 604800 - abs(t - toe)) <= 7200), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY dt, priority DESC, rec) AS n FROM m)
SELECT o_orderkey, prn, rec, dt FROM k WHERE n = 1""")
def best_ephemeris(spark, sf_dir):
    """The record of each satellite nearest in time, of equally near ones that of the higher priority."""
    q = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("prn"), (F.col("o_orderkey") * 977 % 604800).cast("double").alias("t"))
    s = F.col("s_suppkey")
    r = _read(spark, sf_dir, "supplier").select((s % 8).alias("prn"), s.alias("rec"), (s * 7211 % 604800).cast("double").alias("toe"), (s % 3).alias("priority"))
    return joins.best_record(q, r, "prn", "t", "toe", 7200.0, "priority").select("o_orderkey", "prn", "rec", "dt")


@_query("""WITH l AS (SELECT l_orderkey, l_suppkey % 12 AS sat, l_suppkey % 2 AS sys, max(l_extendedprice) AS v, max(l_quantity) AS b, max(l_partkey % 90) AS el FROM lineitem GROUP BY ALL),
s AS (SELECT *, round(v - b, 2) AS sd, first_value(sat) OVER w AS ref, first_value(round(v - b, 2)) OVER w AS rsd, count(*) OVER (PARTITION BY l_orderkey, sys) AS n FROM l WINDOW w AS (PARTITION BY l_orderkey, sys ORDER BY el DESC, sat))
SELECT l_orderkey, sys, sat, ref AS reference, round(sd - rsd, 2) AS dd FROM s WHERE n >= 2 AND sat <> ref""")
def double_difference_join(spark, sf_dir):
    """Rover less base, less the same of the highest satellite of the system."""
    li = _read(spark, sf_dir, "lineitem")
    one = li.groupBy("l_orderkey", (F.col("l_suppkey") % 12).alias("sat"), (F.col("l_suppkey") % 2).alias("sys")).agg(F.max("l_extendedprice").alias("v"), F.max("l_quantity").alias("b"), F.max(F.col("l_partkey") % 90).alias("el"))
    rover, base = one.select("l_orderkey", "sat", "sys", "v", "el"), one.select("l_orderkey", "sat", F.col("b").alias("v"))
    return joins.double_differences(rover, base, ["l_orderkey"], "sat", "sys", "v", "el").select("l_orderkey", "sys", "sat", "reference", _r("dd", 2).alias("dd"))


@_query("""WITH p AS (SELECT c_custkey, c_acctbal AS x, (c_custkey % 1000)::DOUBLE AS y FROM customer), r AS (SELECT s_suppkey, s_acctbal AS x, (s_suppkey * 7 % 1000)::DOUBLE AS y FROM supplier),
d AS (SELECT c_custkey, s_suppkey, sqrt((p.x - r.x) ^ 2 + (p.y - r.y) ^ 2) AS d FROM p JOIN r ON abs(p.x - r.x) <= 200 AND abs(p.y - r.y) <= 200), k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS n FROM d WHERE d <= 200)
SELECT c_custkey, s_suppkey, round(d, 6) AS distance FROM k WHERE n = 1""")
def nearest_reference(spark, sf_dir):
    """The nearest reference point within reach."""
    p = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    r = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7 % 1000).cast("double").alias("y"))
    return joins.nearest_point(p, r, "c_custkey", ["x", "y"], "s_suppkey", 200.0).select("c_custkey", "s_suppkey", _r("distance").alias("distance"))


@_query("""WITH h AS (SELECT user_id, event_type, value AS i, (event_id % 13 - 6) / 10.0 AS q FROM events), s AS (SELECT user_id, event_type, count(*) AS n, (sum(i) ^ 2 + sum(q) ^ 2) / sum(i * i + q * q) AS ratio FROM h GROUP BY ALL)
SELECT user_id, event_type, round(CASE WHEN ratio <= 1 OR ratio >= n THEN 0 ELSE 10 * log10((ratio - 1) / (n - ratio) / 0.001) END, 6) AS cn0 FROM s""")
def carrier_to_noise(spark, sf_dir):
    """Narrow over wide power of each channel's correlations."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("i"), ((F.col("event_id") % 13 - 6) / 10.0).alias("q"))
    return aggregates.carrier_to_noise(rows, ["user_id", "event_type"], "i", "q", 0.001).select("user_id", "event_type", _r("cn0").alias("cn0"))


@_query(None)
def robust_positions(spark, sf_dir):
    """Positions with Cauchy weights, a third of the satellites' orders having one range off by 500 m."""
    return _epochs(spark, sf_dir, 500.0, robust="cauchy", rounds=20)


@_query(None)
def multi_system_positions(spark, sf_dir):
    """Positions with a clock for each of two systems."""
    return _epochs(spark, sf_dir, 0.0, systems=2)


def _epochs(spark, sf_dir, off, **options):
    li = _read(spark, sf_dir, "lineitem")
    az, el = (F.col("l_partkey") * 61 + F.col("l_linenumber") * 97) % 360, F.col("l_suppkey") * 29 % 70 + 15
    x, y = -1e7 + 1.6e7 * F.cos(F.radians(el)) * F.cos(F.radians(az)), 8.4e6 + 1.6e7 * F.cos(F.radians(el)) * F.sin(F.radians(az))
    z = 9.5e6 + 1.6e7 * F.sin(F.radians(el)) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-0.4)
    at = (F.lit(-3957199.0), F.lit(3310205.0), F.lit(3737911.0))
    wrong = F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 3 == 0), off).otherwise(0.0)
    sats = li.select("l_orderkey", x.alias("sx"), y.alias("sy"), z.alias("sz"), F.lit(1.0).alias("w"), (F.col("l_linenumber") % 2).cast("int").alias("system"), wrong.alias("wrong"))
    pr = G.sagnac_range(*at, F.col("sx"), F.col("sy"), F.col("sz")) + 3000.0 + F.col("wrong") + F.col("system") * (12.0 if options.get("systems") else 0.0)
    return estimators.wls_positions(sats.withColumn("pr", pr), ["l_orderkey"], **options)


@_query(None)
def navigation_filter(spark, sf_dir):
    """Eight-state filter over the orders of each customer: an order is an epoch, its lines are satellites."""
    from ..streaming.navigation_filter import filter_batch

    li, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t"))
    az, el = F.radians((F.col("l_partkey") * 61 + F.col("l_linenumber") * 97) % 360), F.radians(F.col("l_suppkey") * 29 % 70 + 15)
    at = (-3957199.0, 3310205.0, 3737911.0)
    s = [at[0] + 2e7 * F.cos(el) * F.cos(az), at[1] + 2e7 * F.cos(el) * F.sin(az), at[2] + 2e7 * F.sin(el)]
    sats = li.join(o, "l_orderkey").select(F.col("o_custkey").alias("track"), (F.col("t") / 86400).alias("t"), *[c.alias(f"s{a}") for a, c in zip("xyz", s)], F.lit(0.04).alias("w"))
    d = F.sqrt(sum(((F.col(f"s{a}") - v) * (F.col(f"s{a}") - v) for a, v in zip("xyz", at)), F.lit(0.0)))
    return filter_batch(sats.withColumn("pr", d + 3000.0), (at[0] + 50, at[1] - 50, at[2] + 20, 2900.0))
