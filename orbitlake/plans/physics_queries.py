"""Orbits, ranges, angles and signal labels over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import atmosphere, orbits
from ..functions import geodesy as G
from .queries import _ALPHA, _BETA, _GEO, _SKY, _XYZ, _geo, _query, _r, _read, _sky

_SAT = (2.0e7, 1.0e7, 1.2e7)


@_query(f"""WITH {_GEO}, {_XYZ}, d AS (SELECT *, 2e7 - x AS dx, 1e7 - y AS dy, 1.2e7 - z AS dz FROM x),
e AS (SELECT *, -sin(lon) * dx + cos(lon) * dy AS east, -sin(lat) * cos(lon) * dx - sin(lat) * sin(lon) * dy + cos(lat) * dz AS north,
  cos(lat) * cos(lon) * dx + cos(lat) * sin(lon) * dy + sin(lat) * dz AS up FROM d)
SELECT c_custkey, round(CASE WHEN atan2(east, north) < 0 THEN atan2(east, north) + 2 * pi() ELSE atan2(east, north) END, 8) AS azimuth,
  round(atan2(up, sqrt(east * east + north * north)), 8) AS elevation FROM e""")
def satellite_angles(spark, sf_dir):
    """Azimuth and elevation of one satellite from many places."""
    g = _geo(spark, sf_dir)
    east, north, up = G.ecef_to_enu(*[F.lit(s) - F.col(c) for s, c in zip(_SAT, "xyz")], F.col("lat"), F.col("lon"))
    az, el = G.azimuth_elevation(east, north, up)
    return g.select("c_custkey", _r(az, 8).alias("azimuth"), _r(el, 8).alias("elevation"))


@_query(f"""WITH {_GEO} SELECT c_custkey, round(-sin(lon) * 3 - sin(lat) * cos(lon) * 4 + cos(lat) * cos(lon) * 5, 8) AS dx,
  round(cos(lon) * 3 - sin(lat) * sin(lon) * 4 + cos(lat) * sin(lon) * 5, 8) AS dy, round(cos(lat) * 4 + sin(lat) * 5, 8) AS dz, 3.0::DOUBLE AS east, 4.0::DOUBLE AS north, 5.0::DOUBLE AS up FROM g""")
def enu_rotations(spark, sf_dir):
    """A local vector in ECEF, and turned back."""
    lat, lon = F.col("lat"), F.col("lon")
    out = _geo(spark, sf_dir).withColumns(dict(zip(("dx", "dy", "dz"), G.enu_to_ecef(F.lit(3.0), F.lit(4.0), F.lit(5.0), lat, lon))))
    back = G.ecef_to_enu(F.col("dx"), F.col("dy"), F.col("dz"), lat, lon)
    return out.select("c_custkey", *[_r(c, 8).alias(c) for c in ("dx", "dy", "dz")], *[_r(c, 8).alias(n) for n, c in zip(("east", "north", "up"), back)])


@_query(f"""WITH {_GEO}, w AS (SELECT *, radians(35.0) AS la, radians(139.0) AS lo, sqrt(1 - {G.E2!r} * sin(radians(35.0)) ^ 2) AS w FROM g)
SELECT c_custkey, round((lon - lo) * {G.A!r} / w * cos(la), 3) AS east, round((lat - la) * {G.A!r} * (1 - {G.E2!r}) / (w * w * w), 3) AS north, round(lat, 9) AS lat, round(lon, 9) AS lon FROM w""")
def tangent_plane(spark, sf_dir):
    """Metres from an origin, and back to angles."""
    lat0, lon0 = F.radians(F.lit(35.0)), F.radians(F.lit(139.0))
    east, north = G.tangent_offsets(F.col("lat"), F.col("lon"), lat0, lon0)
    out = _geo(spark, sf_dir).select("c_custkey", east.alias("east"), north.alias("north"))
    lat, lon = G.tangent_position(F.col("east"), F.col("north"), lat0, lon0)
    return out.select("c_custkey", _r("east", 3).alias("east"), _r("north", 3).alias("north"), _r(lat, 9).alias("lat"), _r(lon, 9).alias("lon"))


@_query(f"""WITH {_GEO}, {_XYZ}, d AS (SELECT *, 2e7 - x AS dx, 1e7 - y AS dy, 1.2e7 - z AS dz FROM x)
SELECT c_custkey, round((dx * (1000 - 1) + dy * (-2000 - 2) + dz * (1500 - 3)) / sqrt(dx * dx + dy * dy + dz * dz)
  - {G.OMEGA!r} * (1000 * y + 2e7 * 2 + 2000 * x - 1e7 * 1) / {G.LIGHT!r}, 6) AS rate FROM d""")
def range_rates(spark, sf_dir):
    lits = lambda *v: [F.lit(float(x)) for x in v]
    rate = orbits.range_rate(lits(*_SAT), [F.col(c) for c in "xyz"], lits(1000, -2000, 1500), lits(1, 2, 3))
    return _geo(spark, sf_dir).select("c_custkey", _r(rate).alias("rate"))


_EPH = """eph AS (SELECT s_suppkey AS prn, 5153.6 + s_suppkey % 7 * 0.01 AS sqrt_a, 4.5e-9 AS delta_n, (s_suppkey * 37 % 628) / 100.0 - 3.14 AS m0, 0.001 + s_suppkey % 20 * 0.001 AS e,
  (s_suppkey * 7200 % 604800)::DOUBLE AS toe, (s_suppkey * 7200 % 604800)::DOUBLE AS toc, (s_suppkey * 53 % 628) / 100.0 - 3.14 AS omega, (s_suppkey * 71 % 628) / 100.0 - 3.14 AS omega0, -8.0e-9 AS omega_dot,
  0.96 AS i0, 1e-10 AS idot, 1e-6 AS cuc, 8e-6 AS cus, 200.0 AS crc, 30.0 AS crs, 1e-7 AS cic, -5e-8 AS cis, s_suppkey % 100 * 1e-6 AS af0, 1e-12 AS af1, 0.0 AS af2, -1e-8 AS tgd FROM supplier)"""
_FIELDS = "sqrt_a delta_n m0 e toe toc omega omega0 omega_dot i0 idot cuc cus crc crs cic cis af0 af1 af2 tgd".split()


def _ephemerides(spark, sf_dir):
    k = F.col("s_suppkey")
    angle = lambda m: (k * m % 628) / 100.0 - 3.14
    fixed = {"delta_n": 4.5e-9, "omega_dot": -8.0e-9, "i0": 0.96, "idot": 1e-10, "cuc": 1e-6, "cus": 8e-6, "crc": 200.0, "crs": 30.0, "cic": 1e-7, "cis": -5e-8, "af1": 1e-12, "af2": 0.0, "tgd": -1e-8}
    toe = (k * 7200 % 604800).cast("double")
    own = {"sqrt_a": 5153.6 + k % 7 * 0.01, "m0": angle(37), "e": 0.001 + k % 20 * 0.001, "toe": toe, "toc": toe, "omega": angle(53), "omega0": angle(71), "af0": k % 100 * 1e-6}
    return _read(spark, sf_dir, "supplier").select(k.alias("prn"), *[c.alias(n) for n, c in own.items()], *[F.lit(v).alias(n) for n, v in fixed.items()])


def _orbit_sql(t: str) -> str:
    wrap = lambda x: f"CASE WHEN {x} > 302400 THEN {x} - 604800 WHEN {x} < -302400 THEN {x} + 604800 ELSE {x} END"
    return f"""o1 AS (SELECT *, {wrap(f'({t} - toe)')} AS tk, {wrap(f'({t} - toc)')} AS dt FROM eph),
o2 AS (SELECT *, m0 + (sqrt({orbits.MU!r} / sqrt_a ^ 6) + delta_n) * tk AS mean FROM o1),
o3 AS (SELECT *, list_reduce([mean::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: a - (a - e * sin(a) - mean) / (1 - e * cos(a))) AS ea FROM o2),
o4 AS (SELECT *, atan2(sqrt(1 - e * e) * sin(ea), cos(ea) - e) + omega AS phi FROM o3),
o5 AS (SELECT *, phi + cuc * cos(2 * phi) + cus * sin(2 * phi) AS u, sqrt_a * sqrt_a * (1 - e * cos(ea)) + crc * cos(2 * phi) + crs * sin(2 * phi) AS r,
  i0 + idot * tk + cic * cos(2 * phi) + cis * sin(2 * phi) AS i, omega0 + (omega_dot - {G.OMEGA!r}) * tk - {G.OMEGA!r} * toe AS node FROM o4),
o6 AS (SELECT *, r * cos(u) * cos(node) - r * sin(u) * cos(i) * sin(node) AS x, r * cos(u) * sin(node) + r * sin(u) * cos(i) * cos(node) AS y, r * sin(u) * sin(i) AS z,
  af0 + af1 * dt + af2 * dt * dt + {orbits.RELATIVITY!r} * e * sqrt_a * sin(ea) - tgd AS clock FROM o5)"""


@_query(f"WITH {_EPH}, {_orbit_sql('300000')} SELECT prn, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, round(clock * 1e9, 4) AS clock_ns FROM o6")
def broadcast_orbits(spark, sf_dir):
    """Positions and clocks from broadcast elements."""
    eph = {c: F.col(c) for c in _FIELDS}
    s = orbits.satellite_state(eph, F.lit(300000.0))
    return _ephemerides(spark, sf_dir).select("prn", *[_r(s[c], 2).alias(c) for c in "xyz"], _r(s["clock"] * 1e9, 4).alias("clock_ns"))


@_query(f"WITH {_EPH}, {_orbit_sql('300000.5')}, a AS (SELECT prn, x, y, z FROM o6), b AS (WITH {_orbit_sql('299999.5')} SELECT prn, x, y, z FROM o6) SELECT prn, round(a.x - b.x, 3) AS vx, round(a.y - b.y, 3) AS vy, round(a.z - b.z, 3) AS vz FROM a JOIN b USING (prn)")
def satellite_velocities(spark, sf_dir):
    """Central differences of the orbit over a second."""
    eph = {c: F.col(c) for c in _FIELDS}
    a, b = orbits.satellite_state(eph, F.lit(300000.5)), orbits.satellite_state(eph, F.lit(299999.5))
    return _ephemerides(spark, sf_dir).select("prn", *[_r(a[c] - b[c], 3).alias(f"v{c}") for c in "xyz"])


@_query(f"WITH {_EPH} SELECT prn, round((af0 + af1 * (300000 - toc) + CASE WHEN 300000 - toc > 302400 THEN af1 * -604800 WHEN 300000 - toc < -302400 THEN af1 * 604800 ELSE 0 END) * 1e9, 4) AS clock_ns FROM eph")
def broadcast_clocks(spark, sf_dir):
    return _ephemerides(spark, sf_dir).select("prn", _r(orbits.clock_polynomial({c: F.col(c) for c in _FIELDS}, F.lit(300000.0)) * 1e9, 4).alias("clock_ns"))


@_query("""WITH s AS (SELECT s_suppkey, substr('GERC', s_suppkey % 4 + 1, 1) AS sys, CASE WHEN s_suppkey % 3 = 0 THEN 'C7Q' ELSE 'C1C' END AS code, s_suppkey % 8 * 256 AS src, s_suppkey * 1e-9 AS tgd,
  s_suppkey % 5 * 1e-9 AS b FROM supplier)
SELECT s_suppkey, round(CASE WHEN sys = 'E' AND code = 'C1C' THEN CASE WHEN src & 512 <> 0 THEN b WHEN src & 256 <> 0 THEN tgd * 2 WHEN b <> 0 THEN b ELSE tgd * 2 END ELSE tgd END * 1e9, 6) AS delay_ns FROM s""")
def group_delays(spark, sf_dir):
    k = F.col("s_suppkey")
    tgd = k * 1e-9
    delay = orbits.group_delay(F.substring(F.lit("GERC"), k % 4 + 1, F.lit(1)), F.when(k % 3 == 0, "C7Q").otherwise("C1C"), k % 8 * 256, tgd, tgd * 2, k % 5 * 1e-9)
    return _read(spark, sf_dir, "supplier").select("s_suppkey", _r(delay * 1e9).alias("delay_ns"))


@_query("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey % 32)::VARCHAR ELSE substr('GREC', s_suppkey % 4 + 1, 1) || lpad((s_suppkey % 32)::VARCHAR, 2, '0') END AS label FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(label, '^[A-Z]') THEN label[1] ELSE 'G' END AS system, regexp_replace(label, '^[A-Z]', '')::INT AS prn FROM l""")
def satellite_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    label = F.when(k % 5 == 0, (k % 32).cast("string")).otherwise(F.concat(F.substring(F.lit("GREC"), k % 4 + 1, F.lit(1)), F.lpad((k % 32).cast("string"), 2, "0")))
    system, prn = orbits.split_label(label)
    return _read(spark, sf_dir, "supplier").select("s_suppkey", system.alias("system"), prn.alias("prn"))


@_query("""SELECT event_id, CASE WHEN user_id % 7 <> 3 AND 1.1e9 + value * 5e6 < (1176.45e6 + 1561.098e6) / 2 THEN 'L5' ELSE 'L1' END AS band FROM events WHERE value IS NOT NULL""")
def carrier_bands(spark, sf_dir):
    return _read(spark, sf_dir, "events").where("value is not null").select("event_id", orbits.carrier_band(1.1e9 + F.col("value") * 5e6, F.col("user_id") % 7).alias("band"))


@_query(f"""WITH c AS (SELECT event_id, event_id * 17 % 4092 * (1.023e6 / 4.092e6) AS chips FROM events), r AS (SELECT event_id, chips, chips / 1.023e6 * {G.LIGHT!r} AS own, 1023 / 1.023e6 * {G.LIGHT!r} AS period FROM c)
SELECT event_id, round(chips, 6) AS chips, round(own + round_even((2.2e7 - own) / period, 0) * period, 3) AS pseudorange FROM r""")
def code_phases(spark, sf_dir):
    """Chips and pseudoranges of code lags."""
    chips = orbits.chips_of_lag(F.col("event_id") * 17 % 4092, 4.092e6)
    return _read(spark, sf_dir, "events").select("event_id", _r(chips).alias("chips"), _r(orbits.pseudorange_of_phase(chips, F.lit(2.2e7)), 3).alias("pseudorange"))


_TROPO = """(0.002277 * (1013.25 * pow(1 - 2.2557e-5 * alt, 5.2568) + (1255 / (15 - 6.5e-3 * alt + 273.15) + 0.05) * 0.5 * 6.108 * exp(17.15 * (15 - 6.5e-3 * alt) / (15 - 6.5e-3 * alt + 234.7)))
  / (1 - 0.00266 * cos(2 * lat) - 0.00028 * alt / 1000) / sin(sqrt(greatest(el, radians(2.0)) * greatest(el, radians(2.0)) + 6.25 * radians(1.0) * radians(1.0))))"""
_IONO = f"""a AS (SELECT *, 0.0137 / (el / pi() + 0.11) - 0.022 AS psi FROM sky),
b AS (SELECT *, least(greatest(lat / pi() + psi * cos(az), -0.416), 0.416) AS fi FROM a), c AS (SELECT *, lon / pi() + psi * sin(az) / cos(fi * pi()) AS li FROM b),
d AS (SELECT *, fi + 0.064 * cos((li - 1.617) * pi()) AS m, 43200 * li + tow AS s FROM c),
e AS (SELECT *, greatest({_BETA[0]} + {_BETA[1]} * m + {_BETA[2]} * m * m + {_BETA[3]} * m * m * m, 72000) AS per,
  greatest({_ALPHA[0]} + {_ALPHA[1]} * m + {_ALPHA[2]} * m * m + {_ALPHA[3]} * m * m * m, 0) AS amp, s - 86400 * floor(s / 86400) AS t FROM d),
f AS (SELECT *, 2 * pi() * (t - 50400) / per AS x FROM e),
g AS (SELECT *, 299792458.0 * (1 + 16 * pow(0.53 - el / pi(), 3)) * (5e-9 + CASE WHEN abs(x) < 1.57 THEN amp * (1 - x * x / 2 + x * x * x * x / 24) ELSE 0 END) AS iono, {_TROPO} AS tropo FROM f)"""


def _delays():
    c = {n: F.col(n) for n in ("lat", "lon", "az", "el", "tow")}
    return atmosphere.troposphere(F.col("lat"), F.col("alt"), F.col("el")), atmosphere.ionosphere(_ALPHA, _BETA, **c)


@_query(f"WITH {_SKY}, {_IONO} SELECT k, round(tropo + iono, 5) AS delay FROM g")
def atmosphere_total(spark, sf_dir):
    tropo, iono = _delays()
    return _sky(spark, sf_dir).select("k", _r(tropo + iono, 5).alias("delay"))


@_query(f"WITH {_SKY}, {_IONO} SELECT k, round(CASE WHEN el < 0.087 THEN 2.2e7 + k ELSE 2.2e7 + k - tropo - iono END, 4) AS pr, round(CASE WHEN el < 0.087 THEN 0.01 ELSE pow(greatest(sin(el), 0.1), 2) END, 6) AS weight FROM g")
def corrected_pseudoranges(spark, sf_dir):
    """Ranges less the delays, with weights by elevation; under the mask no correction and a weight of 0.01."""
    tropo, iono = _delays()
    pr, weight = atmosphere.corrected(2.2e7 + F.col("k"), F.col("el"), tropo, iono)
    return _sky(spark, sf_dir).select("k", _r(pr, 4).alias("pr"), _r(weight).alias("weight"))
