import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitlake.functions import geodesy as G
from orbitlake.operators import estimators, joins, windows
from orbitlake.sources import nmea
from orbitlake.streaming import kalman


def test_nearest_tie_goes_to_the_earlier_and_tolerance_cuts(spark):
    a = spark.createDataFrame([("k", 10.0, 1), ("k", 15.0, 2), ("k", 99.0, 3), ("m", 1.0, 4)], "by string, at double, id int")
    b = spark.createDataFrame([("k", 5.0, 50.0), ("k", 15.0, 150.0)], "by string, at double, v double")
    got = {r.id: r.v for r in joins.nearest_asof(a, b, "by", "at", "v", 20.0).collect()}
    assert got == {1: 50.0, 2: 150.0, 3: None, 4: None}


def test_interpolation_needs_a_strict_bracket_within_the_gap(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 9)], "by string, at long")
    b = spark.createDataFrame([("k", 0, 0.0), ("k", 2, 2.0), ("k", 20, 3.0)], "by string, at long, v double")
    assert {r.at: r.v for r in joins.interpolated_join(a, b, "by", "at", "v", 10).collect()} == {1: 1.0, 2: None, 9: None}


def test_offset_lookup_takes_the_first_that_hits(spark):
    a = spark.createDataFrame([("k", 10), ("k", 20)], "by string, at long")
    b = spark.createDataFrame([("k", 9, 1.0), ("k", 12, 2.0)], "by string, at long, v double")
    assert {r.at: r.v for r in joins.offset_lookup(a, b, "by", "at", "v", [0, 1, -1, 2, -2]).collect()} == {10: 1.0, 20: None}


def test_fill_linear_and_islands(spark):
    df = spark.createDataFrame([("k", 0.0, None), ("k", 1.0, 1.0), ("k", 2.0, None), ("k", 3.0, 3.0), ("k", 4.0, None)], "by string, at double, v double")
    assert [r.v_filled for r in windows.fill_linear(df, "by", "at", "v").orderBy("at").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    runs = windows.islands(df, "by", ["at"], F.col("v").isNull()).orderBy("first").collect()
    assert [(r.n, r.first, r.last) for r in runs] == [(1, 0.0, 0.0), (1, 2.0, 2.0), (1, 4.0, 4.0)]


def test_azimuth_and_elevation(spark):
    az, el = G.azimuth_elevation(F.lit(-1.0), F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(az.alias("a"), el.alias("e")).first()
    assert r.a == pytest.approx(1.5 * math.pi) and r.e == pytest.approx(math.pi / 4)


TRUE, CLOCK = np.array([-3957199.0, 3310205.0, 3737911.0]), 3000.0


def epochs(n, sats, seed=1):
    r = np.random.default_rng(seed)
    up, rows = TRUE / np.linalg.norm(TRUE), []
    for e in range(n):
        for _ in range(sats):
            d = r.normal(size=3)
            d = d / np.linalg.norm(d)
            d = d if d @ up > 0.2 else d + up * (0.4 - d @ up)
            s = TRUE + d / np.linalg.norm(d) * 2.2e7
            turn = G.OMEGA * np.linalg.norm(s - TRUE) / G.LIGHT
            q = np.array([np.cos(turn) * s[0] + np.sin(turn) * s[1], np.cos(turn) * s[1] - np.sin(turn) * s[0], s[2]])
            rows.append((e, *map(float, s), float(np.linalg.norm(q - TRUE) + CLOCK), 1.0))
    return rows


def test_positions_find_the_planted_truth(spark):
    rows = epochs(50, 8) + [(900, *r[1:]) for r in epochs(1, 3)] + [(0, 1.0, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "epoch long, sx double, sy double, sz double, pr double, w double")
    for r in estimators.wls_positions(df, ["epoch"]).collect():
        if r.epoch == 900:
            assert r.n == 3 and (r.x is None or math.isnan(r.x))
        else:
            assert r.n == 8 and np.linalg.norm(np.array([r.x, r.y, r.z]) - TRUE) < 0.01 and abs(r.clock - CLOCK) < 0.01
    assert estimators.wls_positions(df.limit(0), ["epoch"]).count() == 0


def test_dilution_matches_numpy(spark):
    r = random.Random(2)
    rows = [(e, r.uniform(0, 6.28), r.uniform(0.2, 1.5)) for e in range(5) for _ in range(4 + e)] + [(9, 1.0, 1.0)]
    got = {x.e: x for x in estimators.dilution(spark.createDataFrame(rows, "e long, az double, el double"), ["e"], "az", "el").collect()}
    for e in range(5):
        h = np.array([[math.cos(b) * math.sin(a), math.cos(b) * math.cos(a), math.sin(b), 1.0] for k, a, b in rows if k == e])
        assert got[e].gdop == pytest.approx(math.sqrt(np.trace(np.linalg.inv(h.T @ h))), rel=1e-6)
    assert got[9].pdop == 999.0


def test_filter_in_batch_equals_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, float(t), t * 0.5 + r.gauss(0, 1)) for k in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "track long, t double, z double")
    batch = sorted(map(tuple, kalman.filter_batch(df).collect()))
    rounded = lambda rows: sorted((k, t, round(x, 9), round(v, 9)) for k, t, x, v in rows)
    plain = []
    for k in range(3):
        out, _ = kalman.steps(pd.DataFrame([x[1:] for x in rows if x[0] == k], columns=["t", "z"]), None, 1e-3, 1.0)
        plain += [(k, *x) for x in out.itertuples(index=False)]
    assert rounded(batch) == rounded(plain)
    for i, (lo, hi) in enumerate([(0, 10), (10, 30)]):
        df.where(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = kalman.filter_stream(spark.readStream.schema("track long, t double, z double").parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert rounded(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == rounded(batch)


def test_nmea_lines(spark):
    def line(body):
        x = 0
        for c in body:
            x ^= ord(c)
        return f"${body}*{x:02X}"

    gga, rmc = "GPGGA,123519,4807.038,N,01131.000,W,1,08,0.9,545.4,M,46.9,M,,", "GNRMC,123519,A,4807.038,S,01131.000,E,022.4,084.4,230394,003.1,W"
    lines = [line(gga), line(rmc), line(gga)[:-1] + "!", "$GPGGA,1*00", "", None, line("GPGSV,1")]
    got = sorted(nmea.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect(), key=lambda r: r.kind)
    assert [r.kind for r in got] == ["GGA", "RMC"]
    assert got[0].lat == pytest.approx(48.1173) and got[0].lon == pytest.approx(-11.516667, abs=1e-6) and got[0].altitude == 545.4
    assert got[1].lat == pytest.approx(-48.1173) and got[1].speed_knots == 22.4


def test_slips_are_never_on_a_first_row_nor_beside_nulls(spark):
    from orbitlake.operators import slips

    rows = [("a", 1, 0.0), ("a", 2, 9.0), ("a", 3, None), ("a", 4, 9.0), ("b", 1, 50.0), ("b", 2, 50.5)]
    df = spark.createDataFrame(rows, "sat string, t int, x double")
    out = slips.jumps_over(df, ["sat"], ["t"], {"slip": (F.col("x"), 0.5)}).where("slip").collect()
    assert [(r.sat, r.t) for r in out] == [("a", 2)]


def test_ramps_clip_and_labels_name_the_side_that_is_wrong(spark):
    from orbitlake.functions import signals

    df = spark.createDataFrame([(True, 50.0, 40.0), (False, 50.0, 40.0), (True, 10.0, 40.0), (False, 10.0, 40.0), (True, None, 40.0), (True, 50.0, 1.0), (True, 30.0, 40.0)], "los boolean, cn0 double, el double")
    label = signals.sight_label(F.col("los"), F.col("cn0"), F.col("el"), 35.0, 25.0, 15.0)
    got = df.select(label.alias("l"), signals.ramp(F.col("cn0"), 20.0, 40.0, 0.5).alias("r")).collect()
    assert [r.l for r in got] == ["consistent", "phantom_building", "missing_building", "consistent", "ambiguous", "ambiguous", "ambiguous"]
    assert [r.r for r in got] == [1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 0.75]
