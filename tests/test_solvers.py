"""Solvers and filters against planted truth, and sequence operators whose time must grow with the rows."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import estimators, gates, joins, particles, sequences
from orbitlake.streaming import navigation_filter as nf
from tests.test_operators import CLOCK, TRUE, epochs


def test_robust_positions_shrug_off_a_wrong_range(spark):
    rows = [(e, x, y, z, pr + (90.0 if i % 9 == 0 else 0.0), w) for i, (e, x, y, z, pr, w) in enumerate(epochs(30, 9, seed=4))]
    df = spark.createDataFrame(rows, "epoch long, sx double, sy double, sz double, pr double, w double")
    plain = {r.epoch: np.linalg.norm(np.array([r.x, r.y, r.z]) - TRUE) for r in estimators.wls_positions(df, ["epoch"]).collect()}
    for kind in ("cauchy", "huber"):
        got = {r.epoch: np.linalg.norm(np.array([r.x, r.y, r.z]) - TRUE) for r in estimators.wls_positions(df, ["epoch"], robust=kind, rounds=40).collect()}
        assert np.median(list(got.values())) < 0.5 * np.median(list(plain.values()))


def test_each_system_has_its_clock(spark):
    rows = [(e, x, y, z, pr + (25.0 if i % 2 else 0.0), w, i % 2) for i, (e, x, y, z, pr, w) in enumerate(epochs(20, 10, seed=5))]
    df = spark.createDataFrame(rows, "epoch long, sx double, sy double, sz double, pr double, w double, system int")
    for r in estimators.wls_positions(df, ["epoch"], systems=2).collect():
        assert np.linalg.norm(np.array([r.x, r.y, r.z]) - TRUE) < 0.01 and abs(r.clock - CLOCK) < 0.01 and abs(r.isb1 - 25.0) < 0.01


def motion(seed, n=8):
    r = np.random.default_rng(seed)
    sats, vels = TRUE + r.normal(size=(n, 3)) * 2e7, r.normal(size=(n, 3)) * 3000
    return sats, vels, (sats - TRUE) / np.linalg.norm(sats - TRUE, axis=1, keepdims=True)


def test_doppler_velocity_finds_the_planted_one(spark):
    v, drift, rows = np.array([3.0, -2.0, 1.0]), 7.5, []
    for e in range(20):
        s, sv, los = motion(e)
        for a, b, l in zip(s, sv, los):
            rows.append((e, *map(float, a), *map(float, b), float(((b - v) @ l + drift) / 0.19), 1.0))
    df = spark.createDataFrame(rows, "epoch int, sx double, sy double, sz double, svx double, svy double, svz double, doppler double, w double")
    for r in estimators.doppler_velocity(df, ["epoch"], [F.lit(float(x)) for x in TRUE], 0.19).collect():
        assert np.allclose([r.vx, r.vy, r.vz, r.drift], [*v, drift], atol=1e-6)


def test_carrier_velocity_and_its_gates(spark):
    v, rows = np.array([1.0, 2.0, -1.0]), []
    s, sv, _ = motion(3, 9)
    mid = s + 0.5 * sv
    los = (mid - TRUE) / np.linalg.norm(mid - TRUE, axis=1, keepdims=True)
    for k in range(9):
        change = los[k] @ sv[k] + los[k] @ v + 0.5  # the model adds the receiver's motion along the line of sight
        for e in range(2):
            rows.append((1, e, float(e), k, 40.0, float(1e6 + e * change / 0.19), *map(float, s[k] + e * sv[k]), *map(float, sv[k]), 0.0, 1.0))
    rows.append((1, 1, 1.0, 0, 40.01, 5.0, *map(float, s[0]), *map(float, sv[0]), 0.0, 1.0))  # a tie: the satellite is left out
    schema = "track int, epoch int, t double, satellite int, snr double, phase double, sx double, sy double, sz double, svx double, svy double, svz double, clock_drift double, w double"
    df = spark.createDataFrame(rows, schema)
    at = [F.lit(float(x)) for x in TRUE]
    r = estimators.carrier_velocity(df, ["track"], "epoch", "t", at, 0.19, most_jump=1e6).collect()
    assert len(r) == 1 and r[0].n == 8 and np.allclose([r[0].vx, r[0].vy, r[0].vz], v, atol=1e-4) and r[0].rms < 1e-4
    assert estimators.carrier_velocity(df.where("satellite < 4"), ["track"], "epoch", "t", at, 0.19).count() == 0
    assert estimators.carrier_velocity(df, ["track"], "epoch", "t", at, 0.19, most_jump=1e6, most_speed=1.0).count() == 0


def test_adaptive_weights_match_the_error_function(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-40, 40, 81)], "r double")
    for r, w in df.select("r", gates.adaptive_weight(F.col("r"), 10.0, F.lit(2.0))).collect():
        assert w == pytest.approx(2 * max(0.01, math.erfc(abs(r) / 10 / math.sqrt(2))), abs=1e-6)


def test_navigation_filter_in_batch_equals_stream_and_converges(spark, tmp_path):
    rows = []
    for k in range(2):
        for t in range(20):
            s, _, _ = motion(100 * k + t)
            rows += [(k, float(t), *map(float, a), float(np.linalg.norm(a - TRUE) + CLOCK), 1.0) for a in s]
    schema = "track long, t double, sx double, sy double, sz double, pr double, w double"
    df = spark.createDataFrame(rows, schema)
    origin = (*(TRUE + 40), CLOCK - 100)
    batch = {(r.track, r.t): r for r in nf.filter_batch(df, origin).collect()}
    assert len(batch) == 40 and all(np.linalg.norm(np.array([batch[k, 19.0][a] for a in "xyz"]) - TRUE) < 1.0 for k in range(2))
    for lo, hi in ((0, 8), (8, 20)):
        df.where(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        nf.filter_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), origin).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert r.x == pytest.approx(batch[r.track, r.t].x, abs=1e-6) and r.drift == pytest.approx(batch[r.track, r.t].drift, abs=1e-6)


def test_resampling_fills_every_slot(spark):
    df = spark.createDataFrame([(e, i, -0.3 * (i % 5)) for e in range(3) for i in range(40)], "epoch int, id int, log_weight double")
    out = particles.resample(df, ["epoch"], ["id"], 100, 0.999).collect()
    assert all(sorted(r.slot for r in out if r.epoch == e) == list(range(100)) for e in range(3))


def test_one_hot_key_takes_time_in_proportion(spark):
    def seconds(n):
        a = spark.range(n).selectExpr("1 by", "id * 2 at").cache()
        b = spark.range(n).selectExpr("1 by", "id * 2 + 1 at", "cast(id as double) v").cache()
        a.count(), b.count()
        began = time.time()
        joins.nearest_asof(a, b, "by", "at", "v").write.format("noop").mode("overwrite").save()
        joins.interpolated_join(a, b, "by", "at", "v", 10).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 40


def test_kernels_leave_the_ends(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(7)], "k int, t int, v double")
    got = [r.v_kernel for r in sequences.smooth(df, ["k"], ["t"], "v", sequences.kernel("boxcar", 2)).orderBy("t").collect()]
    assert got[:2] == [0.0, 1.0] and got[2] == pytest.approx(6.0) and got[-2:] == [25.0, 36.0]
    lone = spark.createDataFrame([(1, 0, 2.0)], "k int, t int, v double")
    assert sequences.motion_stats(lone, ["k"], ["t"], ["v"]).first()[1:] == (0.0, 0.0, 0.0, 0.0)


def test_gradient_of_uneven_times_is_that_of_numpy(spark):
    from orbitlake.operators import windows

    t, v = np.array([0.0, 1.0, 3.0, 3.5, 7.0]), np.array([1.0, 4.0, 2.0, 8.0, 5.0])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v)] + [(2, 0.0, 9.0)], "k int, t double, v double")
    got = {(r.k, r.t): r.v_rate for r in windows.gradient(df, "k", ["t"], "t", "v").collect()}
    assert got[2, 0.0] == 0.0 and np.allclose([got[1, x] for x in t], np.gradient(v, t))
