import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import clouds, particles

N, EPOCHS, SIGMA, SIGMA_CLOCK, SEED = 60, 6, 2.0, 5.0, 11
TRUE = {1: np.array([10.0, 20.0, 5.0]), 2: np.array([-30.0, 0.0, 8.0])}


@pytest.fixture(scope="module")
def small_blocks():
    was = clouds.BLOCK
    clouds.BLOCK = 7
    yield
    clouds.BLOCK = was


def world(spark):
    r = random.Random(4)
    starts = spark.createDataFrame([(k, *map(float, p), 0.0) for k, p in TRUE.items()] + [(None, 0.0, 0.0, 0.0, 0.0)], "track long, x double, y double, z double, clock double")
    moves, obs = [], []
    for k, p in TRUE.items():
        at = p.copy()
        for t in range(EPOCHS):
            v = np.array([1.0, -0.5, 0.0])
            at = at + v
            moves.append((k, t, 1.0, *map(float, v)))
            for s in range(0 if (k, t) == (2, 3) else 6):
                sat = np.array([math.cos(s * 1.1), math.sin(s * 1.1), 0.4 + 0.1 * s]) * 2e4
                obs.append((k, t, *map(float, sat), float(np.linalg.norm(at - sat) + 30 + r.gauss(0, 3)), 1.0))
    m = spark.createDataFrame(moves, "track long, epoch int, dt double, vx double, vy double, vz double")
    return starts, m, spark.createDataFrame(obs, "track long, epoch int, sx double, sy double, sz double, pr double, w double"), moves, obs


def weigh(met, keys):
    return particles.weight_code(met, keys, 5.0)


def keyed(spark, column, **keys):
    """Values of a draw for rows of keys."""
    names = list(keys)
    n = len(next(iter(keys.values())))
    kinds = ", ".join(f"{c} long" for c in names)
    df = spark.createDataFrame([(i, *[int(keys[c][i]) for c in names]) for i in range(n)], f"i int, {kinds}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def plain_filter(spark, moves, obs):
    """The filter as a loop over epochs and tracks, with the same draws."""
    out = {}
    for k in TRUE:
        ids = list(range(N))
        draw = lambda what, *more: np.array(keyed(spark, clouds.normal(SEED, F.lit(what), *more, "track", "id"), track=[k] * N, id=ids))  # noqa: B023, E731
        x = np.stack([TRUE[k][i] + draw(f"start {c}") * 50.0 for i, c in enumerate("xyz")] + [draw("start clock") * 100.0], 1)
        lw, source = np.zeros(N), [None] * N
        for t in range(EPOCHS):
            v = next(np.array(m[3:]) for m in moves if m[:2] == (k, t))
            noise = [draw(f"move {c}", F.lit(t)) for c in "xyz"] + [draw("move clock", F.lit(t))]
            x = x + np.append(v, 0.0) + np.stack([n * s for n, s in zip(noise, (SIGMA, SIGMA, SIGMA, SIGMA_CLOCK))], 1)
            for o in obs:
                if o[:2] == (k, t):
                    res = o[5] - np.linalg.norm(x[:, :3] - np.array(o[2:5]), axis=1) - x[:, 3]
                    lw = lw - 0.5 * res * res / 25
            out[k, t] = (x.copy(), lw.copy(), list(source))
            w = np.exp(lw - lw.max())
            source = ids
            if w.sum() ** 2 / (w * w).sum() < 0.5 * N:
                u0 = keyed(spark, clouds.uniform(SEED, F.lit("resample"), F.lit(t), F.col("track")), track=[k])[0]
                c = np.cumsum(w) / w.sum()
                source = [min(int(np.searchsorted(c, (u0 + j) / N, "right")), N - 1) for j in range(N)]
                x, lw = x[source], np.zeros(N)
    return out


def test_filter_lineages_and_backward_paths_equal_plain_loops(spark, small_blocks):
    starts, m, o, moves, obs = world(spark)
    made = clouds.run_filter(starts, m, o, N, weigh, sigma=SIGMA, sigma_clock=SIGMA_CLOCK, seed=SEED)
    want = plain_filter(spark, moves, obs)
    held = {}
    for t, cloud in enumerate(made):
        for k in TRUE:
            got = cloud.where(F.col("track") == k).orderBy("id").toPandas()
            x, lw, source = want[k, t]
            np.testing.assert_allclose(got[clouds.STATE].to_numpy(), x, atol=1e-6)
            np.testing.assert_allclose(got["log_weight"].to_numpy(), lw, rtol=1e-7, atol=1e-6)
            assert [None if s != s or s is None else int(s) for s in got["source"]] == source
            held[k, t] = got
    assert any(want[k, t][2] != list(range(N)) for k, t in want if t)

    paths = 5
    draws = clouds.final_draws(made[-1], paths, SEED)
    noise = {}
    for what, t in [("final", None), *[("back", t) for t in range(EPOCHS - 1)]]:
        rows = [(k, p, i) for k in TRUE for p in range(paths) for i in range(N)]
        column = clouds.gumbel(SEED, F.lit(what), *([F.lit(t)] if t is not None else []), "track", "path", "id")
        noise[what, t] = dict(zip(rows, keyed(spark, column, track=[x[0] for x in rows], path=[x[1] for x in rows], id=[x[2] for x in rows])))
    pick = lambda k, p, lw, what, t: max(range(N), key=lambda i: lw[i] + noise[what, t][k, p, i])
    lineage, backward = {}, {}
    for k in TRUE:
        for p in range(paths):
            i = j = pick(k, p, held[k, EPOCHS - 1]["log_weight"].to_numpy(), "final", None)
            lineage[k, p, EPOCHS - 1] = backward[k, p, EPOCHS - 1] = i
            for t in range(EPOCHS - 2, -1, -1):
                i = lineage[k, p, t] = want[k, t + 1][2][i]
                x, ahead = held[k, t][clouds.STATE].to_numpy(), held[k, t + 1][clouds.STATE].to_numpy()[j]
                off = ahead[:3] - x[:, :3] - np.array(next(q[3:] for q in moves if q[:2] == (k, t + 1)))
                lw = held[k, t]["log_weight"].to_numpy() - 0.5 * (off**2).sum(1) / SIGMA**2 - 0.5 * (ahead[3] - x[:, 3]) ** 2 / SIGMA_CLOCK**2
                j = backward[k, p, t] = pick(k, p, lw, "back", t)
    assert {(r.track, r.path, r.epoch): r.id for r in clouds.trace_lineages(made, draws).collect()} == lineage
    got = clouds.backward_paths(made, m, paths, SIGMA, SIGMA_CLOCK, SEED)
    assert {(r.track, r.path, r.epoch): r.id for r in got.collect()} == backward
    states = clouds.path_states(made, got).where("track = 1 and path = 2").orderBy("epoch").toPandas()
    for t in range(EPOCHS):
        np.testing.assert_allclose(states[clouds.STATE].to_numpy()[t], held[1, t][clouds.STATE].to_numpy()[backward[1, 2, t]])
    back = clouds.run_filter(starts, clouds.reversed_moves(m), o.withColumn("epoch", EPOCHS - 1 - F.col("epoch")), N, weigh, sigma=SIGMA, sigma_clock=SIGMA_CLOCK, seed=SEED + 1)
    both = clouds.smooth_both_ways(made, back).collect()
    assert {(r.track, r.epoch) for r in both} == set(want)
    one = next(r for r in both if (r.track, r.epoch) == (1, 2))
    est = [particles.posterior(c, ["track"], ["x"]).where("track = 1").first()["mean_x"] for c in (made[2], back[EPOCHS - 3])]
    assert one.x == pytest.approx(sum(est) / 2)
    clouds.forget(back)


@pytest.mark.parametrize("block", [3, 64])
def test_resampling_of_any_weights(spark, block):
    r = random.Random(9)
    sets = {1: [0.0] * 40, 2: [-1e9] * 39 + [0.0], 3: [r.uniform(-6, 0) for _ in range(40)], 4: [0.0], 5: [-800.0, -800.5, -801.0]}
    df = spark.createDataFrame([(k, i, lw, float(i)) for k, v in sets.items() for i, lw in enumerate(v)], "track long, id long, log_weight double, x double").repartition(4)
    got = {}
    for row in clouds.resample(df, 40, F.lit(0.37), ["x"], block).collect():
        assert row.x == row.source and (row.track, row.id) not in got
        got[row.track, row.id] = row.source
    for k, v in sets.items():
        w = np.exp(np.array(v) - max(v))
        c = np.cumsum(w) / w.sum()
        assert [got[k, j] for j in range(40)] == [min(int(np.searchsorted(c, (0.37 + j) / 40, "right")), len(v) - 1) for j in range(40)]


def test_draws_without_a_finite_weight_and_no_epochs(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([float("-inf"), float("nan"), None, float("-inf")])] + [(2, 0, float("-inf")), (2, 1, -3.0)], "track long, id long, log_weight double")
    got = {(r.track, r.path): r.id for r in clouds.final_draws(df, 30, 5).collect()}
    assert len({v for (k, _), v in got.items() if k == 1}) > 1 and {v for (k, _), v in got.items() if k == 2} == {1}
    starts, m, o, *_ = world(spark)
    assert clouds.run_filter(starts, m.limit(0), o, N, weigh) == []


def test_keyed_draws_are_normal(spark):
    v = np.array([r[0] for r in spark.range(20_000).select(clouds.normal(3, "id")).collect()])
    assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and len(set(v)) == 20_000
