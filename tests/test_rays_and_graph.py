import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import graph, rays
from orbitlake.sources import meshes


def frames(spark, ends, tri):
    r = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(ends)], "id long, " + ", ".join(f"{c} double" for c in rays.ENDS))
    return r, spark.createDataFrame([tuple(map(float, x.ravel())) for x in tri], ", ".join(f"{c} double" for c in rays.CORNERS))


def random_scene(seed, n_tri, n_rays, extent=400.0, at=(0.0, 0.0, 0.0)):
    r = np.random.default_rng(seed)
    middle = r.uniform(0, extent, (n_tri, 1, 3)) * [1, 1, 0.2]
    size = np.where(r.random((n_tri, 1, 1)) < 0.05, 120.0, 6.0)
    tri = middle + r.normal(0, 1, (n_tri, 3, 3)) * size
    start = r.uniform(-20, extent + 20, (n_rays, 3)) * [1, 1, 0.2]
    far = r.random((n_rays, 1)) < 0.5
    way = r.normal(0, 1, (n_rays, 3))
    way[::7, 0] = 0.0
    way[::11, 1:] = 0.0
    way[::77, 2] = 1.0
    stop = start + way / np.linalg.norm(way, axis=1, keepdims=True) * np.where(far, 2.0e7, r.uniform(0.5, 300, (n_rays, 1)))
    return np.hstack([start + at, stop + at]), tri + at


@pytest.mark.parametrize("seed, at, edge, group", [(1, (0.0, 0.0, 0.0), 64.0, (100_000, 20_000)), (2, (-3.9e6, 3.3e6, 3.7e6), 16.0, (37, 11)), (3, (0.0, 0.0, 0.0), 1000.0, (50, 7))])
def test_indexed_sight_equals_all_pairs(spark, seed, at, edge, group):
    ends, tri = random_scene(seed, 300, 600, at=at)
    plain = meshes.hits(ends[:, :3], ends[:, 3:], tri)
    assert 0.1 < plain.mean() < 0.9
    left, mesh = frames(spark, ends, tri)
    blocked = rays.blocked_rays(left, mesh, edge, *group).toPandas().to_numpy()
    assert {tuple(x) for x in blocked} == {tuple(x) for x in ends[plain]}
    los = {r.id: r.los for r in rays.sight_lines(left, mesh, edge).collect()}
    assert los == {i: not b for i, b in enumerate(plain)}


def test_tree_equals_all_pairs_at_any_size():
    for n in (1, 2, 8, 9, 200):
        ends, tri = random_scene(n, n, 300, extent=60.0)
        assert (rays.BoxTree(tri).hit(ends[:, :3], ends[:, 3:]) == meshes.hits(ends[:, :3], ends[:, 3:], tri)).all()


def test_tiles_hold_every_point_of_a_segment():
    r = np.random.default_rng(5)
    low, high, edge = np.array([-50.0, 3.0, 0.0]), np.array([80.0, 90.0, 41.0]), 8.0
    ends = r.uniform(-90, 130, (200, 6))
    ends[:5, 3:] = ends[:5, :3]
    ends[5:30, 3] = ends[5:30, 0]
    row, code = rays.tiles_crossed(ends, low, high, edge)
    got = set(zip(row.tolist(), code.tolist()))
    for i, x in enumerate(ends):
        p = x[:3] + np.linspace(0, 1, 2001)[:, None] * (x[3:] - x[:3])
        p = p[((p >= low) & (p <= high)).all(axis=1)]
        cell = np.floor((p - low) / edge).astype(np.int64)
        assert {(i, int(c)) for c in rays.morton(cell[:, 0], cell[:, 1], cell[:, 2])} <= got


def test_sight_of_odd_rows(spark):
    mesh = meshes.box(spark, (0.0, 0.0, 0.0), 2.0, 4.0, 6.0)
    rows = [(1, -9.0, 0.1, 0.2, 9.0, 0.1, 0.2), (1, -9.0, 0.1, 0.2, 9.0, 0.1, 0.2), (2, None, 0.0, 0.0, 1.0, 1.0, 1.0), (3, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0), (4, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (None, 5.0, 5.0, 5.0, 6.0, 6.0, 6.0)]
    df = spark.createDataFrame([(*x, "was") for x in rows], "x0 long, " + ", ".join(f"{c} double" for c in rays.ENDS) + ", los string")
    got = sorted(((r.x0, r.los) for r in rays.sight_lines(df, mesh).collect()), key=str)
    assert got == sorted([(1, False), (1, False), (2, None), (3, None), (4, True), (None, True)], key=str)
    assert all(r.los in (True, None) for r in rays.sight_lines(df, mesh.limit(0)).collect())
    assert rays.sight_lines(df.limit(0), mesh).count() == 0


def test_weights_by_sight(spark):
    mesh = meshes.box(spark, (0.0, 0.0, 0.0), 2.0, 4.0, 6.0)
    rows = [(1, -9.0, 0.1, 0.2, 9.0, 0.1, 0.2, 12.0, 1.0), (1, -9.0, 0.1, 0.2, -99.0, 0.1, 0.2, -3.0, 2.0), (2, -9.0, 0.1, 0.2, 9.0, 0.1, 0.2, -4.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, sx double, sy double, sz double, r double, w double")
    got = {r.id: r.log_weight for r in rays.weight_by_sight(df, mesh, ["id"], 3.0, 30.0, 15.0).collect()}
    assert got == pytest.approx({1: -0.5 * 9 / 900 - 0.5 * 2 * 9 / 9, 2: -0.5 * 16 / 900})
    got = {r.id: r.log_weight for r in rays.weight_by_sight(df, mesh, ["id"], 3.0, 30.0, 15.0, 0.9, 0.05).collect()}
    mix = lambda a, b, p: np.log((1 - p) * np.exp(a) + p * np.exp(b))
    assert got[2] == pytest.approx(mix(-0.5 * 16 / 9, -0.5 * 16 / 900, 0.9))
    assert got[1] == pytest.approx(mix(-0.5 * 144 / 9, -0.5 * 9 / 900, 0.9) + mix(-0.5 * 18 / 9, -0.5 * 18 / 900, 0.05))


TRUE = np.array([-3.8e6, 3.5e6, 3.6e6])


def reach(p, sat):
    turn = graph.EARTH_RATE * np.linalg.norm(p - sat) / graph.C_LIGHT
    c, s = np.cos(turn), np.sin(turn)
    return p - np.array([sat[0] * c + sat[1] * s, sat[1] * c - sat[0] * s, sat[2]])


def problem(seed, n_epoch, n_sat, clocks, steps):
    r = np.random.default_rng(seed)
    sat = r.normal(0, 5e6, (n_epoch, n_sat, 3)) + TRUE * 3
    system = r.integers(0, clocks, (n_epoch, n_sat))
    path = TRUE + np.cumsum(r.normal(0, 1.0, (n_epoch, 3)), axis=0)
    clock = np.array([150.0, 35.0])[:clocks]
    design = np.stack([np.ones(system.shape), *[system == k for k in range(1, clocks)]], -1).astype(float)
    rng = np.array([[np.linalg.norm(reach(path[t], sat[t, s])) for s in range(n_sat)] for t in range(n_epoch)])
    pr = rng + design @ clock + r.normal(0, 2.0, rng.shape)
    pr[n_epoch // 2, 0] += 60.0
    w = np.where(r.random(rng.shape) < 0.1, 0.0, 0.3)
    w[:, :4] = 0.3
    move = np.zeros(rng.shape)
    for t in range(1, n_epoch):
        for s in range(n_sat):
            move[t, s] = reach(path[t], sat[t, s]) @ (path[t] - path[t - 1]) / np.linalg.norm(reach(path[t], sat[t, s]))
    step_w = np.where(steps & (r.random(rng.shape) < 0.7), 400.0, 0.0)
    state = np.hstack([path + r.normal(0, 100.0, path.shape), clock + r.normal(0, 4, (n_epoch, clocks))])
    motion = np.vstack([np.zeros(3), np.diff(path, axis=0)]) + r.normal(0, 0.1, (n_epoch, 3))
    return {"sat": sat, "system": system, "design": design, "pr": pr, "w": w, "step": move, "step_w": step_w, "state": state, "motion": motion}


def terms(p, x, sigma, huber):
    """Rows of the whole problem at once: (Jacobian of the prediction, residual, weight, cost)."""
    n, m = p["pr"].shape
    ss = x.shape[1]
    for t in range(n):
        for s in range(m):
            d = reach(x[t, :3], p["sat"][t, s])
            r = np.linalg.norm(d)
            h = np.concatenate([d / r, p["design"][t, s]])
            if p["w"][t, s] > 0:
                j = np.zeros((n, ss))
                j[t] = h
                res, w = p["pr"][t, s] - r - p["design"][t, s] @ x[t, 3:], p["w"][t, s]
                z = np.sqrt(w) * abs(res)
                yield j.ravel(), res, w * huber / z if 0 < huber < z else w, huber * z - huber**2 / 2 if 0 < huber < z else z * z / 2
            if t and p["step_w"][t, s] > 0:
                j = np.zeros((n, ss))
                j[t], j[t - 1] = h, -h
                res = p["step"][t, s] - h @ (x[t] - x[t - 1])
                yield j.ravel(), res, p["step_w"][t, s], 0.5 * p["step_w"][t, s] * res**2
    for t in range(n - 1):
        for i in range(3):
            if sigma > 0:
                j = np.zeros((n, ss))
                j[t, i], j[t + 1, i] = -1, 1
                res = p["motion"][t + 1, i] - (x[t + 1, i] - x[t, i])
                yield j.ravel(), res, 1 / sigma**2, 0.5 * res**2 / sigma**2


def dense(p, sigma, huber, rounds, tol=0.0):
    x = p["state"].copy()
    costs = []
    for _ in range(rounds):
        j, res, w, cost = (np.array(v) for v in zip(*terms(p, x, sigma, huber)))
        costs.append(cost.sum())
        dx = np.linalg.solve(j.T @ (w[:, None] * j) + graph.JITTER * np.eye(x.size), j.T @ (w * res)).reshape(x.shape)
        scale = 1.0
        for _ in range(12):
            if sum(c for *_, c in terms(p, x + scale * dx, sigma, huber)) <= costs[-1] * (1 + 1e-12):
                break
            scale /= 2
        else:
            break
        x = x + scale * dx
        if np.linalg.norm(dx) < tol:
            break
    return x, costs


def tables(spark, problems, clocks):
    obs, start = [], []
    for k, p in problems.items():
        n, m = p["pr"].shape
        obs += [(k, float(t), *map(float, p["sat"][t, s]), float(p["pr"][t, s]), float(p["w"][t, s]), int(p["system"][t, s]), float(p["step"][t, s]), float(p["step_w"][t, s])) for t in range(n) for s in range(m)]
        start += [(k, float(t), *map(float, p["state"][t]), *map(float, p["motion"][t])) for t in range(n)]
    o = spark.createDataFrame(obs, "track long, t double, sx double, sy double, sz double, pr double, w double, system int, step double, step_w double")
    return o.repartition(3), spark.createDataFrame(start, "track long, t double, x double, y double, z double, " + "".join(f"c{i} double, " for i in range(clocks)) + "mx double, my double, mz double")


@pytest.mark.parametrize("clocks, sigma, huber, steps, span, rounds", [(1, 0.0, 0.0, False, 64.0, 1), (1, 0.6, 1.15, True, 3.0, 1), (2, 0.6, 0.0, True, 1.0, 4), (2, 0.6, 1.15, True, 4.0, 5)])
def test_tracks_equal_a_dense_solve(spark, clocks, sigma, huber, steps, span, rounds):
    problems = {k: problem(10 * k + clocks, n, m, clocks, steps) for k, (n, m) in enumerate([(1, 8), (3, 6), (7, 5), (17, 7)])}
    out = graph.solve_tracks(*tables(spark, problems, clocks), clocks, sigma, huber, rounds, 0.0, True, span).toPandas()
    for k, p in problems.items():
        x, _ = dense(p, sigma, huber, rounds)
        got = out[out.track == k].sort_values("t")
        np.testing.assert_allclose(got[["x", "y", "z", *[f"c{i}" for i in range(clocks)]]].to_numpy(), x, rtol=0, atol=2e-5)


def test_cost_falls_to_the_same_least_for_any_chunks(spark):
    p = problem(5, 40, 7, 2, True)
    o, s = tables(spark, {1: p, 2: problem(6, 12, 6, 2, True)}, 2)
    ways = [graph.solve_tracks(o, s, 2, 0.5, 1.5, tol=1e-3, span=span).orderBy("track", "t").toPandas() for span in (5.0, 1000.0)]
    np.testing.assert_allclose(*[w[["x", "y", "z", "c0", "c1"]].to_numpy() for w in ways], rtol=0, atol=1e-4)
    x, costs = dense(p, 0.5, 1.5, 30, 1e-3)
    one = ways[0][ways[0].track == 1]
    assert one["cost"].iloc[0] == pytest.approx(sum(c for *_, c in terms(p, x, 0.5, 1.5)), rel=1e-6)
    assert len(one) == 40 and np.linalg.norm(one[["x", "y", "z"]].to_numpy() - x[:, :3], axis=1).max() < 1e-3


def test_odd_rows_of_tracks(spark):
    p = problem(9, 6, 6, 1, False)
    o, s = tables(spark, {1: p}, 1)
    more = o.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, 0.0, 0.0), (1, 2.0, None, 1.0, 1.0, 1.0, 1.0, 0, 0.0, 0.0), (1, 3.5, 1.0, 2.0, 3.0, 4.0, 1.0, 0, 0.0, 0.0)], o.schema))
    alone = spark.createDataFrame([(8, 0.0, *map(float, TRUE), 1.0, 0.0, 0.0, 0.0), (8, 70.0, *map(float, TRUE + 10), 1.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], s.schema)
    a = graph.solve_tracks(o, s, 1, 0.5, tol=1e-2).toPandas()
    b = graph.solve_tracks(more, s.unionByName(alone), 1, 0.5, tol=1e-2).toPandas()
    cols = ["x", "y", "z", "c0"]
    np.testing.assert_allclose(b[b.track == 1].sort_values("t")[cols].to_numpy(), a.sort_values("t")[cols].to_numpy(), rtol=0, atol=1e-6)
    still = b[b.track == 8].sort_values("t")
    assert len(still) == 2 and np.abs(still[["x", "y", "z"]].to_numpy() - (TRUE + 5)).max() < 0.1
    assert graph.solve_tracks(o.limit(0), s.limit(0), 1).count() == 0


def test_cost_of_chunks_without_observations():
    """A slice of a batch can hold no observation at all: the motion's cost alone is a fraction."""
    chunks = graph.Chunks(np.array([2, 1]), np.array([0, 0]), np.zeros(3, np.int64), np.empty((0, 8)), np.zeros((3, 3)), 1)
    state = np.zeros((2, 2, 4))
    state[0, 1, 0] = 0.5
    cost, squares, number = chunks.cost(state, 2.0, 0.0)
    np.testing.assert_allclose(cost, [0.25, 0.0])
    assert squares.dtype == float and number.tolist() == [0, 0]


def test_computed_ranges_are_not_made_anew_in_a_filter(spark):
    """Before, a filter held each range's formula twice for each of its parts, 70 s of one task on sf0.1."""
    rows = [(1, 0.0, 2e7, 1e6, 3e6, 40.0), (1, 0.0, None, 1e6, 3e6, 40.0), (1, 0.0, float("nan"), 1e6, 3e6, 40.0), (1, 1.0, None, 1e6, 3e6, 40.0), (None, 1.0, 2e7, 1e6, 3e6, 40.0), (1, float("nan"), 2e7, 1e6, 3e6, 40.0)]
    o = spark.createDataFrame(rows, "track long, t double, sx double, sy double, sz double, k double")
    o = o.withColumn("pr", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")) + F.col("k"))
    s = spark.createDataFrame([(1, float(t), 0.0, 0.0, 0.0, 0.0) for t in range(3)], "track long, t double, x double, y double, z double, c0 double")
    chunks = graph.packed(o, s, 1, 64.0)
    text = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in text and not any("SQRT" in line for line in text.split("\n") if "Filter" in line)
    (row,) = chunks.collect()
    assert list(row.counts) == [1, 0, 0] and row.obs[:3] == [2e7, 1e6, 3e6] and row.obs[3] == pytest.approx(math.sqrt(4e14 + 1e12 + 9e12) + 40.0)


def test_a_round_of_tracks_of_one_chunk_builds_one_system(spark, monkeypatch):
    """Before, each round built and eliminated the systems twice: at the point it took, and again to step from there."""
    p = problem(5, 12, 7, 1, True)
    o, s = tables(spark, {1: p}, 1)
    part = graph.packed(o, s, 1, 1e6).drop("alone").toArrow().combine_chunks().to_batches()[0]
    calls, normal = [], graph.Chunks.normal
    monkeypatch.setattr(graph.Chunks, "normal", lambda *a: (calls.append(1), normal(*a))[1])
    (out,) = graph._alone(1, 4.0, 1.5, 4, 0.0, True)([part])
    x, _ = dense(p, 0.5, 1.5, 4)
    assert out["rounds"].to_pylist() == [4] and len(calls) == 5
    np.testing.assert_allclose(np.array(out["base"][0].as_py()).reshape(-1, 4), x, rtol=0, atol=2e-5)
