"""Steps whose tables grow on the way: the plan must not send them through the driver, nor one key's rows through one task."""

import math
import random

import numpy as np
import pytest

from orbitlake.operators import audit, graph, inertial, joins, particles, rays, shades
from orbitlake.plans.all_queries import QUERIES
from orbitlake.streaming import navigation_filter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_a_replay_are_never_broadcast(spark):
    e = spark.createDataFrame([("a", k, 1.0, 2.0) for k in range(6)] + [("b", 0, 1.0, 2.0)], "u string, k long, base double, other double")
    chunks = spark.createDataFrame([("a", 1, 2), ("a", 2, 4), ("c", 0, 9)], "u string, start int, end int")
    out = audit.replay(e, chunks, ["u"], "k", "base", "other")
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.u, r.k, r.error) for r in out.collect()) == [("a", k, 2.0 if 1 <= k <= 4 else 1.0) for k in range(6)] + [("b", 0, 1.0)]


def windows_of(spark):
    e = spark.createDataFrame([("a", 1.0, 0.5, 1), ("a", 31.0, 0.7, 2), ("a", 45.0, 0.1, 3), ("b", 1.0, 0.5, 4)], "u string, s double, p double, id int")
    return audit.expand_windows(e, spark.createDataFrame([("a", 0, 100.0), ("a", 1, 50.0)], "u string, i int, rate double"), ["u"], "s", "i", "rate")


def test_windows_are_never_broadcast(spark):
    out = windows_of(spark)
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.id, r.i, r.rate) for r in out.collect()) == [(1, 0, 100.0), (2, 1, 50.0), (3, 1, 50.0), (4, 0, None)]


def test_budgets_over_windows_are_never_broadcast(spark):
    out = audit.budgeted_top(windows_of(spark).where("rate is not null"), ["u", "i"], "rate", "p", ["id"])
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.id, r.chosen) for r in out.collect()) == [(1, True), (2, True), (3, False)]


def sky_and_cloud(spark):
    r = random.Random(4)
    p = [(i % 2, i, *[r.uniform(-50, 50) for _ in range(3)], 1.0) for i in range(40)] + [(0, 90, None, 0.0, 0.0, 1.0), (7, 91, 0.0, 0.0, 0.0, 1.0), (None, 92, 0.0, 0.0, 0.0, 1.0)]
    o = [(i % 2, r.uniform(-900, 900), 1000.0 + i, 2000.0 - i, 2200.0 + r.uniform(-90, 90), 1.0 + i % 2, 3000.0 + i / 7) for i in range(30)]
    o += [(0, 1.0, 2.0, 2200.0, 2180.0, None, 3.0), (1, 1.0, 2.0, None, 2180.0, 1.0, 3.0), (3, 1.0, 2.0, 3.0, 4.0, 1.0, 3.0)]
    return spark.createDataFrame(p, "epoch int, id long, x double, y double, z double, clock double"), spark.createDataFrame(o, "epoch int, sx double, sy double, sz double, pr double, w double, phase double")


@pytest.mark.parametrize("kind", ["plain", "gate", "student", "huber", "mixture", "phase"])
def test_weights_by_blocks_equal_those_of_pairs(spark, kind, monkeypatch):
    p, o = sky_and_cloud(spark)
    keys, met = ["epoch", "id"], particles.residuals(p, o, ["epoch"])
    options = {"plain": {}, "gate": {"gate": 40.0}, "student": {"nu": 3.0}, "huber": {"huber": 1.5}}
    monkeypatch.setattr(particles.paired_sums, "__defaults__", (None, [], 7))
    if kind == "mixture":
        want, got = particles.weight_mixture(met, keys, 10.0, 0.7, 20.0, 50.0), particles.cloud_mixture_weights(p, o, ["epoch"], keys, 10.0, 0.7, 20.0, 50.0)
    elif kind == "phase":
        want, got = particles.weight_phase(met, keys, "phase", 0.7, 0.1), particles.cloud_phase_weights(p, o, ["epoch"], keys, "phase", 0.7, 0.1)
    else:
        want, got = particles.weight_code(met, keys, 30.0, **options[kind]), particles.cloud_code_weights(p, o, ["epoch"], keys, 30.0, **options[kind])
    told = lambda df: {(r.epoch, r.id): r.log_weight if r.log_weight is None else round(r.log_weight, 6) for r in df.collect()}
    assert told(got) == told(want) and len(told(got)) == 41


@pytest.mark.parametrize("query", ["particle_code_weights", "particle_student_weights", "particle_huber_weights", "particle_mixture_weights", "particle_phase_weights"])
def test_a_cloud_and_its_sky_are_dealt_into_blocks(spark, query):
    assert "FlatMapCoGroupsInArrow" in plan(QUERIES[query](spark, "/root/testdata/sf0.001"))


def test_clocks_are_recentred_without_pairs(spark):
    text = plan(QUERIES["particle_clock_recentre"](spark, "/root/testdata/sf0.001"))
    assert text.count("Join ") == 1


def test_nearest_of_many_references_meets_few_of_them(spark):
    r = random.Random(5)
    refs = [(i, r.uniform(0, 50), r.uniform(0, 50)) for i in range(600)] + [(900, 25.0, 190.0), (5, 7.0, 7.0), (3, 7.0, 7.0), (901, None, 1.0)]
    pts = [(i, r.uniform(-60, 120), r.uniform(-60, 400)) for i in range(300)] + [(300, 7.0, 7.0), (301, None, 1.0)]
    out = joins.nearest_point(spark.createDataFrame(pts, "k int, x double, y double"), spark.createDataFrame(refs, "l int, x double, y double"), "k", ["x", "y"], "l", 100.0)
    want = {}
    for k, x, y in pts:
        near = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), label) for label, a, b in refs if x is not None and a is not None]
        if near and min(near)[0] <= 100.0:
            want[k] = min(near)
    assert {x.k: (pytest.approx(x.distance), x.l) for x in out.collect()} == {k: (d, label) for k, (d, label) in want.items()}
    assert joins._finer(spark.createDataFrame([(600,)], "count long"), 8, 4) == 4  # cells of 6.25 to start with


def test_best_of_many_records_meets_few_of_them(spark):
    r = random.Random(6)
    recs = [(i % 2, i, float(r.randrange(0, 9000)), i % 3) for i in range(400)] + [(0, 900, 604790.0, 1), (0, 901, 300000.0, 1), (0, 902, 300000.0, 2), (1, 903, None, 1)]
    asks = [(i, i % 3, float(r.randrange(0, 20000))) for i in range(200)] + [(500, 0, 604799.0), (501, 0, 301000.0), (502, 0, 604000.0), (503, None, 5.0), (504, 1, None)]
    out = joins.best_record(spark.createDataFrame(asks, "k int, prn int, t double"), spark.createDataFrame(recs, "prn int, rec int, toe double, priority int"), "prn", "t", "toe", 7200.0, "priority")
    want = {}
    for k, prn, t in asks:
        near = [(min(abs(t - toe), 604800 - abs(t - toe)), -p, rec) for s, rec, toe, p in recs if s == prn and toe is not None and t is not None]
        if near and min(near)[0] <= 7200:
            want[k] = min(near)
    assert {x.k: (x.dt, -x.priority, x.rec) for x in out.collect()} == want and want[501][2] == 902


@pytest.mark.parametrize("query, table", [("best_ephemeris", "o_orderkey"), ("nearest_reference", "c_custkey")])
def test_near_rows_come_as_one_list_a_cell(spark, query, table):
    text = plan(QUERIES[query](spark, "/root/testdata/sf0.001"))
    assert "Generate explode" not in text and "BroadcastHashJoin" not in text


def test_cells_of_intervals_are_never_broadcast(spark):
    samples = spark.createDataFrame([("a", float(t), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0) for t in range(0, 5000, 10)], "track string, t double, ax double, ay double, az double, gx double, gy double, gz double")
    out = inertial.preintegrate(samples, spark.createDataFrame([("a", 0.0), ("a", 4990.0)], "track string, t double"), width=7.0)
    assert "BroadcastHashJoin [track" not in plan(out)
    (r,) = out.collect()
    assert r.samples == 500 and r.dvx == pytest.approx(4.99)


def test_each_epoch_is_inverted_once(spark):
    text = plan(QUERIES["fault_exclusion"](spark, "/root/testdata/sf0.001"))
    assert text.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("most", [(8192, 4096, 20_000), (9, 7, 50)])
def test_weights_by_sight_in_bundles_equal_those_of_rays(spark, most, monkeypatch):
    for name, v in zip(("GROUP_PARTICLES", "GROUP_SATELLITES", "TRIANGLES"), most):
        monkeypatch.setattr(shades, name, v)
    r = random.Random(8)
    p = [(i % 2, i, r.uniform(0, 90), r.uniform(0, 90), r.uniform(0, 4), 1.0) for i in range(80)] + [(0, 90, None, 0.0, 0.0, 1.0), (1, 91, math.nan, 0.0, 0.0, 1.0), (7, 92, 0.0, 0.0, 0.0, 1.0)]
    o = [(i % 2, r.uniform(-900, 900), r.uniform(-900, 900), r.uniform(5, 2000), 900 + r.uniform(-90, 900), 1.0 + i % 2) for i in range(30)] + [(0, 40.0, 50.0, 3.0, 30.0, 1.0), (1, 1.0, 2.0, None, 2180.0, 1.0), (0, 1.0, 2.0, 30.0, 2180.0, None)]
    tri = [tuple(c + r.gauss(0, 9) for _ in range(3) for c in middle) for middle in ((r.uniform(0, 90), r.uniform(0, 90), r.uniform(0, 20)) for _ in range(150))]
    tri += tri[:40] + [(1.0, 2.0, 3.0) * 3, (None, *[1.0] * 8), (0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 18.0, 0.0, 0.0)]
    p, o = spark.createDataFrame(p, "epoch int, id long, x double, y double, z double, clock double"), spark.createDataFrame(o, "epoch int, sx double, sy double, sz double, pr double, w double")
    mesh, keys = spark.createDataFrame(tri, ", ".join(f"{c} double" for c in rays.CORNERS)), ["epoch", "id"]
    told = lambda df: {(x.epoch, x.id): x.log_weight if x.log_weight is None or math.isnan(x.log_weight) else round(x.log_weight, 6) for x in df.collect()}
    for chances in ((), (0.9, 0.05)):
        for m in (mesh, mesh.limit(0)):
            want = told(rays.weight_by_sight(particles.residuals(p, o, ["epoch"]), m, keys, 30.0, 150.0, 15.0, *chances))
            assert str(sorted(told(shades.cloud_sight_weights(p, o, m, ["epoch"], keys, 30.0, 150.0, 15.0, *chances)).items())) == str(sorted(want.items())) and len(want) == 82


def test_rays_of_a_cloud_are_no_rows(spark):
    text = plan(QUERIES["particle_sight_weights"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in text and "FlatMapCoGroups" not in text


def test_tracks_of_a_batch_step_together_as_alone(spark):
    r, origin = random.Random(9), (50.0, -50.0, 20.0, 90.0)
    rows = [(k, float(t), *[r.choice((-1, 1)) * r.uniform(1e6, 2e7) for _ in range(3)], r.uniform(1e7, 3e7), r.choice((0.0, 0.04, 1.0))) for k in range(30) for t in sorted(r.sample(range(90), r.randrange(1, 12))) for _ in range(r.randrange(1, 7))]
    df = spark.createDataFrame(rows, "track long, t double, sx double, sy double, sz double, pr double, w double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = sorted(map(tuple, navigation_filter.filter_batch(df, origin).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = df.toPandas()
    want = [(k, *x) for k, g in frame.groupby("track") for x in navigation_filter.epochs(g, None, origin)[0]]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6, abs=1e-3)


def test_a_batch_takes_one_step_for_all_its_tracks(monkeypatch):
    calls, step = [], navigation_filter.step_all
    monkeypatch.setattr(navigation_filter, "step_all", lambda *a: (calls.append(len(a[0])), step(*a))[1])
    m = np.array([[float(t), 2e7, 1e6 * i, 1e6, 2.1e7, 1.0] for _ in range(50) for t in range(3) for i in range(4)])
    out, _ = navigation_filter.epochs_of_all(np.repeat(np.arange(50), 12), m, None, (0.0, 0.0, 0.0, 0.0))
    assert calls == [50, 50, 50] and len(out) == 150


def test_tracks_of_one_chunk_write_no_rounds(spark, monkeypatch):
    r, tables, write = random.Random(11), [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (tables.append(1), write(df))[1])
    sky = [[r.choice((-1, 1)) * r.uniform(5e6, 2e7) for _ in range(3)] for _ in range(7)]
    obs = spark.createDataFrame([(k, float(t), *s, math.dist(s, (9.0 * t, 5.0, k)) + 40.0 + r.uniform(-3, 3)) for k in range(4) for t in range(12) for s in sky], "track long, t double, sx double, sy double, sz double, pr double")
    start = spark.createDataFrame([(k, float(t), 300.0, -200.0, 90.0, 0.0) for k in range(4) for t in range(12)], "track long, t double, x double, y double, z double, c0 double")
    solve = lambda span: {(x.track, x.t): x for x in graph.solve_tracks(obs, start, motion_sigma=20.0, huber=1.5, rounds=6, tol=1e-3, span=span).collect()}
    one, written = solve(1e6), len(tables)
    many = solve(5.0)
    assert written == 4 < len(tables) - written and one.keys() == many.keys() and len(one) == 48
    for k, x in one.items():
        assert x.rounds == many[k].rounds > 1 and [x.x, x.y, x.z, x.c0, x.cost, x.mse] == pytest.approx([many[k].x, many[k].y, many[k].z, many[k].c0, many[k].cost, many[k].mse], rel=1e-6, abs=1e-4)


def test_leaves_meet_only_triangles_near_their_own_rays(monkeypatch):
    """Before, each leaf of a bundle was held against the triangles near any leaf's rays."""
    r, held, least = np.random.default_rng(3), [], shades._least
    monkeypatch.setattr(shades, "_least", lambda g: (held.append(g.size * (g.ndim != 3)), least(g))[1])  # three: of single rays
    place = np.column_stack([r.uniform(0, 500, (1024, 2)), np.full(1024, 1.7)])
    way = r.normal(size=(120, 3)) * 0.05 + (0.0, 1.0, 1.0)
    sats = 2e5 * way / np.linalg.norm(way, axis=1)[:, None]
    tri = np.column_stack([r.uniform(0, 600, (2000, 2)), r.uniform(0, 25, 2000)])[:, None] + r.normal(size=(2000, 3, 3)) * 3
    blocked = np.zeros((1024, 120), bool)
    shades.shade(blocked, place, sats, tri)
    assert sum(held) < 30 * blocked.size
    for i in range(0, 1024, 64):
        want = rays.meets(np.repeat(place[i : i + 1], 120, axis=0), sats, np.broadcast_to(tri, (120, *tri.shape))).any(axis=1)
        assert (blocked[i] == want).all() and not want.all()
