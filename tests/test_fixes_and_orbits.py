import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.functions import orbits
from orbitlake.operators import exclusion, inertial, integers, joins


def covariance(r, n, spread):
    """Strongly correlated, as of ambiguities that share a position: small noise and a few wide directions."""
    g = r.normal(0, 1, (n, min(3, n))) * spread
    return g @ g.T + np.diag(r.uniform(0.01, 0.05, n))


def exhaustive(a, q, reach):
    p = np.linalg.inv(q)
    grid = np.array(list(itertools.product(*[range(math.floor(x) - reach, math.ceil(x) + reach + 1) for x in a])))
    d = np.einsum("ij,jk,ik->i", grid - a, p, grid - a)
    order = np.argsort(d)[:2]
    return grid[order], d[order]


def test_ambiguities_equal_an_exhaustive_search(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(120):
        n = [1, 2, 3, 4][i % 4]
        a, q = r.normal(0, 3, n) + 20, covariance(r, n, r.choice([0.05, 0.3, 0.8]))
        rows.append((i, a.tolist(), q.ravel().tolist()))
        want[i] = exhaustive(a, q, 6 if n < 4 else 5)
    df = spark.createDataFrame(rows, "id int, ambiguities array<double>, covariance array<double>").repartition(3)
    got = {x.id: x for x in integers.fix_ambiguities(df, ["id"]).collect()}
    for i, (z, d) in want.items():
        assert got[i].complete and got[i].distance <= d[0] + 1e-9
        if got[i].distance > d[0] - 1e-9:
            assert got[i].fixed == z[0].tolist() and got[i].second_distance == pytest.approx(d[1], rel=1e-6)
            assert got[i].ratio == pytest.approx(d[1] / d[0], rel=1e-6) and got[i].accepted == (got[i].ratio >= 3)
    assert sum(got[i].distance > d[0] - 1e-9 for i, (_, d) in want.items()) > 100


def test_planted_ambiguities_of_many_satellites():
    r = np.random.default_rng(5)
    n, b = 12, 40
    q = np.stack([covariance(r, n, 5.0) for _ in range(b)])
    true = r.integers(-10**6, 10**6, (b, n))
    a = true + np.einsum("bij,bj->bi", np.linalg.cholesky(q), r.normal(0, 0.3, (b, n)))
    best, far, whole = integers.resolve(a, q)
    assert whole.all() and (far[:, 0] <= far[:, 1]).all()
    p = np.linalg.inv(q)
    for k in range(2):
        np.testing.assert_allclose(far[:, k], np.einsum("bi,bij,bj->b", best[:, k] - a, p, best[:, k] - a), rtol=1e-5)
    assert (far[:, 0] <= np.einsum("bi,bij,bj->b", true - a, p, true - a) * (1 + 1e-5)).all()
    z = integers.reduced(q)
    assert (np.abs(np.rint(np.linalg.det(z))) == 1).all()
    # against the first axes alone, the reduced ones are nearly of one length
    d = integers.factor(z @ q @ np.swapaxes(z, 1, 2))[1]
    assert (d.max(1) / d.min(1)).max() < 1e-2 * (integers.factor(q)[1].max(1) / integers.factor(q)[1].min(1)).max()


def test_odd_ambiguities(spark):
    rows = [(1, None, [1.0]), (2, [], []), (3, [0.5, 1.0], [1.0]), (4, [1.5], [-1.0]), (5, [float("nan")], [1.0]), (6, [3.0], [0.2]), (7, [0.3, None], [1.0, 0.0, 0.0, 1.0]), (None, [0.3], [1.0]), (8, [0.1, 0.2], [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, ambiguities array<double>, covariance array<double>")
    got = {x.id: x for x in integers.fix_ambiguities(df, ["id"]).collect()}
    assert all(got[i].fixed is None and not got[i].accepted for i in (1, 2, 3, 4, 5, 7, 8))
    assert got[6].fixed == [3] and got[6].ratio == 0.0 and got[None].fixed == [0] and got[None].second == [1]
    assert integers.fix_ambiguities(df.limit(0), ["id"]).count() == 0


def test_node_limit_is_told():
    r = np.random.default_rng(1)
    q = covariance(r, 8, 1.0)[None] * 50
    a = r.normal(0, 1, (1, 8))
    best, far, whole = integers.resolve(a, q, most=1)
    assert not whole[0] and np.isfinite(far[0, 0]) and far[0, 1] == np.inf
    assert integers.resolve(a, q)[2][0] and integers.resolve(a, q)[1][0, 0] <= far[0, 0]


def design(r, n):
    u = r.normal(0, 1, (n, 3)) * [1, 1, 0.5] + [0, 0, 1.0]
    return np.hstack([-u / np.linalg.norm(u, axis=1, keepdims=True), np.ones((n, 1))])


def solved(h, y, w):
    a = h.T @ (w[:, None] * h)
    x = np.linalg.solve(a, h.T @ (w * y))
    return x, float(w @ (y - h @ x) ** 2), np.linalg.inv(a)


def test_exclusion_equals_solving_each_subset(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(60):
        n = 4 + k % 7
        h, w = design(r, n), r.uniform(0.5, 2, n)
        y = r.normal(0, 1, n) + (np.arange(n) == k % n) * (40.0 if k % 3 else 0.0) + ((np.arange(n) == (k + 2) % n) * 60.0 if k % 11 == 5 else 0)
        rows += [(k, 10 + s, *map(float, h[s]), float(y[s]), float(w[s])) for s in range(n)]
        x, sse, q = solved(h, y, w)
        subs = []
        for s in range(n if n >= 6 else 0):
            keep = np.arange(n) != s
            subs.append((*solved(h[keep], y[keep], w[keep]), 10 + s))
        want[k] = (n, x, sse, q, min(subs, key=lambda v: v[1]) if subs else None)
    df = spark.createDataFrame([*rows, (0, 99, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0), (0, 98, None, 0.0, 0.0, 1.0, 1.0, 1.0), (999, 1, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "epoch int, sat int, h0 double, h1 double, h2 double, h3 double, y double, w double").repartition(4)
    out = exclusion.exclude_fault(df, ["epoch"], "sat", ["h0", "h1", "h2", "h3"], "y", "w").collect()
    assert {x.epoch for x in out} == set(want)
    limit = lambda dof: spark.range(1).select(exclusion.chi_square_limit(F.lit(dof), 1e-3)).first()[0] if dof > 0 else 0.0
    limits = {d: limit(d) for d in range(-1, 8)}
    cut = 0
    for x in out:
        n, full, sse, q, best = want[x.epoch]
        ok = sse <= limits[n - 4] if n > 4 else True
        if ok or best is None:
            assert (x.ok, x.excluded) == (ok, None) and x.statistic == pytest.approx(sse if n > 4 else 0.0, abs=1e-8)
            step, spread = full, q
        else:
            cut += 1
            fine = best[1] <= limits[n - 5]
            assert (x.ok, x.excluded) == (fine, best[3]) and x.statistic == pytest.approx(best[1], abs=1e-6) and x.threshold == pytest.approx(limits[n - 5])
            step, spread = (best[0], best[2]) if fine else (full, q)
        np.testing.assert_allclose([x.dx, x.dy, x.dz, x.dclock], step, atol=1e-6)
        k = (x.hpl / math.sqrt(spread[0, 0] + spread[1, 1]), x.vpl / math.sqrt(spread[2, 2]))
        assert k == pytest.approx((3.0903, 3.0903), rel=1e-3) if n > 4 else x.hpl == 1e9
    assert cut > 15


def test_quadratic_join_equals_a_plain_fit(spark):
    r = np.random.default_rng(7)
    right, left, want = [], [], {}
    sizes = {"a": 60, "b": 1, "c": 2, "d": 3, "e": 0, "f": 20}
    for key, n in sizes.items():
        t, v = np.sort(r.uniform(0, 100, n)), r.normal(0, 5, n)
        if key == "f":
            t[5:9] = t[5]
        right += [(key, float(x), float(y), "extra") for x, y in zip(t, v)]
        at = [-5.0, 105.0, *r.uniform(0, 100, 25), *(t[:3] if key != "f" else [])]
        for x in at:
            left.append((key, float(x)))
            if n == 0:
                want[key, x] = None
            elif n == 1:
                want[key, x] = v[0]
            elif n >= 3 and t[0] <= x <= t[-1]:
                near = np.lexsort((v, t, np.abs(t - x)))[:8]
                want[key, x] = np.polyval(np.polyfit(t[near] - x, v[near], 2), 0.0)
            else:
                want[key, x] = np.interp(x, t, v)
    right += [("a", None, 1.0, ""), ("a", 5.0, float("nan"), ""), ("a", 6.0, None, ""), (None, 1.0, 1.0, "")]
    a = spark.createDataFrame([*left, *left[:4], (None, 1.0), ("a", None)], "k string, t double").repartition(3)
    got = {(x.k, x.t): x.v for x in joins.quadratic_join(a, spark.createDataFrame(right, "k string, t double, v double, far string"), "k", "t", "v").collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, rel=1e-6, abs=1e-6), k


def plain_glonass(x, acc, t):
    mu, re, j2, w = 3.9860044e14, 6378136.0, 1.0826257e-3, 7.292115e-5

    def rates(s):
        r = math.sqrt(s[0] ** 2 + s[1] ** 2 + s[2] ** 2)
        base, flat = -mu / r**3, 1.5 * j2 * mu * re**2 / r**5
        k = 5 * s[2] ** 2 / r**2
        return np.array([*s[3:], (base - flat * (1 - k) + w * w) * s[0] + 2 * w * s[4] + acc[0], (base - flat * (1 - k) + w * w) * s[1] - 2 * w * s[3] + acc[1], (base - flat * (3 - k)) * s[2] + acc[2]])

    s = np.array(x, float)
    while abs(t) > 1e-9:
        h = t if abs(t) < 60 else math.copysign(60, t)
        a = rates(s)
        b = rates(s + a * h / 2)
        c = rates(s + b * h / 2)
        s = s + (a + 2 * b + 2 * c + rates(s + c * h)) * h / 6
        t -= h
    return s


def test_glonass_orbits_equal_a_plain_integration(spark):
    state, acc = [7.0e6, -1.2e7, 2.1e7, 2100.0, 2400.0, 600.0], [1e-6, -2e-6, 0.5e-6]
    times = [0.0, 1.0, -1.0, 60.0, 899.5, -899.5, 1800.0, 604800.0 - 30.0]
    df = spark.createDataFrame([(t, *state, *acc) for t in times] + [(None, *state, *acc), (1.0, None, *state[1:], *acc)], "t double, " + ", ".join(f"s{i} double" for i in range(6)) + ", a0 double, a1 double, a2 double")
    cols = [[F.col(f"s{i}") for i in range(6)], [F.col(f"a{i}") for i in range(3)]]
    got = df.select("t", "s0", orbits.glonass_orbit(*cols, F.col("t")).alias("p"), orbits.glonass_valid(cols[0]).alias("ok"), orbits.glonass_clock(F.lit(1e-4), F.lit(1e-9), F.col("t")).alias("clock")).collect()
    for x in got:
        if x.t is None or x.s0 is None:
            assert x.p is None
            continue
        wrapped = x.t - 604800 if x.t > 302400 else x.t
        np.testing.assert_allclose(x.p, plain_glonass(state, acc, wrapped), rtol=1e-12, atol=1e-6)
        assert x.ok and x.clock == pytest.approx(-1e-4 + 1e-9 * wrapped)
    assert not got[-1].ok


def plain_steps(t0, t1, rows):
    """Steps of an interval one after the other: (samples, dt, v, p, angle, mean bias)."""
    rows = sorted((x for x in rows if t0 <= x[0] <= t1), key=lambda x: (x[0], [(v is not None and v == v, v if v is not None and v == v else 0) for v in x[1]]))
    at = [t0, *[x[0] for x in rows], t1]
    dts = [(t1 - t0) / 1000] if len(rows) == 1 else [(at[i + 2] - at[i]) / 2000 for i in range(len(rows))]
    n, total, v, p, a, bias = 0, 0.0, np.zeros(3), np.zeros(3), np.zeros(3), []
    for dt, (_, values, b) in zip(dts, rows):
        if any(x is None or not math.isfinite(x) for x in values):
            continue
        acc, rate = np.array(values[:3]), np.array(values[3:])
        p = p + v * dt + 0.5 * acc * dt * dt
        v, a, n, total = v + acc * dt, a + rate * dt, n + 1, total + dt
        if dt > 0 and b is not None:
            bias.append((dt, b))
    return n, total, v, p, a, sum(d * b for d, b in bias) / sum(d for d, _ in bias) if bias else None


def test_preintegration_equals_steps_in_order_for_any_slices(spark):
    r = np.random.default_rng(6)
    rows, epochs = [], []
    for k in (1, 2):
        t = np.sort(r.uniform(0, 20_000, 300)).round(1)
        edges = [0.0, 1000.0, float(t[40]), 4000.0, 4000.5, 15_000.0, 19_000.0, 30_000.0]
        for i, x in enumerate(t):
            values = r.normal(0, 2, 6).tolist()
            if i % 29 == 3:
                values[i % 6] = [None, float("nan"), float("inf")][i % 3]
            rows.append((k, float(x), *values, None if i % 7 == 0 else float(r.normal())))
        epochs += [(k, e) for e in edges]
    many = ", ".join(f"{c} double" for c in ["ax", "ay", "az", "gx", "gy", "gz", "abx"])
    df = spark.createDataFrame([*rows, (None, 1.0, *[1.0] * 7), (1, None, *[1.0] * 7)], f"track long, t double, {many}").repartition(5)
    e = spark.createDataFrame([*epochs, (1, 1000.0), (None, 5.0), (2, float("nan")), (3, 1.0), (3, 2.0)], "track long, t double")
    outs = [inertial.preintegrate(df, e, width).orderBy("track", "t0").collect() for width in (100.0, 1e6)]
    for out in outs:
        assert [(x.track, x.t0) for x in out] == sorted({(k, t) for k, t in epochs if t < 30_000} | {(3, 1.0)})
        for x in out:
            n, total, v, p, a, bias = plain_steps(x.t0, x.t1, [(q[1], q[2:8], q[8]) for q in rows if q[0] == x.track])
            assert x.samples == n and x.dt == pytest.approx(total)
            np.testing.assert_allclose([x.dvx, x.dvy, x.dvz, x.dpx, x.dpy, x.dpz, x.dax, x.day, x.daz], [*v, *p, *a], rtol=1e-9, atol=1e-9)
            assert (x.abx_mean is None) == (bias is None) and (bias is None or x.abx_mean == pytest.approx(bias))
    used = {(x.track, x.t0) for x in inertial.deltas_for(inertial.preintegrate(df, e)).collect()}
    assert used == {(x.track, x.t0) for x in outs[0] if x.samples and x.dt > 0} and len(used) < len(outs[0])
