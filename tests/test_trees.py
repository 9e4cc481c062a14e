"""Boosted trees against a plain version over the same bins, and the fix-rate product against its formula."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import product, trees


def _plain(B, y, w, rounds, depth, rate, least, l2, loss):
    """Scores of all rows after boosting on (B, y, w), by trying every cut of every node."""
    mean = (w * y).sum() / w.sum()
    s = np.full(len(y), math.log(mean / (1 - mean)) if loss == "logistic" else mean)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s)) if loss == "logistic" else s
        g = np.floor(np.abs(w * (p - y)) * 1e6 + 0.5) * np.sign(p - y) / 1e6
        h = np.floor((w * p * (1 - p) if loss == "logistic" else w) * 1e6 + 0.5) / 1e6
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            nxt = []
            for rows in nodes:
                best = (1e-9, None)
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                for f in range(B.shape[1]):
                    for b in np.unique(B[rows, f]):
                        left, right = rows[B[rows, f] <= b], rows[B[rows, f] > b]
                        if min(len(left), len(right)) < least:
                            continue
                        gain = part(left) + part(right) - part(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
                nxt += list(best[1]) if best[1] else [rows]
            nodes = nxt
        for rows in nodes:
            s[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-s)) if loss == "logistic" else s


def _table(spark, n=400, seed=5):
    r = np.random.default_rng(seed)
    a, b, c = r.normal(size=n), r.integers(0, 4, n).astype(float), r.normal(size=n)
    y = ((a + 0.5 * (b == 2) + 0.3 * r.normal(size=n)) > 0.2).astype(int)
    rows = [(i, None if i % 11 == 0 else float(a[i]), float(b[i]), float("nan") if i % 13 == 0 else float(c[i]), int(y[i]), float(1 + i % 3), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, a double, b double, c double, y int, w double, fold int").repartition(5)


def _bins(rows, model):
    def one(x, cuts):
        return 0 if x is None or math.isnan(x) else 1 + sum(x > c for c in cuts)

    return np.array([[one(r[1 + i], model.cuts[i]) for i in range(3)] for r in rows])


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_trees_of_all_rows_and_of_folds(spark, loss):
    rows, df = _table(spark)
    opts = dict(rounds=5, depth=2, bins=8, rate=0.3, least=10, l2=1.0, loss=loss)
    model = trees.fit(df, ["a", "b", "c"], "y", "w", "fold", 3, **opts)
    B, y, w, fold = _bins(rows, model), np.array([r[4] for r in rows], float), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    plain = {k: v for k, v in opts.items() if k != "bins"}
    got = dict(trees.predict(df, model, "p").select("id", "p").collect())
    np.testing.assert_allclose([got[r[0]] for r in rows], _plain(B, y, w, **plain), atol=2e-5)
    # a fold's own rows are scored by the trees of the other folds, as if the fold's weights were nothing
    out = dict(trees.predict(df, model, "p", "fold").select("id", "p").collect())
    for k in range(3):
        rest = fold != k
        want = _plain(B[rest], y[rest], w[rest], **plain)
        mine = dict(trees.predict(df.withColumn("fold", F.lit(k)), model, "p", "fold").select("id", "p").collect())
        np.testing.assert_allclose([mine[r[0]] for r in rows if r[6] != k], want, atol=2e-5)
        assert all(abs(mine[r[0]] - out[r[0]]) < 1e-12 for r in rows if r[6] == k)


def test_same_trees_however_rows_are_dealt(spark):
    _, df = _table(spark)
    one, many = (trees.fit(d, ["a", "b", "c"], "y", "w", rounds=2, depth=3, bins=8) for d in (df.coalesce(1), df.repartition(9, "c")))
    assert one == many


def test_empty_tables_null_labels_and_constant_features(spark):
    _, df = _table(spark, 60)
    empty = trees.fit(df.where("id < 0"), ["a", "b"], "y", rounds=2, depth=2)
    assert {r.p for r in trees.predict(df, empty, "p").collect()} == {0.5}
    flat = df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0))
    model = trees.fit(flat.withColumn("y", F.when(F.col("id") < 40, F.col("y"))), ["a", "b"], "y", rounds=2, depth=2)
    share = df.where("id < 40").agg(F.avg("y")).first()[0]
    assert all(abs(r.p - share) < 1e-6 for r in trees.predict(flat, model, "p").collect())
    assert trees.predict(flat, model, "p").columns == [*flat.columns, "p"]
    with pytest.raises(ValueError):
        trees.fit(df, ["a"], "y", fold="fold", folds=65)


def test_product_keeps_to_its_formula_and_mends_the_base(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(600):
        x = float(r.normal())
        rows.append((i, f"r{i % 6}", i % 3, x, 0.5, float(min(max(0.5 + 0.3 * np.sign(x) + 0.05 * r.normal(), 0), 1)), 1.0))
    df = spark.createDataFrame(rows, "t int, run string, fold int, x double, base double, actual double, w double")
    model = product.fit(df, ["x"], {"up": F.col("actual") > 0.6}, "base", "actual", "w", ["run"], ["t"], "fold", 3, alpha=0.5, clip=0.2, rounds=4, depth=2)
    guards = [{"feature": "x", "operator": ">=", "threshold": 2.0, "cap": 0.3}, {"feature": "x", "operator": "<=", "threshold": -2.0, "floor": 0.9}]
    out = product.predict(df, model, guards, fold="fold").collect()
    for row in out:
        want = row.base + 0.5 * min(max(row.residual, -0.2), 0.2)
        want = min(want, 0.3) if row.x >= 2 else max(want, 0.9) if row.x <= -2 else want
        assert abs(row.rate - want) < 1e-12
    plain = [row for row in out if abs(row.x) < 2]
    assert np.mean([abs(row.rate - row.actual) for row in plain]) < 0.8 * np.mean([abs(row.base - row.actual) for row in plain])
    with pytest.raises(ValueError):
        product.guarded(F.lit(0.5), [{"feature": "x", "operator": "==", "threshold": 1.0}])


def test_calibrated_rates_do_not_fall(spark):
    rows = [(i, "r", i % 2, float(i), i / 200, min(1.0, (i / 200) ** 2), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "t int, run string, fold int, x double, base double, actual double, w double")
    model = product.fit(df, ["x"], {"up": F.col("actual") > 0.5}, "base", "actual", "w", ["run"], ["t"], "fold", 2, alpha=0.0, calibrated=True, rounds=1, depth=1)
    got = [row.rate for row in product.predict(df, model).orderBy("t").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(got, got[1:]))
    np.testing.assert_allclose(got, [r[5] for r in rows], atol=1e-6)


def test_place_in_a_run(spark):
    df = spark.createDataFrame([("a", i, 5) for i in range(3)] + [("b", 0, 0)], "run string, t int, planned int")
    got = {(r.run, r.t): (r.run_pos, r.run_fraction, r.run_remaining, r.run_windows) for r in product.with_place(df, ["run"], ["t"], "planned").collect()}
    assert got[("a", 2)] == (2.0, 0.5, 0.5, 5.0) and got[("b", 0)] == (0.0, None, None, None)
    got = {(r.run, r.t): (r.run_fraction, r.run_remaining) for r in product.with_place(df, ["run"], ["t"]).collect()}
    assert got[("a", 2)] == (1.0, 0.0) and got[("b", 0)] == (0.0, 0.0)


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_sums_of_a_level_equal_those_of_long_rows(spark, loss):
    r = np.random.default_rng(3)
    rows = [(*[int(v) for v in r.integers(0, 5, 3)], float(r.integers(0, 2)), float(1 + i % 3), i % 4 - 1, [float(v) for v in r.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "__b0 int, __b1 int, __b2 int, __y double, __w double, __fold int, __s array<double>").repartition(3)
    grown = [[trees.Tree({1: (0, 2)}, {2: -0.3, 3: 0.2 * k})] for k in range(4)]
    growing = [trees.Tree({1: (1, k)}, {2: 0.1, 3: -0.1}) for k in range(3)] + [trees.Tree()]
    nodes = {(0, 2), (0, 3), (1, 3), (3, 1)}
    models = []
    for k in range(4):
        s = F.col("__s")[k] + F.when(F.col("__b0") <= 2, -0.3).otherwise(0.2 * k)
        node = F.when(F.col("__b1") <= k, 2).otherwise(3) if k < 3 else F.lit(1)
        p = 1 / (1 + F.exp(-s)) if loss == "logistic" else s
        used = node.isin([n for m, n in nodes if m == k]) & ((F.col("__fold") != k) | F.lit(k == 3))
        models.append((used, node, F.col("__w") * (p - F.col("__y")), F.col("__w") * p * (1 - p) if loss == "logistic" else F.col("__w")))
    told = lambda h: sorted(map(tuple, h.select("model", "node", "feature", "bin", "g", "h", "n").collect()))
    out = trees.level_histogram(df, grown, growing, nodes, [5, 5, 5], loss)
    assert told(out) == told(trees.histogram(df, models, 3))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
