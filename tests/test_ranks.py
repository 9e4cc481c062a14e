"""Ranks and percentiles of groups that are dealt over several tasks."""

import numpy as np

from orbitlake.operators.aggregates import rank_percentiles
from orbitlake.operators.windows import count_windows, ranked


def _rows(n, seed=3):
    r = np.random.default_rng(seed)
    # two thirds of the rows in one group, half of those at one time
    return [(None if i % 17 == 0 else "hot" if i % 3 else f"g{i % 5}", 7 if i % 2 else int(r.integers(100)), i, float(r.normal())) for i in range(n)]


def test_ranks_of_a_hot_group_and_null_keys(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "k string, t long, id long, v double").repartition(7)
    got = {r.id: (r.rank, r.rank_of) for r in ranked(df, ["k"], ["t", "id"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        want.update({r[2]: (i, len(mine)) for i, r in enumerate(mine)})
    assert got == want


def test_the_ranks_of_one_group_are_many_tasks(spark):
    df = spark.range(40000).selectExpr("'a' as k", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ranked(df, ["k"], ["id"])
        parts = out.selectExpr("rank", "spark_partition_id() p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and sum(p["count"] for p in parts) == 40000


def test_windows_of_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "k string, t long")
    got = sorted(tuple(r) for r in count_windows(df, ["k"], ["t"], 4, 3).select("k", "window", "t").collect())
    assert got == [("a", w, t) for w in range(3) for t in range(3 * w, 3 * w + 4)]


def test_percentiles_by_rank(spark):
    rows = _rows(1000)
    df = spark.createDataFrame(rows + [("hot", 1, -1, None), ("empty", 1, -2, None)], "k string, t long, id long, v double")
    got = {r.k: (r.a, r.b) for r in rank_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k in {r[0] for r in rows}:
        np.testing.assert_allclose(got.pop(k), np.percentile([r[3] for r in rows if r[0] == k], [50, 95]), rtol=1e-12)
    assert not got
    everything = rank_percentiles(df, [], "v", {"a": 0.67}).collect()[0].a
    assert abs(everything - np.percentile([r[3] for r in rows], 67)) < 1e-12
