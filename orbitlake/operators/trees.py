"""Gradient-boosted trees as Spark aggregates: histograms of all nodes, folds and features of a level in one shuffle.

Rows never leave Spark. The driver holds the cuts (features times bins) and the trees (models times rounds times leaves). Sums of
gradients are whole numbers of millionths, so that neither the order of rows nor a lost executor changes a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite
from ..storage import drop, stored

UNIT = 1e6
#: Rounds between writes of the scores; trees since the last write are walked again.
ROUNDS_A_WRITE = 4
MOST_FOLDS = 64


@dataclass
class Tree:
    """Splits {node: (feature, highest bin to the left)} and leaves {node: value}; the root is 1, children are 2n and 2n + 1."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        size = 2 + max([1, *self.splits]) * 2
        feature, last = np.full(size, -1), np.zeros(size, int)
        for n, (f, b) in self.splits.items():
            feature[n], last[n] = f, b
        node, rows = np.ones(len(bins), int), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = 2 * at + (bins[rows, feature[at]] > last[at])
        return node

    def values(self, nodes: np.ndarray) -> np.ndarray:
        table = np.zeros(2 + max([1, *self.leaves]))
        table[list(self.leaves)] = list(self.leaves.values())
        return table[nodes]


def _walked(grown: list[list[Tree]], n_features: int) -> Column:
    """The sum of the trees of each model, from the bins of a batch of rows."""

    @F.pandas_udf("array<double>")
    def walk(*bins: pd.Series) -> pd.Series:
        b = np.column_stack([c.to_numpy() for c in bins])
        return pd.Series(list(np.column_stack([sum((t.values(t.ends(b)) for t in trees), np.zeros(len(b))) for trees in grown])))

    return walk(*[F.col(f"__b{i}") for i in range(n_features)])


@dataclass
class Model:
    """`trees[k]` and `start[k]` of each model; the last one saw every row, model k all but those of fold k."""

    features: list[str]
    cuts: list[list[float]]
    start: list[float]
    trees: list[list[Tree]]
    loss: str

    def bins(self) -> dict[str, Column]:
        """Bin of each feature: 0 for missing values, else 1 plus the number of cuts below it."""
        out = {}
        for i, (name, cuts) in enumerate(zip(self.features, self.cuts)):
            x = F.col(name).cast("double")
            above = sum([(x > c).cast("int") for c in cuts], F.lit(1))
            out[f"__b{i}"] = F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(above)
        return out


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 distinct cuts of each feature, at even shares of its finite values; exact up to 10,000 rows."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    x = [F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(c, shares, F.lit(10000)).alias(f"q{i}") for i, c in enumerate(x)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def histogram(rows: DataFrame, models: list[tuple[Column, Column, Column, Column]], n_features: int) -> DataFrame:
    """(model, node, feature, bin, g, h, n) from binned rows and, for each model, (used, node, gradient, curvature).

    Rows are summed before the shuffle, which carries at most models times nodes times features times bins rows a task.
    """
    whole = lambda c: F.round(c * UNIT).cast("long")
    parts = [F.when(used, F.struct(F.lit(k).alias("model"), node.alias("node"), whole(g).alias("g"), whole(h).alias("h"))) for k, (used, node, g, h) in enumerate(models)]
    bins = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"__b{i}").alias("bin")) for i in range(n_features)])
    long = rows.select(F.explode(F.array(*parts)).alias("m"), bins.alias("__bins")).where("m is not null and m.node is not null")
    return long.select("m.*", F.explode("__bins").alias("x")).groupBy("model", "node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def split_gains(hist: DataFrame, l2: float) -> DataFrame:
    """For each (model, node, feature, bin): sums of the rows up to the bin (gl, hl, nl), of all rows of the node, the gain of the
    cut, and the next bin that holds a row of the node."""
    w = Window.partitionBy("model", "node", "feature")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.select("model", "node", "feature", "bin", *[F.sum(c).over(up).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(w).alias(c) for c in "ghn"], F.lead("bin").over(w.orderBy("bin")).alias("next"))
    part = lambda g, h: F.pow(g / F.lit(UNIT), F.lit(2)) / (h / F.lit(UNIT) + l2)
    gl, hl, g, h = (F.col(c) for c in ("gl", "hl", "g", "h"))
    return s.withColumn("gain", part(gl, hl) + part(g - gl, h - hl) - part(g, h))


def _between(cuts: list[float], left: int, right: int) -> int:
    """The bin from `left` to before `right`, with no row of the node in between, whose cut is nearest to the middle of the gap."""
    if left == 0 or right > len(cuts):
        return left
    middle = (cuts[left - 1] + cuts[right - 1]) / 2
    return min(range(left, right), key=lambda b: abs(cuts[b - 1] - middle))


def level_histogram(rows: DataFrame, grown: list[list[Tree]], growing: list[Tree], open_nodes: set[tuple[int, int]], n_bins: list[int], loss: str) -> DataFrame:
    """histogram() of the open nodes of all growing trees. A task sums its own rows by arrays: neither (row, model) nor (row,
    feature) is a row, and the shuffle carries at most models times nodes times features times bins rows a task.

    rows hold __b0.., __y, __w, __fold and __s, a score for each model; the last model uses every row, model k all but fold k.
    """
    nodes = [sorted(n for m, n in open_nodes if m == k) for k in range(len(growing))]
    whole = lambda x: np.copysign(np.floor(np.abs(x) * UNIT + 0.5), x)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros((3, len(mine), n), np.int64) for n in n_bins] for mine in nodes]
        for t in batches:
            number = lambda c: t[c].to_numpy(zero_copy_only=False)  # noqa: B023, E731
            b = np.column_stack([number(f"__b{i}") for i in range(len(n_bins))]).astype(np.int64)
            y, w, fold = number("__y"), number("__w"), number("__fold")
            scores = t["__s"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(growing))
            for k, mine in enumerate(nodes):
                if not mine:
                    continue
                place = np.full(1 + max(2 * max([1, *growing[k].splits]) + 1, mine[-1]), -1)
                place[mine] = np.arange(len(mine))
                at = place[growing[k].ends(b)]
                on = np.flatnonzero((at >= 0) & ((fold != k) | (k == len(nodes) - 1)))
                at, x, weight = at[on], b[on], w[on]
                s = sum((tree.values(tree.ends(x)) for tree in grown[k]), scores[on, k])
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-s)) if loss == "logistic" else s
                g, h = whole(weight * (p - y[on])), whole(weight * p * (1 - p) if loss == "logistic" else weight)
                for i, n in enumerate(n_bins):
                    cell = at * n + x[:, i]
                    for j, v in enumerate((g, h, None)):
                        # sums of whole numbers under 2**53 are exact in doubles
                        held[k][i][j] += np.bincount(cell, v, len(mine) * n).astype(np.int64).reshape(-1, n)
        for k, mine in enumerate(nodes):
            for i in range(len(n_bins)):
                where = np.nonzero(held[k][i][2]) if mine else ((), ())
                if len(where[0]):
                    values = [np.full(len(where[0]), k), np.array(mine)[where[0]], np.full(len(where[0]), i), where[1], *(a[where] for a in held[k][i])]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, [pa.int32()] * 4 + [pa.int64()] * 3)], ["model", "node", "feature", "bin", "g", "h", "n"])

    told = rows.mapInArrow(sums, "model int, node int, feature int, bin int, g long, h long, n long")
    return told.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def _grow(rows: DataFrame, grown: list[list[Tree]], cuts: list[list[float]], depth: int, rate: float, least: int, l2: float, loss: str) -> list[Tree]:
    """The next tree of each model: a shuffle a level, and one row a node comes to the driver."""
    trees = [Tree() for _ in grown]
    open_nodes = {(k, 1) for k in range(len(trees))}
    value = lambda g, h: -rate * (g / UNIT) / (h / UNIT + l2)
    for _ in range(depth):
        gains = split_gains(level_histogram(rows, grown, trees, open_nodes, [len(c) + 2 for c in cuts], loss), l2)
        fit_for = (F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least) & (F.col("gain") > 1e-9)
        order = F.struct((-F.col("gain")).alias("lost"), "feature", "bin", "next", "gl", "hl")
        best = gains.groupBy("model", "node").agg(F.min(F.when(fit_for, order)).alias("b"), F.first("g").alias("g"), F.first("h").alias("h")).collect()
        open_nodes = set()
        for r in best:
            t = trees[r.model]
            t.leaves.setdefault(r.node, value(r.g, r.h))
            if r.b is not None:
                t.splits[r.node] = (r.b.feature, _between(cuts[r.b.feature], r.b.bin, r.b.next))
                t.leaves.pop(r.node)
                t.leaves[2 * r.node], t.leaves[2 * r.node + 1] = value(r.b.gl, r.b.hl), value(r.g - r.b.gl, r.h - r.b.hl)
                open_nodes |= {(r.model, 2 * r.node), (r.model, 2 * r.node + 1)}
        if not open_nodes:
            break
    return trees


def fit(
    df: DataFrame, features: list[str], label: str, weight: str | None = None, fold: str | None = None, folds: int = 0, rounds: int = 20,
    depth: int = 3, bins: int = 32, rate: float = 0.2, least: int = 20, l2: float = 1.0, loss: str = "logistic",
) -> Model:
    """Boosted trees for a 0/1 label (`logistic`) or a value (`squared`), and one more model a fold that leaves the fold out.

    `fold` holds 0 to folds - 1; rows of other folds, or null, are in every model. Missing features have a bin of their own;
    rows without a finite label are left out, weights that are not positive and finite count 1. An empty table scores 0.
    """
    if folds > MOST_FOLDS:
        raise ValueError(f"at most {MOST_FOLDS} folds: deal runs to folds by a hash")
    y = F.col(label).cast("double")
    w = F.lit(1.0) if weight is None else F.when(finite(F.col(weight).cast("double")) & (F.col(weight) > 0), F.col(weight).cast("double")).otherwise(F.lit(1.0))
    known = df.where(finite(y) & y.isNotNull())
    model = Model(features, quantile_cuts(known, features, bins), [], [[] for _ in range(folds + 1)], loss)
    held = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = known.select(*[c.cast("int").alias(n) for n, c in model.bins().items()], y.alias("__y"), w.alias("__w"), held.alias("__fold"))
    sums = {r[0]: (r[1] or 0, r[2] or 0) for r in rows.groupBy(F.when(F.col("__fold").between(0, folds - 1), F.col("__fold")).otherwise(-1)).agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).collect()}
    for k in range(folds + 1):
        n, s = (sum(v[i] for f, v in sums.items() if f != k or k == folds) for i in (0, 1))
        mean = s / n if n else 0.0
        if loss == "logistic":
            p = min(max(mean if n else 0.5, 1e-6), 1 - 1e-6)
            mean = log(p / (1 - p))
        model.start.append(mean)
    # narrow rows, much work on each: dealt once over all partitions, which small tables would not be by their bytes
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = stored(dealt.withColumn("__s", F.array(*[F.lit(s) for s in model.start])))
    grown: list[list[Tree]] = [[] for _ in range(folds + 1)]
    for i in range(rounds):
        for k, t in enumerate(_grow(now, grown, model.cuts, depth, rate, least, l2, loss)):
            model.trees[k].append(t)
            grown[k].append(t)
        if (i + 1) % ROUNDS_A_WRITE == 0 and i + 1 < rounds:
            total = F.zip_with("__s", _walked(grown, len(features)), lambda a, b: a + b)
            before, now = now, stored(now.withColumn("__s", total))
            drop(before)
            grown = [[] for _ in range(folds + 1)]
    drop(now)
    return model


def predict(df: DataFrame, model: Model, out: str, fold: str | None = None) -> DataFrame:
    """Scores of the model that saw every row, or for rows of a known fold of the one that did not see it."""
    bins = model.bins()
    k = len(model.trees) - 1
    which = F.when(F.col(fold).between(0, k - 1), F.col(fold).cast("int")).otherwise(k) if fold else F.lit(k)
    total = F.get(F.array(*[F.lit(s) for s in model.start]), which) + F.get(_walked(model.trees, len(model.features)), which)
    return df.withColumns(bins).withColumn(out, _sigmoid(total) if model.loss == "logistic" else total).drop(*bins)
