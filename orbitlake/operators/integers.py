"""Integer ambiguities: decorrelating reduction and an exact tree search, on batches of small covariances of one size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes that one system may hold open at a level; beyond, the nearest are kept and the row says so.
MOST_NODES = 5_000
#: Systems that are searched together, which bounds a task's memory.
TOGETHER = 256


def factor(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower L and D > 0 of Q = L'DL for a batch (b, n, n), from the last row up."""
    q = q.copy()
    b, n, _ = q.shape
    low, d = np.zeros_like(q), np.zeros((b, n))
    for i in range(n - 1, -1, -1):
        d[:, i] = q[:, i, i]
        low[:, i, : i + 1] = q[:, i, : i + 1] / d[:, i, None]
        q[:, :i, :i] -= d[:, i, None, None] * low[:, i, :i, None] * low[:, i, None, :i]
    return low, d


def reduced(q: np.ndarray) -> np.ndarray:
    """Unimodular Z of a batch, such that Z Q Z' is nearly diagonal with its variances falling towards the last row.

    All rows are made nearly orthogonal by whole multiples of the later ones, then in each matrix one pair of
    neighbours that is out of order changes places; until no pair is.
    """
    b, n, _ = q.shape
    z = np.repeat(np.eye(n)[None], b, 0)
    live = np.arange(b)
    for _ in range(50 * n * n):
        if not len(live) or n == 1:
            break
        zl = z[live]
        low, d = factor(zl @ q[live] @ np.swapaxes(zl, 1, 2))
        for k in range(n - 2, -1, -1):
            for i in range(k + 1, n):
                m = np.rint(low[:, i, k])
                zl[:, k] -= m[:, None] * zl[:, i]
                low[:, i:, k] -= m[:, None] * low[:, i:, i]
        z[live] = zl
        after = d[:, :-1] + low[:, np.arange(1, n), np.arange(n - 1)] ** 2 * d[:, 1:]
        wrong = after < d[:, 1:] * (1 - 1e-9)
        turn = wrong.any(axis=1)
        live, k = live[turn], (n - 2 - np.argmax(wrong[turn][:, ::-1], axis=1))
        z[live[:, None], np.stack([k, k + 1], 1)] = z[live[:, None], np.stack([k + 1, k], 1)]
    return z


def search(a: np.ndarray, low: np.ndarray, d: np.ndarray, most: int = MOST_NODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two nearest whole vectors (b, 2, n) of a batch in the metric of inv(L'DL), their distances, and whether none was missed.

    The rounded solution and its neighbour in the first row bound the second distance; from the last row to the first, all
    nodes within that bound are opened, those of all systems together.
    """
    b, n = a.shape
    # rounding in sequence
    u, dist = np.zeros((b, n)), np.zeros(b)
    for k in range(n - 1, -1, -1):
        c = a[:, k] + (low[:, k + 1 :, k] * u[:, k + 1 :]).sum(1)
        u[:, k] = np.rint(c) - c
        dist += u[:, k] ** 2 / d[:, k]
    bound = (dist + ((1 - np.abs(u[:, 0])) ** 2 - u[:, 0] ** 2) / d[:, 0]) * (1 + 1e-9) + 1e-12
    who, far, off, at = np.arange(b), np.zeros(b), np.zeros((b, n)), np.zeros((b, n))
    whole = np.ones(b, bool)
    for k in range(n - 1, -1, -1):
        c = a[who, k] + (low[who, k + 1 :, k] * off[:, k + 1 :]).sum(1)
        r = np.sqrt(np.maximum(bound[who] - far, 0.0) * d[who, k])
        first = np.ceil(c - r)
        many = np.maximum(np.floor(c + r) - first + 1, 0).astype(np.int64)
        # no node opens more than its system may hold
        whole[who[many > most]] = False
        first = np.where(many > most, np.rint(c) - (most - 1) // 2, first)
        many = np.minimum(many, most)
        up = np.repeat(np.arange(len(who)), many)
        z = first[up] + np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
        who, far, off, at, c = who[up], far[up], off[up], at[up], c[up]
        off[:, k], at[:, k] = z - c, z
        far = far + off[:, k] ** 2 / d[who, k]
        keep = np.flatnonzero(far <= bound[who])
        who, far, off, at = who[keep], far[keep], off[keep], at[keep]
        held = np.bincount(who, minlength=b)
        if (held > most).any():
            order = np.lexsort((far, who))
            place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
            whole &= held <= most
            keep = order[place < most]
            who, far, off, at = who[keep], far[keep], off[keep], at[keep]
    order = np.lexsort((*at.T, far, who))
    starts, held = np.searchsorted(who[order], np.arange(b)), np.bincount(who, minlength=b)
    two = order[starts[:, None] + np.stack([np.zeros(b, np.int64), held >= 2], 1)]
    far = far[two]
    far[held < 2, 1] = np.inf
    return at[two], far, whole & (held >= 2)


def resolve(a: np.ndarray, q: np.ndarray, most: int = MOST_NODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second whole vectors (b, 2, n), distances (b, 2), completeness, for floats (b, n) and covariances (b, n, n)."""
    z = reduced(q)
    low, d = factor(z @ q @ np.swapaxes(z, 1, 2))
    base = np.rint(a)
    at, far, whole = search((z @ (a - base)[:, :, None])[:, :, 0], low, d, most)
    back = np.rint(np.linalg.solve(z[:, None], at[..., None]))[..., 0]
    whole &= (np.einsum("bij,bkj->bki", z, back) == at).all(axis=(1, 2))
    return back + base[:, None], far, whole


def _fixed(by: list[str], threshold: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floats, spread = batch["ambiguities"].to_pylist(), batch["covariance"].to_pylist()
            sizes = np.array([len(f) if f and c is not None and len(c) == len(f) ** 2 and None not in f and None not in c else 0 for f, c in zip(floats, spread)])
            out: list[tuple] = [(None, None, None, None, None, False, None)] * batch.num_rows
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                a, q = np.array([floats[i] for i in rows], float), np.array([spread[i] for i in rows], float).reshape(-1, n, n)
                q = (q + np.swapaxes(q, 1, 2)) / 2
                fine = np.isfinite(a).all(1) & np.isfinite(q).all((1, 2)) & (np.abs(a) < 2.0**52).all(1)
                q[~fine] = np.eye(n)
                fine &= (factor(q)[1] > 0).all(1) & (np.linalg.eigvalsh(q)[:, 0] > 0)
                rows, a, q = rows[fine], a[fine], q[fine]
                for s in range(0, len(rows), TOGETHER):
                    best, far, whole = resolve(a[s : s + TOGETHER], q[s : s + TOGETHER], most)
                    for i, z, f, w in zip(rows[s : s + TOGETHER], best, far, whole):
                        ratio = float(f[1] / f[0]) if f[0] > 1e-30 else 0.0
                        out[i] = ([int(v) for v in z[0]], [int(v) for v in z[1]], float(f[0]), float(f[1]), ratio, bool(ratio >= threshold), bool(w))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in by], *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]], [*by, "fixed", "second", "distance", "second_distance", "ratio", "accepted", "complete"])

    return run


def fix_ambiguities(rows: DataFrame, by: list[str], threshold: float = 3.0, most: int = MOST_NODES) -> DataFrame:
    """(by, fixed, second, distance, second_distance, ratio, accepted, complete) of each row's ambiguities (array<double>) and
    covariance (array<double>, row by row).

    fixed is the whole vector nearest in the metric of the inverse covariance, second the next one, equal distances by the
    reduced vectors; ratio is second over best distance, 0 where the best is 0, and accepted if it reaches the threshold.
    The search is exact unless a level of its tree opens over `most` nodes; then complete is false. Null, empty or
    unlike-sized arrays, numbers that are not finite, and covariances that are not positive definite give nulls, not accepted.
    Systems of a batch are reduced and searched together; there is no shuffle.
    """
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    narrow = rows.select(*by, F.col("ambiguities").cast("array<double>").alias("ambiguities"), F.col("covariance").cast("array<double>").alias("covariance"))
    return narrow.mapInArrow(_fixed(by, threshold, most), f"{kinds}fixed array<long>, second array<long>, distance double, second_distance double, ratio double, accepted boolean, complete boolean")
