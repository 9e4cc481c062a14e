"""Eight-state navigation filter (position, velocity, clock, drift) per track from pseudoranges, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "track long, t double, n int, x double, y double, z double, vx double, vy double, vz double, clock double, drift double"
_STATE = "t double, x array<double>, p array<double>"
#: Noise of position, velocity, clock and drift in a prediction.
NOISE = (1.0, 0.1, 100.0, 10.0)


def start(t: float, position: np.ndarray, clock: float, sigma: float = 100.0, sigma_clock: float = 1000.0) -> tuple:
    """State (time, [x y z vx vy vz clock drift], covariance); velocity and drift are unknown."""
    x = np.zeros(8)
    x[:3], x[6] = position, clock
    return t, x, np.diag([sigma**2] * 3 + [1e4] * 3 + [sigma_clock**2, 1e4])


def predict(state: tuple, t: float, noise: tuple = NOISE) -> tuple:
    was, x, p = state
    dt = t - was
    f = np.eye(8)
    f[[0, 1, 2, 6], [3, 4, 5, 7]] = dt
    pos, vel, clk, drift = (s * s for s in noise)
    q = np.diag([pos * dt * dt] * 3 + [vel * dt] * 3 + [clk * dt * dt, drift * dt])
    return t, f @ x, f @ p @ f.T + q


def update(state: tuple, sats: np.ndarray, pr: np.ndarray, w: np.ndarray) -> tuple:
    """All ranges of an epoch at once; a weight is one over the variance."""
    t, x, p = state
    d = x[:3] - sats
    r = np.maximum(np.linalg.norm(d, axis=1), 1e-6)
    h = np.zeros((len(r), 8))
    h[:, :3], h[:, 6] = d / r[:, None], 1.0
    noise = np.where(w > 1e-15, 1.0 / np.maximum(w, 1e-15), 1e6)
    gain = np.linalg.solve(h @ p @ h.T + np.diag(noise), h @ p).T
    return t, x + gain @ (pr - r - x[6]), p - gain @ h @ p


def epochs(rows: pd.DataFrame, state: tuple | None, origin: tuple, noise: tuple = NOISE) -> tuple[list, tuple | None]:
    """Filter rows of one track in time order; the first epoch starts at `origin` (x, y, z, clock)."""
    out, m = [], rows[["t", "sx", "sy", "sz", "pr", "w"]].to_numpy(float)
    m = m[np.argsort(m[:, 0], kind="stable")]
    for g in np.split(m, np.flatnonzero(np.diff(m[:, 0])) + 1) if len(m) else []:
        t = float(g[0, 0])
        state = start(t, np.array(origin[:3]), origin[3]) if state is None else predict(state, t, noise)
        state = update(state, g[:, 1:4], g[:, 4], g[:, 5])
        out.append((t, len(g), *state[1].tolist()))
    return out, state


def step_all(x: np.ndarray, p: np.ndarray, dt: np.ndarray, old: np.ndarray, sats: np.ndarray, pr: np.ndarray, w: np.ndarray, noise: tuple = NOISE) -> tuple[np.ndarray, np.ndarray]:
    """predict (where old) and update of many tracks at once, each with as many satellites: x (n, 8), p (n, 8, 8), sats (n, m, 3)."""
    n, m = pr.shape
    f = np.broadcast_to(np.eye(8), (n, 8, 8)).copy()
    f[:, [0, 1, 2, 6], [3, 4, 5, 7]] = np.where(old, dt, 0.0)[:, None]
    pos, vel, clk, drift = (s * s for s in noise)
    q = np.stack([*[pos * dt * dt] * 3, *[vel * dt] * 3, clk * dt * dt, drift * dt], 1) * old[:, None]
    x = (f @ x[:, :, None])[:, :, 0]
    p = f @ p @ np.swapaxes(f, 1, 2)
    i = np.arange(8)
    p[:, i, i] += q
    d = x[:, None, :3] - sats
    r = np.maximum(np.linalg.norm(d, axis=2), 1e-6)
    h = np.zeros((n, m, 8))
    h[:, :, :3], h[:, :, 6] = d / r[:, :, None], 1.0
    hp = h @ p
    s = hp @ np.swapaxes(h, 1, 2)
    i = np.arange(m)
    s[:, i, i] += np.where(w > 1e-15, 1.0 / np.maximum(w, 1e-15), 1e6)
    gain = np.swapaxes(np.linalg.solve(s, hp), 1, 2)
    return x + (gain @ (pr - r - x[:, 6:7])[:, :, None])[:, :, 0], p - gain @ hp


def epochs_of_all(track: np.ndarray, m: np.ndarray, state: tuple | None, origin: tuple, noise: tuple = NOISE) -> tuple[np.ndarray, tuple | None]:
    """epochs() for rows t, sx, sy, sz, pr, w of many tracks that lie behind each other in time order.

    The first track goes on from `state`. Returns rows of time, satellites and state by epoch, and the last track's state.
    The k-th epochs of all tracks take a step together, those with as many satellites at once.
    """
    new = np.append(True, track[1:] != track[:-1])
    heads = np.flatnonzero(new | np.append(True, m[1:, 0] != m[:-1, 0]))
    sizes, t, first = np.diff(np.append(heads, len(m))), m[heads, 0], np.flatnonzero(new[heads])
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(heads))))
    turn = np.arange(len(heads)) - first[of]
    was, x, p, known = np.zeros(len(first)), np.zeros((len(first), 8)), np.zeros((len(first), 8, 8)), np.zeros(len(first), bool)
    _, x[:], p[:] = start(0.0, np.array(origin[:3]), origin[3])
    if state is not None:
        was[0], x[0], p[0] = state
        known[0] = True
    out = np.empty((len(heads), 10))
    out[:, 0], out[:, 1] = t, sizes
    order = np.lexsort((sizes, turn))
    for at in np.split(order, np.flatnonzero(np.diff(turn[order]) | np.diff(sizes[order])) + 1):
        k, rows = of[at], heads[at][:, None] + np.arange(sizes[at[0]])
        x[k], p[k] = step_all(x[k], p[k], np.where(known[k], t[at] - was[k], 0.0), known[k], m[rows, 1:4], m[rows, 4], m[rows, 5], noise)
        was[k], known[k] = t[at], True
        out[at, 2:] = x[k]
    return out, (float(was[-1]), x[-1].copy(), p[-1].copy())


def _frame(track, out: list) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame([(track, *r) for r in out], columns=names)


def filter_batch(df: DataFrame, origin: tuple, noise: tuple = NOISE) -> DataFrame:
    """Columns track, t, sx, sy, sz, pr, w. Rows come sorted by track and time; a task holds a batch of them, one epoch and one state.

    The tracks of a batch take their steps together.

    Rows of a null track are left out, in the stream too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, track, state = None, None, None
        for g in batches:
            g = g if held is None else pd.concat([held, g], ignore_index=True)
            last = (g["track"] == g["track"].iloc[-1]) & (g["t"] == g["t"].iloc[-1])
            held = g[last]
            rows = g[~last]
            if not len(rows):
                continue
            ids = rows["track"].to_numpy()
            found, left = epochs_of_all(ids, rows[["t", "sx", "sy", "sz", "pr", "w"]].to_numpy(float), state if ids[0] == track else None, origin, noise)
            track, state = ids[-1], left
            t = rows["t"].to_numpy(float)
            out = pd.DataFrame(found, columns=[c.split()[0] for c in OUT.split(", ")[1:]]).astype({"n": int})
            out.insert(0, "track", ids[np.append(True, (ids[1:] != ids[:-1]) | (t[1:] != t[:-1]))])
            yield out
        if held is not None and len(held):
            k = held["track"].iloc[0]
            yield _frame(k, epochs(held, state if k == track else None, origin, noise)[0])

    return df.select("track", "t", "sx", "sy", "sz", "pr", "w").where("track is not null").repartition(F.xxhash64("track")).sortWithinPartitions("track", "t").mapInPandas(run, OUT)


def filter_stream(df: DataFrame, origin: tuple, noise: tuple = NOISE) -> DataFrame:
    """The same over a stream; rows at or before the time of a track's state are late and dropped."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            t, x, p = state.get
            held = (t, np.array(x), np.array(p).reshape(8, 8))
        rows = pd.concat(list(batches))
        if held is not None:
            rows = rows[rows["t"] > held[0]]
        out, held = epochs(rows, held, origin, noise)
        if held is not None:
            state.update((float(held[0]), held[1].tolist(), held[2].ravel().tolist()))
        yield _frame(key[0], out)

    return df.where("track is not null").groupBy("track").applyInPandasWithState(run, OUT, _STATE, "append", "NoTimeout")
