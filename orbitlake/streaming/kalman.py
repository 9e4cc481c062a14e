"""Constant-velocity Kalman filter per track: one step function for batch and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "track long, t double, position double, velocity double"
_STATE = "t double, x array<double>, p array<double>"


def steps(rows: pd.DataFrame, state: tuple | None, q: float, r: float) -> tuple[pd.DataFrame, tuple | None]:
    """Run the filter over rows in time order from a state (time, [position, velocity], covariance)."""
    out = []
    for t, z in rows.sort_values(["t", "z"])[["t", "z"]].itertuples(index=False):
        if state is None:
            state = (t, np.array([z, 0.0]), np.diag([r, 1e4]))
        else:
            was, x, p = state
            dt = t - was
            f = np.array([[1.0, dt], [0.0, 1.0]])
            x, p = f @ x, f @ p @ f.T + q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            gain = p[:, 0] / (p[0, 0] + r)
            x = x + gain * (z - x[0])
            state = (t, x, p - np.outer(gain, p[0]))
        out.append((t, state[1][0], state[1][1]))
    return pd.DataFrame(out, columns=["t", "position", "velocity"]), state


class _Tracks:
    """States of all tracks of a task in arrays; one call steps each of some tracks by one row."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.t, self.x, self.p = np.empty(0), np.empty((0, 2)), np.empty((0, 2, 2))

    def places(self, tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tracks, and which of them are new."""
        new = np.array([k not in self.at for k in tracks.tolist()])
        for k in tracks[new].tolist():
            self.at[k] = len(self.at)
        if len(self.at) > len(self.t):
            room = max(1024, 2 * len(self.at)) - len(self.t)
            self.t, self.x, self.p = np.append(self.t, np.zeros(room)), np.vstack([self.x, np.zeros((room, 2))]), np.concatenate([self.p, np.zeros((room, 2, 2))])
        return np.array([self.at[k] for k in tracks.tolist()], np.int64), new

    def step(self, i: np.ndarray, new: np.ndarray, t: np.ndarray, z: np.ndarray, q: float, r: float) -> np.ndarray:
        dt, x, p = t - self.t[i], self.x[i], self.p[i]
        f = np.zeros((len(i), 2, 2))
        f[:, 0, 0] = f[:, 1, 1] = 1.0
        f[:, 0, 1] = dt
        noise = q * np.stack([np.stack([dt**3 / 3, dt**2 / 2], -1), np.stack([dt**2 / 2, dt], -1)], 1)
        x, p = np.einsum("nij,nj->ni", f, x), f @ p @ f.transpose(0, 2, 1) + noise
        gain = p[:, :, 0] / (p[:, 0, 0] + r)[:, None]
        x = x + gain * (z - x[:, 0])[:, None]
        p = p - gain[:, :, None] * p[:, 0][:, None, :]
        x[new], p[new] = np.stack([z[new], np.zeros(new.sum())], -1), np.diag([r, 1e4])
        self.t[i], self.x[i], self.p[i] = t, x, p
        return x


def filter_batch(df: DataFrame, q: float = 1e-3, r: float = 1.0) -> DataFrame:
    """Filter columns (track, t, z): tracks are dealt over tasks, which take their rows in time order.

    A task holds one state for each of its tracks, no rows of theirs, and steps all tracks of a batch together. Rows of
    a null track are left out, in the stream too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = _Tracks()
        for g in batches:
            turn = g.groupby("track").cumcount().to_numpy()
            out = np.empty((len(g), 2))
            track, t, z = g["track"].to_numpy(), g["t"].to_numpy(float), g["z"].to_numpy(float)
            order = np.argsort(turn, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
                i, new = states.places(track[rows])
                out[rows] = states.step(i, new, t[rows], z[rows], q, r)
            yield pd.DataFrame({"track": track, "t": t, "position": out[:, 0], "velocity": out[:, 1]})

    # by a hash, as Spark leaves a repartition out behind a join by track and may then split its tracks
    return df.select("track", "t", "z").where("track is not null").repartition(F.xxhash64("track")).sortWithinPartitions("t", "z").mapInPandas(run, OUT)


def filter_stream(df: DataFrame, q: float = 1e-3, r: float = 1.0) -> DataFrame:
    """The same over a stream: the state of each track is kept between micro-batches, which must come in time order."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            t, x, p = state.get
            held = (t, np.array(x), np.array(p).reshape(2, 2))
        out, held = steps(pd.concat(list(batches)), held, q, r)
        if held is not None:
            state.update((float(held[0]), held[1].tolist(), held[2].ravel().tolist()))
        out.insert(0, "track", key[0])
        yield out

    return df.where("track is not null").groupBy("track").applyInPandasWithState(run, OUT, _STATE, "append", "NoTimeout")
