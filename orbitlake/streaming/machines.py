"""State machines over the rows of tracks: one vectorised step serves batch replays and streams with late rows and timers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: step(states (n, width), times, inputs (n, k)) -> (states, outputs (n, m)); a new track's state is all NaN.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Machine:
    """A step with the width of its state, whose first value is the time of the last row, and the names around it.

    A track that pauses for over forget_after seconds starts anew.
    """

    step: Step
    width: int
    inputs: list[str]
    outputs: list[str]
    forget_after: float = math.inf

    def run(self, states: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore"):
            gone = t - states[:, 0] > self.forget_after
        return self.step(np.where(gone[:, None], np.nan, states), t, x)

    @property
    def schema(self) -> str:
        return "track string, t double, " + ", ".join(f"{c} double" for c in [*self.inputs, *self.outputs])


def _rows(df: DataFrame, machine: Machine, track: list[str], time: Column) -> DataFrame:
    """Narrow rows of known tracks and finite times; a track's name joins its columns."""
    name = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(track)])) if len(track) > 1 else F.col(track[0]).cast("string")
    whole = F.lit(True)
    for c in track:
        whole = whole & F.col(c).isNotNull()
    out = df.where(whole).select(name.alias("track"), time.cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in machine.inputs])
    return out.where("t is not null and not isnan(t) and abs(t) < double('infinity')")


def _turns(track: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in turns: the first row of every track, the second ones, and so on."""
    turn = pd.Series(track).groupby(track).cumcount().to_numpy()
    order = np.argsort(turn, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(turn[order])) + 1)) if len(order) else iter(())


def replay(df: DataFrame, machine: Machine, track: list[str], time: str | Column = "t") -> DataFrame:
    """(track, t, inputs, outputs): the machine over each track's rows in time order.

    Tracks are dealt by hash; a task takes its rows by time, and equal times by their inputs, and steps all tracks of a
    batch together. It holds one state a track, and no rows. A track's rows are one sequence, so they stay in one task:
    a track with a third of all rows keeps that task busy for so long, in flat memory. Rows with a null track or a
    time that is null or not finite are left out. Repeated rows are stepped each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        states = np.empty((0, machine.width))
        for b in batches:
            names = b["track"].to_numpy()
            new = [k for k in dict.fromkeys(names.tolist()) if k not in at]
            at.update({k: len(at) + i for i, k in enumerate(new)})
            if len(at) > len(states):
                states = np.vstack([states, np.full((max(1024, 2 * len(at)) - len(states), machine.width), np.nan)])
            place = np.array([at[k] for k in names.tolist()], np.int64)
            t, x = b["t"].to_numpy(float), b[machine.inputs].to_numpy(float)
            out = np.empty((len(b), len(machine.outputs)))
            for rows in _turns(place):
                states[place[rows]], out[rows] = machine.run(states[place[rows]], t[rows], x[rows])
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(out, columns=machine.outputs)], axis=1)

    rows = _rows(df, machine, track, F.col(time) if isinstance(time, str) else time)
    return rows.repartition(F.xxhash64("track")).sortWithinPartitions("t", *machine.inputs).mapInPandas(run, machine.schema)


class _Processor(StatefulProcessor):
    """Rows wait in state until the watermark has passed them; then they are stepped in time order, as in a replay."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "v array<double>")
        self.waiting = handle.getListState("waiting", "t double, x array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for b in rows:
            x = b[self.machine.inputs].to_numpy(float)
            for t, values in zip(b["t"].to_numpy(float), x.tolist()):
                self.waiting.appendValue((float(t), [float(v) for v in values]))
                self.handle.registerTimer(max(math.floor(t * 1000) + 1, now + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m, mark = self.machine, timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted(([h[0], *h[1]] for h in held if math.floor(h[0] * 1000) < mark), key=lambda v: (v[0], *map(_order, v[1:])))
        state = np.array([self.state.get()[0]], float) if self.state.exists() else np.full((1, m.width), np.nan)
        if not due:
            # only a pause can be over
            if not held and math.isfinite(m.forget_after) and mark / 1000 - state[0, 0] > m.forget_after:
                self.state.clear()
            return iter(())
        out = []
        for t, *x in due:
            state, told = m.run(state, np.array([t]), np.array([x], float))
            out.append([key[0], t, *x, *told[0].tolist()])
        left = [h for h in held if math.floor(h[0] * 1000) >= mark]
        self.waiting.clear()
        if left:
            self.waiting.put([(h[0], list(h[1])) for h in left])
        self.state.update((state[0].tolist(),))
        if math.isfinite(m.forget_after):
            self.handle.registerTimer(math.floor((state[0, 0] + m.forget_after) * 1000) + 1)
        return iter([pd.DataFrame(out, columns=[c.split()[0] for c in m.schema.split(", ")])])

    def close(self) -> None:
        pass


def _order(v: float) -> tuple[int, float]:
    """Spark's order of doubles: nulls (here NaN, as they come) first."""
    return (0, 0.0) if v != v else (1, v)


def run_stream(df: DataFrame, machine: Machine, track: list[str], time: str, lateness: str = "10 seconds") -> DataFrame:
    """The rows of replay() over a stream whose timestamp column `time` may come out of order by `lateness`.

    A row waits in state until the watermark has passed it, then all that wait are stepped by time, so that the output
    is a replay's, row for row. Rows behind the watermark are dropped, as Spark drops them. A track's state goes once the
    watermark is forget_after past its last row. Needs the RocksDB state store; states come back after a restart.
    """
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000.0).cast("double")
    marked = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    name = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(track)])) if len(track) > 1 else F.col(track[0]).cast("string")
    whole = F.col(time).isNotNull()
    for c in track:
        whole = whole & F.col(c).isNotNull()
    rows = marked.where(whole).select(name.alias("track"), F.col(time), seconds.alias("t"), *[F.col(c).cast("double").alias(c) for c in machine.inputs])
    return rows.groupBy("track").transformWithStateInPandas(_Processor(machine), machine.schema, "Append", "EventTime")


def ewma(value: str, tau: float, out: str = "mean") -> Machine:
    """Exponential mean of a value by irregular time: weight 1 - exp(-dt / tau), tau of one second at least.

    A value that is null or NaN makes the mean NaN until a next value starts it again. Rows at the time of the row
    before leave it as it is.
    """

    def step(s: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = decayed(s[:, 1], x[:, 0], elapsed(s[:, 0], t), tau)
        return np.stack([t, mean], 1), mean[:, None]

    return Machine(step, 2, [value], [out])


def elapsed(was: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Seconds since the last row; 0 for the first one and for times that fall back."""
    return np.where(np.isnan(was), 0.0, np.maximum(t - was, 0.0))


def decayed(mean: np.ndarray, value: np.ndarray, dt: np.ndarray, tau: float) -> np.ndarray:
    gain = 1.0 - np.exp(-dt / max(tau, 1.0))
    return np.where(~np.isfinite(mean), value, np.where(dt <= 0, mean, (1 - gain) * mean + gain * value))
