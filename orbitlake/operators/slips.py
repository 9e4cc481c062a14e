"""Cycle slips: rows where a combination of carriers jumps from one epoch of its satellite to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jumps_over(rows: DataFrame, by: list[str], order: list[str], tests: dict[str, tuple[Column, float]]) -> DataFrame:
    """Rows with one boolean for each test (name: value and threshold): the value moved by more than the threshold.

    All tests share one shuffle and one sort by satellite. The first row of a satellite is false, as is a row where
    its own or the last value is null.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({name: F.coalesce(F.abs(x - F.lag(x).over(w)) > limit, F.lit(False)) for name, (x, limit) in tests.items()})
