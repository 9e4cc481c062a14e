"""Time scales, combinations of two carriers, gates and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import LIGHT

# fixed values: carrier frequencies in hertz
L1, L2 = 1575.42e6, 1227.60e6
WIDE_LANE = LIGHT / (L1 - L2)


def gps_week_tow(ts: Column) -> tuple[Column, Column]:
    """Week and seconds of week since 1980-01-06 of a timestamp without zone, without leap seconds."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1980-01-06").cast("timestamp_ntz"), ts)
    week = F.floor(us / 604800e6)
    return week, (us - week * 604800000000) / 1e6


def geometry_free(l1: Column, l2: Column) -> Column:
    """Difference of two carrier phases (cycles) in metres."""
    return l1 * (LIGHT / L1) - l2 * (LIGHT / L2)


def wide_lane(l1: Column, l2: Column, p1: Column, p2: Column) -> Column:
    """Float wide-lane ambiguity in cycles from phases (cycles) and ranges (metres)."""
    return l1 - l2 - (L1 * p1 + L2 * p2) / (L1 + L2) / WIDE_LANE


def finite(x: Column) -> Column:
    """Not null, NaN or infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ramp(x: Column, low: float, high: float, least: float = 0.0, most: float = 1.0, missing: float = 1.0) -> Column:
    """least at or under low, most at or over high, straight in between; `missing` where x is not finite."""
    share = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(finite(x), least + (most - least) * share).otherwise(F.lit(missing))


def sight_label(los: Column, cn0: Column, el_deg: Column, strong: float, weak: float, least_el: float) -> Column:
    """Whether predicted sight and measured strength agree; low or unmeasured ones are ambiguous."""
    unsure = cn0.isNull() | F.isnan(cn0) | (el_deg < least_el)
    return (
        F.when(unsure, "ambiguous").when(los & (cn0 < weak), "missing_building").when(~los & (cn0 >= strong), "phantom_building")
        .when(los & (cn0 >= strong) | ~los & (cn0 < weak), "consistent").otherwise("ambiguous")
    )
