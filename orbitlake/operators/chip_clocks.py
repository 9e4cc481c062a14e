"""Pseudoranges from the clocks of a phone's receiver chip: arrival by the receiver's counter, departure as the satellite tells it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import unwrap

LIGHT = 299792458.0
WEEK, DAY = 604800.0, 86400.0
WEEK_NANOS = 604_800_000_000_000
#: Constellation types of phone logs.
GLONASS, BEIDOU = 3, 5


def raw_ranges(df: DataFrame, by: list[str], band: str) -> DataFrame:
    """Rows of a phone's raw log with `tow_rx_s`, `tow_tx_s` and `PseudorangeMeters`.

    Times of an epoch (utcTimeMillis) are those of its first row by constellation, satellite and carrier. The receiver's bias
    holds until its counter jumps by over a second. BeiDou's week starts 14 s later, GLONASS tells the time of its day in
    Moscow: the day is the one that puts it on the receiver's. Weeks that roll over within a signal (band of a satellite) are
    taken out of both times. A row without one of its times has a null range and does not count for the others of its signal.
    """
    stamps = ["TimeNanos", "FullBiasNanos", "BiasNanos"]
    epochs = df.groupBy(*by, "utcTimeMillis").agg(F.min(F.struct("ConstellationType", "Svid", "CarrierFrequencyHz", *stamps)).alias("e"))
    w = Window.partitionBy(*by).orderBy("utcTimeMillis")
    epochs = epochs.select(*by, "utcTimeMillis", *[F.col(f"e.{c}").alias(f"__{c}") for c in stamps])
    step = F.abs(F.col("__TimeNanos").cast("double") - F.lag("__TimeNanos").over(w).cast("double"))
    fresh = F.when(step.isNull() | (step > 1e9), F.col("__FullBiasNanos"))
    epochs = epochs.withColumn("__fresh", fresh).withColumn("__elapsed", F.col("__TimeNanos") - F.last("__fresh", True).over(w))
    week = F.floor(F.col("__elapsed").cast("double") / float(WEEK_NANOS)).cast("long")
    rx = (F.col("__elapsed") - week * F.lit(WEEK_NANOS)).cast("double") / 1e9 - F.col("__BiasNanos") / 1e9
    keys = [*by, "utcTimeMillis"]
    times = epochs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], rx.alias("__rx"))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & df[c].eqNullSafe(times[f"__k{i}"])
    rows = df.join(times, on).drop(*[f"__k{i}" for i in range(len(keys))])
    rows = rows.withColumn("tow_rx_s", F.col("__rx") - F.coalesce(F.col("TimeOffsetNanos"), F.lit(0.0)) / 1e9).drop("__rx")
    told, day = F.col("ReceivedSvTimeNanos").cast("double") / 1e9, F.floor(F.col("tow_rx_s") / DAY)
    moscow = told + day * DAY - 3.0 * 3600.0 + 18.0
    glonass = moscow + (day - F.floor(moscow / DAY)) * DAY
    tx = F.when(F.col("ConstellationType") == BEIDOU, told + 14.0).when(F.col("ConstellationType") == GLONASS, glonass).otherwise(told)
    rows = rows.withColumn("tow_tx_s", tx)
    signal = F.struct(*by, "ConstellationType", "Svid", band, (F.col("tow_rx_s") + F.col("tow_tx_s")).isNull().alias("lacks"))
    rows = rows.withColumn("__signal", signal)
    order = ["utcTimeMillis", "CarrierFrequencyHz", "ReceivedSvTimeNanos"]
    rows = unwrap(unwrap(rows, "__signal", order, "tow_rx_s", WEEK), "__signal", order, "tow_tx_s", WEEK)
    out = rows.withColumn("PseudorangeMeters", (F.col("tow_rx_s_unwrapped") - F.col("tow_tx_s_unwrapped")) * LIGHT)
    return out.drop("__signal", "tow_rx_s_unwrapped", "tow_tx_s_unwrapped")
