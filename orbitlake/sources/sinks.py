"""Sinks: NMEA sentences, GeoJSON cells, CSV over the union of columns, exports with metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nmea import checksum


def _sentence(body: Column) -> Column:
    return F.concat(F.lit("$"), body, F.lit("*"), checksum(body))


def _angle(degrees: Column, whole: int, positive: str, negative: str) -> Column:
    a = F.abs(degrees)
    d = F.floor(a)
    side = F.when(degrees >= 0, positive).otherwise(negative)
    return F.concat(F.lpad(d.cast("int").cast("string"), whole, "0"), F.lpad(F.format_string("%.6f", ((a - d) * 60.0).cast("double")), 9, "0"), F.lit(","), side)


def _clock(time: Column) -> Column:
    return F.substring(F.date_format(time, "HHmmss.SSSSSS"), 1, 10)


def gga(time: Column, lat: Column, lon: Column, alt: Column, quality: Column, satellites: Column, hdop: Column, talker: str = "GP") -> Column:
    """GGA sentences with checksum."""
    body = F.concat(F.lit(f"{talker}GGA,"), _clock(time), F.lit(","), _angle(lat, 2, "N", "S"), F.lit(","), _angle(lon, 3, "E", "W"), F.lit(","), quality.cast("string"), F.lit(","), F.lpad(satellites.cast("string"), 2, "0"), F.format_string(",%.1f,%.3f,M,0.000,M,,", hdop.cast("double"), alt.cast("double")))
    return _sentence(body)


def rmc(time: Column, lat: Column, lon: Column, knots: Column, course: Column, talker: str = "GP") -> Column:
    body = F.concat(F.lit(f"{talker}RMC,"), _clock(time), F.lit(",A,"), _angle(lat, 2, "N", "S"), F.lit(","), _angle(lon, 3, "E", "W"), F.format_string(",%.1f,%.1f,", knots.cast("double"), course.cast("double")), F.date_format(time, "ddMMyy"), F.lit(",,,"))
    return _sentence(body)


def write_nmea(df: DataFrame, path: str, sentences: list[Column]) -> None:
    """Sentences of each row in order, one a line."""
    df.select(F.explode(F.array(*sentences)).alias("value")).write.text(path)


def geojson_cells(df: DataFrame, lon: str, lat: str, half: float, metric: str) -> DataFrame:
    """One Feature a row (column value): the square around a grid point with its metric."""
    corner = lambda i, j: F.array(F.col(lon) + i * half, F.col(lat) + j * half)
    ring = F.array(F.array(*[corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), F.struct(F.col(metric).alias(metric)).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """Frames under one header, their columns in order of first sight; cells that a frame lacks are empty."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*names).write.option("header", True).csv(path)


def export_run(positions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Positions as parquet, metrics as JSON lines, in one folder."""
    positions.write.parquet(f"{path}/positions")
    metrics.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/metrics")
