"""NMEA sentences as a table, with Spark's text reader and column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(body: Column) -> Column:
    """XOR of the characters as two hex digits."""
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))), 2, "0")


def _degrees(value: Column, side: Column) -> Column:
    v = value.try_cast("double")
    whole = F.floor(v / 100)
    return (whole + (v - whole * 100) / 60) * F.when(side.isin("S", "W"), -1).otherwise(1)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """GGA and RMC sentences with a right checksum: kind, utc, lat, lon (degrees), quality, satellites, hdop, altitude, speed.

    Other lines, null ones and those with a wrong checksum give no row; empty fields are null.
    """
    m = lambda g: F.regexp_extract(F.trim(F.col(column)), r"^\$([^*]*)\*([0-9A-Fa-f]{2})$", g)
    good = lines.select(m(1).alias("body"), m(2).alias("sum")).where("body <> ''")
    good = good.where(checksum(F.col("body")) == F.upper("sum")).select(F.split("body", ",").alias("f"))
    f = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    kind = F.substring(f(0), -3, 3)
    gga = kind == "GGA"
    pick = lambda a, b: F.when(gga, f(a)).otherwise(f(b))
    return good.where(kind.isin("GGA", "RMC")).select(
        kind.alias("kind"), f(1).alias("utc"), _degrees(pick(2, 3), pick(3, 4)).alias("lat"), _degrees(pick(4, 5), pick(5, 6)).alias("lon"),
        F.when(gga, f(6).try_cast("int")).alias("quality"), F.when(gga, f(7).try_cast("int")).alias("satellites"), F.when(gga, f(8).try_cast("double")).alias("hdop"),
        F.when(gga, f(9).try_cast("double")).alias("altitude"), F.when(~gga, f(7).try_cast("double")).alias("speed_knots"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
