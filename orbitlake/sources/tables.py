"""CSV scans of observations, truth and inertial data with column aliases, and of the phone's raw log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G

# fixed values: names that files use for a column, the preferred one first
GNSS = {
    "time": ["GPS_time", "gps_time", "time", "timestamp", "Time", "GPSTime"],
    "prn": ["PRN", "prn", "SatID", "sat_id", "sv", "SV"],
    "pseudorange": ["pseudorange", "Pseudorange", "pr", "P1", "P2", "C1", "C2"],
    "carrier": ["carrier", "CarrierPhase", "L1", "L2", "carrier_phase"],
    "cn0": ["CN0", "cn0", "CNR", "snr", "SNR", "C/N0"],
    "doppler": ["doppler", "Doppler", "D1", "D2"],
}
TRUTH = {
    "time": ["GPS TOW (s)", "GPS TOW", "GPS_time", "gps_time", "time", "timestamp", "Time"],
    "lat": ["latitude", "lat", "Latitude", "Lat", "Latitude (deg)"],
    "lon": ["longitude", "lon", "Longitude", "Lon", "Longitude (deg)"],
    "alt": ["Altitude (m)", "Ellipsoid Height (m)", "Ellipsoid Height", "altitude", "alt", "Altitude", "Alt", "height", "Height"],
    "x": ["ECEF X (m)", "ECEF X", "x", "X", "ECEF_X", "ecef_x", "pos_x"],
    "y": ["ECEF Y (m)", "ECEF Y", "y", "Y", "ECEF_Y", "ecef_y", "pos_y"],
    "z": ["ECEF Z (m)", "ECEF Z", "z", "Z", "ECEF_Z", "ecef_z", "pos_z"],
}
IMU = {
    "tow": ["GPS TOW (s)", "tow", "GPS_time", "time"],
    "ax": ["Acc X (m/s^2)", "accel_x", "acc_x"], "ay": ["Acc Y (m/s^2)", "accel_y", "acc_y"], "az": ["Acc Z (m/s^2)", "accel_z", "acc_z"],
    "gx": ["Ang Rate X (deg/s)", "gyro_x"], "gy": ["Ang Rate Y (deg/s)", "gyro_y"], "gz": ["Ang Rate Z (deg/s)", "gyro_z"],
}
# fixed values: fields of a raw line of the phone's log, in order
RAW_FIELDS = [
    "utcTimeMillis", "TimeNanos", "LeapSecond", "TimeUncertaintyNanos", "FullBiasNanos", "BiasNanos", "BiasUncertaintyNanos", "DriftNanosPerSecond",
    "DriftUncertaintyNanosPerSecond", "HardwareClockDiscontinuityCount", "Svid", "TimeOffsetNanos", "State", "ReceivedSvTimeNanos",
    "ReceivedSvTimeUncertaintyNanos", "Cn0DbHz", "PseudorangeRateMetersPerSecond", "PseudorangeRateUncertaintyMetersPerSecond",
    "AccumulatedDeltaRangeState", "AccumulatedDeltaRangeMeters", "AccumulatedDeltaRangeUncertaintyMeters", "CarrierFrequencyHz", "CarrierCycles",
    "CarrierPhase", "CarrierPhaseUncertainty", "MultipathIndicator", "SnrInDb", "ConstellationType", "AgcDb", "BasebandCn0DbHz",
    "FullInterSignalBiasNanos", "FullInterSignalBiasUncertaintyNanos", "SatelliteInterSignalBiasNanos", "SatelliteInterSignalBiasUncertaintyNanos",
    "CodeType", "ChipsetElapsedRealtimeNanos",
]
_WHOLE = {"utcTimeMillis", "TimeNanos", "FullBiasNanos", "ReceivedSvTimeNanos", "ChipsetElapsedRealtimeNanos", "State", "AccumulatedDeltaRangeState", "Svid", "ConstellationType", "HardwareClockDiscontinuityCount"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with blanks around names and values taken off."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def pick(df: DataFrame, names: list[str]) -> Column | None:
    """The first of the names that the table has."""
    found = next((n for n in names if n in df.columns), None)
    return F.col(f"`{found}`") if found else None


def _number(df: DataFrame, names: list[str]) -> Column:
    c = pick(df, names)
    return F.lit(None).cast("double") if c is None else c.try_cast("double")


def gnss_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, prn, pseudorange, carrier, cn0, doppler; what is absent or no number is null. Other columns as numbers.

    A file without a column of the time, the satellite or the pseudorange, by any of their names, is an error.
    """
    df = read_csv(spark, path)
    prn = pick(df, GNSS["prn"])
    absent = [c for c in ("time", "prn", "pseudorange") if pick(df, GNSS[c]) is None]
    if absent:
        raise ValueError(f"no column of {', '.join(absent)} among {df.columns}")
    known = {next((n for n in ns if n in df.columns), None) for ns in GNSS.values()}
    own = [_number(df, GNSS[c]).alias(c) if c != "prn" else F.trim(prn).alias("prn") for c in GNSS]
    return df.select(*own, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns if c not in known])


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, x, y, z of a reference track, from ECEF columns if there are any, else from latitude, longitude and height."""
    df = read_csv(spark, path)
    if all(pick(df, TRUTH[c]) is not None for c in "xyz"):
        xyz = [_number(df, TRUTH[c]) for c in "xyz"]
    elif pick(df, TRUTH["lat"]) is not None and pick(df, TRUTH["lon"]) is not None:
        alt = F.lit(0.0) if pick(df, TRUTH["alt"]) is None else _number(df, TRUTH["alt"])
        xyz = list(G.lla_to_ecef(F.radians(_number(df, TRUTH["lat"])), F.radians(_number(df, TRUTH["lon"])), alt))
    else:
        raise ValueError("a truth table needs x, y, z or latitude and longitude")
    return df.select(_number(df, TRUTH["time"]).alias("time"), *[c.alias(n) for n, c in zip("xyz", xyz)])


def imu_csv(spark: SparkSession, path: str, degrees: bool = True) -> DataFrame:
    """tow, ax..az, gx..gz (radians a second if the file has degrees) by column names; rows without a time are left out."""
    df = read_csv(spark, path)
    turn = F.radians if degrees else (lambda c: c)
    out = df.select(*[(turn(_number(df, ns)) if c[0] == "g" else _number(df, ns)).alias(c) for c, ns in IMU.items()])
    return out.where("tow is not null")


def imu_positional(spark: SparkSession, path: str) -> DataFrame:
    """tow, ax..az, gx..gz, wheel from lines by position (0, 2-4, 5-7, 8); the header and short lines are left out."""
    f = F.split(F.col("value"), ",")
    at = lambda i: F.trim(F.get(f, F.lit(i))).try_cast("double")
    rows = spark.read.text(path).where(F.size(f) >= 8)
    out = rows.select(*[at(i).alias(c) for c, i in zip(("tow", "ax", "ay", "az", "gx", "gy", "gz", "wheel"), (0, 2, 3, 4, 5, 6, 7, 8))])
    return out.where("tow is not null")


def raw_log(spark: SparkSession, path: str, half_of_repeats: bool = False) -> DataFrame:
    """Lines that open with Raw as typed columns; short lines are filled with nulls.

    Phones that tell every observation twice (half_of_repeats) have only the first half of each epoch kept, by line order.
    """
    lines = spark.read.text(path).where(F.col("value").startswith("Raw,"))
    f = F.split(F.col("value"), ",")
    kind = lambda c: "string" if c == "CodeType" else "long" if c in _WHOLE else "double"
    cell = lambda i, c: F.nullif(F.trim(F.get(f, F.lit(i + 1))), F.lit(""))
    own = [(cell(i, c) if c == "CodeType" else cell(i, c).try_cast("double").cast("long") if c in _WHOLE and c not in ("TimeNanos", "FullBiasNanos", "ReceivedSvTimeNanos") else cell(i, c).try_cast(kind(c))).alias(c) for i, c in enumerate(RAW_FIELDS)]
    out = lines.select(*own, F.monotonically_increasing_id().alias("__line"))
    if half_of_repeats:
        from pyspark.sql import Window

        w = Window.partitionBy("utcTimeMillis")
        out = out.withColumn("__half", F.row_number().over(w.orderBy("__line")) <= F.floor(F.count(F.lit(1)).over(w) / 2)).where("__half").drop("__half")
    return out.drop("__line")


def phone_imu(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one MessageType (UncalAccel, UncalGyro, UncalMag) with utcTimeMillis and x, y, z."""
    df = read_csv(spark, path)
    n = lambda c: F.col(c).try_cast("double")
    return df.where(F.col("MessageType") == kind).select(F.col("utcTimeMillis").try_cast("long").alias("utcTimeMillis"), *[n(f"Measurement{a}").alias(a.lower()) for a in "XYZ"])


def device_gnss(spark: SparkSession, path: str) -> DataFrame:
    """Known columns of a phone's table as numbers (SignalType as text); unknown ones are dropped, missing ones an error."""
    df = read_csv(spark, path)
    need = ["utcTimeMillis", "Svid", "ConstellationType", "SignalType", "RawPseudorangeMeters", "IonosphericDelayMeters", "TroposphericDelayMeters", "SvClockBiasMeters", *[f"SvPosition{a}EcefMeters" for a in "XYZ"], "SvElevationDegrees", "Cn0DbHz", *[f"WlsPosition{a}EcefMeters" for a in "XYZ"]]
    may = ["State", "MultipathIndicator", "PseudorangeRateMetersPerSecond", "AccumulatedDeltaRangeMeters", "AccumulatedDeltaRangeState", "BiasUncertaintyNanos"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kind = {"utcTimeMillis": "long", "Svid": "int", "ConstellationType": "int", "State": "long", "AccumulatedDeltaRangeState": "long"}
    cast = lambda c: F.col(c) if c == "SignalType" else F.col(c).try_cast("double").cast(kind[c]) if c in kind and c != "utcTimeMillis" else F.col(c).try_cast(kind.get(c, "double"))
    return df.select(*[cast(c).alias(c) for c in need + [c for c in may if c in df.columns]])


def result_csvs(spark: SparkSession, glob: str, pattern: str, groups: list[str]) -> DataFrame:
    """All files that match, with columns parsed from their names; missing columns are null."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("inferSchema", True).csv(glob).withColumn("__f", F.input_file_name())
    return df.withColumns({g: F.regexp_extract("__f", pattern, i) for i, g in enumerate(groups, 1)}).drop("__f")
