"""RINEX observation and navigation files as long tables.

Version 3 observations are read splittably: the text source cuts files at epoch marks, and columns do the rest. Version 2
and navigation files have no mark that a record starts with, so each is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _types(head: str) -> list[tuple[str, list[str]]]:
    """(system, codes) of a header; version 2 has one list, for system ''."""
    out: list[tuple[str, list[str]]] = []
    for line in head.splitlines():
        label = line[60:].strip()
        if label.startswith("SYS / # / OBS TYPES"):
            if line[0] != " ":
                out.append((line[0], []))
            out[-1][1].extend(line[7:60].split())
        elif label == "# / TYPES OF OBSERV":
            if not out:
                out.append(("", []))
            out[-1][1].extend(line[6:60].split())
    return out


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, s, c) for f, v in zip(b["file"], b["value"]) for s, c in _types(v)]
        yield pd.DataFrame(rows, columns=["file", "system", "codes"])


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(file, time, satellite, code, value) of version 3 files; a blank or bad number is 0. Event records are left out."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), "value")
    head = records.where(F.col("value").contains("END OF HEADER"))
    codes = head.mapInPandas(_headers, "file string, system string, codes array<string>")
    body = records.where(~F.col("value").contains("END OF HEADER")).withColumn("lines", F.split(F.regexp_replace("value", "\r", ""), "\n"))
    p = F.split(F.trim(F.regexp_replace(F.col("lines")[0], "^>", "")), r"\s+")
    at = lambda i: F.get(p, F.lit(i))
    seconds = at(5).try_cast("double")
    day = F.concat_ws("-", at(0), F.lpad(at(1), 2, "0"), F.lpad(at(2), 2, "0"))
    time = F.timestamp_add("MICROSECOND", F.rint((at(3).try_cast("int") * 3600 + at(4).try_cast("int") * 60 + seconds) * 1e6).cast("long"), day.try_cast("date").cast("timestamp_ntz"))
    body = body.where((F.size(p) >= 7) & (at(6).try_cast("int") <= 1)).withColumn("time", time)
    # a line without a satellite goes on with the one before
    joined = F.aggregate(
        F.slice("lines", 2, 100_000), F.array().cast("array<string>"),
        lambda acc, x: F.when(x.rlike("^[A-Z][ 0-9][0-9]"), F.concat(acc, F.array(x))).when((F.size(acc) > 0) & (F.trim(x) != ""), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.substring(x, 4, 1000))))).otherwise(acc))
    sats = body.select("file", "time", F.explode(joined).alias("line")).withColumns({"satellite": F.regexp_replace(F.substring("line", 1, 3), " ", "0"), "system": F.substring("line", 1, 1)})
    long = sats.join(codes, ["file", "system"]).select("file", "time", "satellite", "line", F.posexplode("codes").alias("i", "code"))
    value = F.trim(F.col("line").substr(F.col("i") * 16 + 4, F.lit(14))).try_cast("double")
    return long.select("file", "time", "satellite", "code", F.coalesce(value, F.lit(0.0)).alias("value"))


def _number(text: str) -> float:
    try:
        return float(text.replace("D", "E").replace("d", "e")) if text.strip() else 0.0
    except ValueError:
        return 0.0


def _v2_rows(text: str) -> Iterator[tuple]:
    head, _, rest = text.partition("END OF HEADER")
    codes = next((c for _, c in _types(head + "END OF HEADER")), [])
    default = next((x[40:41].strip() for x in head.splitlines() if x[60:].startswith("RINEX VERSION")), "") or "G"
    lines, i, per = rest.splitlines()[1:], 0, max(1, -(-len(codes) // 5))
    while i < len(lines):
        x = lines[i]
        try:
            year, n, flag = int(x[1:3]), int(x[29:32]), int(x[28:29])
            time = pd.Timestamp(year + (2000 if year < 80 else 1900), int(x[4:6]), int(x[7:9]), int(x[10:12]), int(x[13:15])) + pd.Timedelta(microseconds=round(float(x[15:26]) * 1e6))
        except ValueError:
            i += 1
            continue
        if flag > 1:
            i += 1 + n * per
            continue
        names = x[32:68]
        while len(names.rstrip()) < 3 * n - 2 and i + 1 < len(lines):
            i += 1
            names = names.ljust(36 * (len(names) // 36 or 1)) + lines[i][32:68]
        sats = [names[k : k + 3] for k in range(0, 3 * n, 3)]
        i += 1
        for s in sats:
            own = "".join(y.ljust(80) for y in lines[i : i + per])
            i += per
            name = f"{s[0] if s[:1].strip() else default}{int(s[1:]):02d}"
            for k, c in enumerate(codes):
                yield time, name, c, _number(own[16 * k : 16 * k + 14])


def observations_v2(spark: SparkSession, path: str) -> DataFrame:
    """The same of version 2 files, whose satellite lists and values wrap over lines; each file in one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, v in zip(b["file"], b["value"]):
                yield pd.DataFrame([(f, *r) for r in _v2_rows(v)], columns=["file", "time", "satellite", "code", "value"])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(rows, "file string, time timestamp_ntz, satellite string, code string, value double")


def pseudorange_lists(obs: DataFrame, code: str) -> DataFrame:
    """(time, satellites, values) of one code where it is not 0, in order of the satellites."""
    own = obs.where((F.col("code") == code) & (F.col("value") != 0)).groupBy("time").agg(F.array_sort(F.collect_list(F.struct("satellite", "value"))).alias("o"))
    return own.select("time", F.col("o.satellite").alias("satellites"), F.col("o.value").alias("values"))


# fixed values: elements of the seven orbit lines, four in a line
_ELEMENTS = "iode crs delta_n m0 cuc e cus sqrt_a toe cic omega0 cis i0 crc omega omega_dot idot codes_on_l2 week l2_p_flag accuracy health tgd iodc transmission fit_interval _ _".split()
_STATE = "px vx ax health py vy ay channel pz vz az age".split()


def _nav_rows(text: str) -> Iterator[dict]:
    lines, i = text.partition("END OF HEADER")[2].splitlines()[1:], 0
    while i < len(lines):
        x = lines[i]
        if not x[:1].isalpha() or len(x) < 23:
            i += 1
            continue
        system, size = x[0], 4 if x[0] in "RS" else 8
        if i + size > len(lines):
            return
        try:
            toc = pd.Timestamp(int(x[4:8]), int(x[9:11]), int(x[12:14]), int(x[15:17]), int(x[18:20])) + pd.Timedelta(seconds=int(float(x[21:23])))
            prn = int(x[1:3])
        except ValueError:
            i += 1
            continue
        at = (toc - pd.Timestamp(1980, 1, 6)).total_seconds()
        row = {"system": system, "prn": prn, "toc_time": toc, "toc": at % 604800, "week": float(at // 604800)}
        row |= dict(zip(("af0", "af1", "af2"), (_number(x[k : k + 19]) for k in (23, 42, 61))))
        values = [_number(lines[i + k][s : s + 19]) for k in range(1, size) for s in (4, 23, 42, 61)]
        if size == 4:
            row |= {c: v * (1000.0 if c[0] in "pva" and len(c) == 2 else 1.0) for c, v in zip(_STATE, values)} | {"toe": row["toc"], "af2": 0.0}
        else:
            row |= {c: v for c, v in zip(_ELEMENTS, values) if c != "_"}
            if system == "E":
                row |= {"data_sources": row["codes_on_l2"], "bgd_e5a": row["tgd"], "bgd_e5b": row["iodc"]}
        yield row
        i += size


_NAV = ["system string", "prn int", "toc_time timestamp_ntz", "toc double", "af0 double", "af1 double", "af2 double", *[f"{c} double" for c in dict.fromkeys(_ELEMENTS) if c != "_"], *[f"{c} double" for c in _STATE if c not in ("health",)], "data_sources double", "bgd_e5a double", "bgd_e5b double"]


def navigation(spark: SparkSession, path: str) -> DataFrame:
    """Broadcast records of version 3 files: Kepler elements, or state vectors (metres) for GLONASS; the other is null."""
    names = [c.split()[0] for c in _NAV]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v in b["value"]:
                yield pd.DataFrame(list(_nav_rows(v)), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(rows, ", ".join(_NAV))


def ionosphere_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, alpha, beta) from the headers of navigation files of version 2 or 3; null where there are none."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "[Dd]([+-]?[0-9])", "E$1").alias("v"), "value")
    label = F.trim(F.substring("value", 61, 20))
    p = F.split(F.trim("v"), r"\s+")
    four = lambda i: F.transform(F.slice(p, i, 4), lambda x: x.try_cast("double"))
    a = F.when(F.col("value").startswith("GPSA"), four(2)).when(label == "ION ALPHA", four(1))
    b = F.when(F.col("value").startswith("GPSB"), four(2)).when(label == "ION BETA", four(1))
    return lines.select("file", a.alias("a"), b.alias("b")).groupBy("file").agg(F.first("a", True).alias("alpha"), F.first("b", True).alias("beta"))
