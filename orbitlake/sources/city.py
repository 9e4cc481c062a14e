"""City models: buildings and bridges of GML files as polygons and triangles, in Spark functions on splittable records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G

# fixed values: elements of the features by kind
KINDS = {"bldg": "Building", "brid": "Bridge"}
_NAME = r"(?:[A-Za-z_][\w.-]*:)?"


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda v: v != ""), lambda v: v.cast("double"))


def _points(numbers: Column) -> Column:
    """Array of (a, b, c) from a flat one; a length that is no multiple of 3 is an error."""
    at = lambda i, k: F.get(numbers, i * 3 + k)
    whole = F.when(F.size(numbers) % 3 == 0, F.size(numbers)).otherwise(F.raise_error(F.concat(F.lit("a list of "), F.size(numbers).cast("string"), F.lit(" coordinates is not of points"))).cast("int"))
    index = F.when(whole > 0, F.sequence(F.lit(0), (whole / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c")))


def city_features(spark: SparkSession, path: str, kind: str = "bldg") -> DataFrame:
    """(file, id, kind, lod, polygons): a row for each building (bldg) or bridge (brid), polygons as arrays of points (a, b, c).

    Files are cut into records behind each end tag of the kind's element, which Spark can do anywhere in a file, so a model
    of any size is many tasks and no file is read as one piece. Prefixes may be any or none. A feature's polygons are its
    position lists in order, then its rings of single positions; its level is the highest whose solid or surfaces it
    has, 0 without. No id gives null. Comments are taken off. A feature inside one of its own kind is told by itself only.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}, known are {sorted(KINDS)}")
    element = KINDS[kind]
    raw = spark.read.option("lineSep", f"{element}>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("t"))
    ended = raw.where(F.col("t").rlike(rf"</{_NAME}$"))
    # behind the last opening of the element; an opening without attributes has ended the record before
    opened = F.regexp_extract("t", rf"(?s)^.*(<{_NAME}{element}\s[^>]*>)", 1)
    body = F.regexp_replace("t", rf"(?s)^.*<{_NAME}{element}\s[^>]*>", "")
    head = ended.select("file", F.regexp_extract(opened, r"""\s(?:[\w.-]+:)?id\s*=\s*["']([^"']*)["']""", 1).alias("id"), body.alias("body"))
    lists = F.regexp_extract_all("body", F.lit(rf"(?s)<{_NAME}posList(?:\s[^>]*)?>([^<]*)<"), 1)
    rings = F.regexp_extract_all("body", F.lit(rf"(?s)<{_NAME}LinearRing(?:\s[^>]*)?>(.*?)</{_NAME}LinearRing"), 1)
    single = F.transform(rings, lambda r: F.array_join(F.regexp_extract_all(r, F.lit(rf"(?s)<{_NAME}pos(?:\s[^>]*)?>([^<]*)<"), 1), " "))
    texts = F.filter(F.concat(lists, single), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")) != "")
    lod = F.lit(0)
    for level in range(1, 5):
        lod = F.when(F.col("body").rlike(rf"<{_NAME}lod{level}(Solid|MultiSurface)[\s/>]"), level).otherwise(lod)
    return head.select("file", F.nullif(F.col("id"), F.lit("")).alias("id"), F.lit(kind).alias("kind"), lod.alias("lod"), F.transform(texts, lambda v: _points(_numbers(v))).alias("polygons"))


def city_triangles(features: DataFrame, geographic: bool = False, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """(file, id, lod, polygon, x0..z2): polygons as fans from their first point; a closing point that repeats it is left out.

    Points are taken as they are (x, y, z), or with `geographic` as latitude and longitude in degrees and height, and turned
    into ECEF; `origin` is taken off the coordinates then. Polygons of under three points give no triangle.
    """
    rings = features.select("file", "id", "lod", F.posexplode("polygons").alias("polygon", "p"))
    closed = (F.size("p") > 1) & (F.get("p", F.lit(0)) == F.element_at("p", -1))
    rings = rings.withColumn("p", F.when(closed, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))).where(F.size("p") >= 3)
    fans = rings.select("file", "id", "lod", "polygon", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("i"))
    corners = []
    for n, at in enumerate((F.lit(0), F.col("i"), F.col("i") + 1)):
        v = F.get("p", at)
        xyz = (v["a"], v["b"], v["c"])
        if geographic:
            xyz = G.lla_to_ecef(F.radians(v["a"]), F.radians(v["b"]), v["c"])
        corners += [(c - o).alias(f"{k}{n}") for k, c, o in zip("xyz", xyz, origin or (0.0, 0.0, 0.0))]
    return fans.select("file", "id", "lod", "polygon", *corners)
