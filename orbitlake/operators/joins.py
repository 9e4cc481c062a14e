"""Joins that align tables in time and compare key sets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def nearest_asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the nearest right row of its key: columns `{value}`, `{at}_right`; a tie goes to the earlier.

    One shuffle by key: both sides are put in one time order, and a running window in each direction finds the last and
    the next right row in one pass. A right row at the same time counts as before. Beyond the tolerance, and for keys without a right row,
    the columns are null.
    """
    cols = [c for c in left.columns if c not in (by, at)]
    hit = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    a = left.select(by, at, F.struct(*[F.col(c) for c in cols]).alias("own"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("hit"), F.lit(1).alias("side"))
    b = right.select(by, at, F.lit(None).cast(a.schema["own"].dataType).alias("own"), hit.alias("hit"), F.lit(0).alias("side"))
    order = Window.partitionBy(by).orderBy(at, "side")
    back = F.last("hit", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("hit", True).over(Window.partitionBy(by).orderBy(F.col(at).desc(), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumns({"p": back, "n": ahead}).where("side = 1")
    near = F.when(F.col("p").isNull() | (F.col("n")["at"] - F.col(at) < F.col(at) - F.col("p")["at"]), F.col("n")).otherwise(F.col("p"))
    out = both.withColumn("m", near)
    if tolerance is not None:
        out = out.withColumn("m", F.when(F.abs(F.col("m")["at"] - F.col(at)) <= tolerance, F.col("m")))
    return out.select(by, at, "own.*", F.col("m")["v"].alias(value), F.col("m")["at"].alias(f"{at}_right"))


def interpolated_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, max_gap: float) -> DataFrame:
    """Right values at left times by straight lines between the rows strictly before and after, no further apart than max_gap."""
    hit = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    a = left.select(by, at, F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("hit"), F.lit(True).alias("own"))
    order = Window.partitionBy(by).orderBy(at)
    both = a.unionByName(right.select(by, at, hit.alias("hit"), F.lit(False).alias("own")))
    strictly = lambda w: w.rangeBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(by).orderBy(F.col(at).desc())
    both = both.withColumns({"p": F.last("hit", True).over(strictly(order)), "n": F.last("hit", True).over(strictly(back))}).where("own")
    gap = F.col("n")["at"] - F.col("p")["at"]
    share = (F.col(at) - F.col("p")["at"]) / gap
    return both.select(by, at, F.when(gap <= max_gap, F.col("p")["v"] + share * (F.col("n")["v"] - F.col("p")["v"])).alias(value))


def quadratic_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, nearest: int = 8) -> DataFrame:
    """Distinct left keys and times with the value of a parabola through the nearest right rows of the key.

    Between the first and last right time, with three rows or more, it is the least-squares parabola of the `nearest`
    rows (of equally near ones the earlier, then the lower value), at the left time; a straight line between the rows around it where
    there are two, or where times repeat so that no parabola is told; the nearest end beyond the span; the only value
    of one row; null without any. Null times, values and keys of right rows are left out, NaN and infinite ones too.

    Right rows are numbered in one ordered pass that also counts those before each left time. The rows around that count
    then come by an equi join on key and number, so no key's rows meet all its times; fits are sums.
    """
    whole = right.select(F.col(by), F.col(at).cast("double").alias("__at"), F.col(value).cast("double").alias("__v")).dropna()
    whole = whole.where(~F.isnan("__at") & ~F.isnan("__v") & (F.abs("__at") < float("inf")) & (F.abs("__v") < float("inf")))
    asked = left.select(by, F.col(at).cast("double").alias("__at")).dropna().distinct()
    order = Window.partitionBy(by).orderBy("__at", F.col("__own").cast("int"), "__v")
    both = whole.withColumn("__own", F.lit(False)).unionByName(asked.withColumns({"__own": F.lit(True), "__v": F.lit(None).cast("double")}))
    # right rows of the same time come before the left one
    both = both.withColumn("__n", F.sum((~F.col("__own")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = both.where(~F.col("__own")).select(by, "__n", F.col("__at").alias("__rt"), "__v")
    places = F.explode(F.sequence(F.col("__n") - nearest + 1, F.col("__n") + nearest))
    around = both.where("__own").select(by, "__at", F.col("__n").alias("__before"), places.alias("__n")).join(rows, [by, "__n"])
    x = F.col("__rt") - F.col("__at")
    hits = around.groupBy(by, "__at").agg(F.first("__before").alias("before"), F.sort_array(F.collect_list(F.struct(F.abs(x).alias("far"), F.col("__rt").alias("t"), F.col("__v").alias("v"), F.col("__n").alias("n"), x.alias("x")))).alias("hits"))
    hits = hits.withColumn("near", F.slice("hits", 1, nearest))
    scale = F.coalesce(F.nullif(F.array_max("near.far"), F.lit(0.0)), F.lit(1.0))
    told = lambda f: F.aggregate("near", F.lit(0.0), lambda acc, h: acc + f(h["x"] / F.col("scale"), h["v"]))
    hits = hits.withColumn("scale", scale)
    hits = hits.withColumns({f"s{k}": told(lambda x, v, k=k: F.pow(x, F.lit(k)) if k else F.lit(1.0)) for k in range(5)} | {f"m{k}": told(lambda x, v, k=k: v * (F.pow(x, F.lit(k)) if k else F.lit(1.0))) for k in range(3)})
    s, m = [F.col(f"s{k}") for k in range(5)], [F.col(f"m{k}") for k in range(3)]
    minor = [s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]]
    det = s[0] * minor[0] - s[1] * minor[1] + s[2] * minor[2]
    before = F.array_max(F.filter("hits", lambda h: h["n"] <= F.col("before"))["n"])
    pick = lambda n: F.get(F.filter("hits", lambda h: h["n"] == n), F.lit(0))
    a, b = pick(before), pick(F.col("before") + 1)
    line = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["x"] == 0), a["v"]).otherwise(a["v"] - a["x"] * (b["v"] - a["v"]) / (b["t"] - a["t"]))
    inside = a.isNotNull() & (b.isNotNull() | (a["x"] == 0))
    parabola = (m[0] * minor[0] - m[1] * minor[1] + m[2] * minor[2]) / F.nullif(det, F.lit(0.0))
    fit = hits.select(by, "__at", F.when((F.size("near") >= 3) & inside & (F.abs(det) > 1e-12), parabola).otherwise(line).alias(value))
    return asked.join(fit, [by, "__at"], "left").select(by, F.col("__at").alias(at), value)


def interval_join(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the intervals [start, end) of their key that hold them, as an equi join on buckets of `width`."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    i = intervals.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, [by, "__bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def sides(left: DataFrame, right: DataFrame, keys: list[str], left_name: str = "left_only", right_name: str = "right_only") -> DataFrame:
    """Distinct keys of both tables with the side that has them: both, or one only."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__r").isNull(), left_name).when(F.col("__l").isNull(), right_name).otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def offset_lookup(left: DataFrame, right: DataFrame, by: str, at: str, value: str, offsets: list[int]) -> DataFrame:
    """Value of the right row at the left time plus the first of the offsets that has one."""
    tries = left.select(by, at).distinct().select(by, at, F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("rank", "shift"))
    met = tries.withColumn("__t", F.col(at) + F.col("shift")).join(right.select(by, F.col(at).alias("__t"), value), [by, "__t"])
    best = met.groupBy(by, at).agg(F.min_by(value, "rank").alias(value), F.min_by("shift", "rank").alias("shift"))
    return left.join(best, [by, at], "left")




def trim_to_span(rows: DataFrame, other: DataFrame, by: str, at: str, margin: float) -> DataFrame:
    """Rows within the time span of the other table's key, widened by a margin to both sides."""
    span = other.groupBy(by).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    return rows.join(span, by).where(F.col(at).between(F.col("__lo") - margin, F.col("__hi") + margin)).drop("__lo", "__hi")


def in_both_epochs(rows: DataFrame, by: list[str], epoch: str, value: str) -> DataFrame:
    """Rows whose key was there in the epoch just before, with `step`, the change since; one row for each key and epoch."""
    w = Window.partitionBy(*by).orderBy(epoch)
    out = rows.withColumns({"__e": F.lag(epoch).over(w), "step": F.col(value) - F.lag(value).over(w)})
    return out.where(F.col("__e") == F.col(epoch) - 1).drop("__e")


def _finer(counts: DataFrame, aim: int, fold: int) -> int:
    """How often to halve cells so that the fullest (column count) holds about `aim`, where halving makes `fold` cells of one."""
    most = counts.agg(F.max("count")).first()[0] or 1
    return min(20, max(0, math.ceil(math.log(most / aim, fold))))


def best_record(queries: DataFrame, records: DataFrame, by: str, at: str, reference: str, width: float, priority: str, week: float = 604800.0) -> DataFrame:
    """Each query with the record of its key whose reference time is nearest and within `width`; then the higher priority.

    Times are seconds of a week that wraps round. Of records of one key and time the best is kept. An equi join on the key and
    cells of the week: a cell's row lists the records in it and in the ones beside. Cells are first so small that they hold
    few records; a record found no further away than a cell is long is the nearest, and queries without one go on with
    cells twice as long, up to `width`. So work follows the queries, not the records that are near them.
    """
    own = [c for c in records.columns if c != by]
    place = lambda c, n: F.least(F.floor(F.pmod(F.col(c), F.lit(week)) / (week / n)).cast("long"), F.lit(n - 1))
    least = max(1, int(week // width))
    some = records.where(F.col(by).isNotNull() & F.col(reference).isNotNull())
    one = stored(some.groupBy(by, F.col(reference).alias("__ref")).agg(F.min(F.struct((-F.col(priority)).alias("p"), *own)).alias("__r")))
    levels = _finer(one.groupBy(by, place("__ref", least)).count(), 4, 2)
    rest, found = queries.distinct(), []
    for level in range(levels, -1, -1):
        n = least << level
        cells = F.explode(F.array_distinct(F.array(*[F.pmod(place("__ref", n) + i, F.lit(n)) for i in (-1, 0, 1)])))
        near = one.select(F.col(by), cells.alias("__c"), "__ref", "__r").groupBy(by, "__c").agg(F.collect_list(F.struct("__ref", "__r")).alias("__near")).hint("merge")
        reach = min(width, week / n * (1 - 1e-9)) if level else width

        def told(h):
            apart = F.abs(F.col(at) - h["__ref"])
            return F.struct(F.when(apart > week / 2, week - apart).otherwise(apart).alias("dt"), h["__r"].alias("r"))

        best = F.array_min(F.filter(F.transform("__near", told), lambda h: h["dt"] <= reach))
        met = stored(rest.withColumn("__c", place(at, n)).join(near, [by, "__c"], "left").select(*queries.columns, best.alias("__b")))
        found.append(met.where("__b is not null").select(*queries.columns, F.col("__b.dt").alias("dt"), *[F.col(f"__b.r.{c}").alias(c) for c in own]))
        rest = met.where("__b is null").select(*queries.columns)
    return reduce(DataFrame.unionByName, found)


def double_differences(rover: DataFrame, base: DataFrame, epoch: list[str], satellite: str, system: str, value: str, elevation: str, least: int = 2) -> DataFrame:
    """Differences of rover and base, less those of the highest satellite of the same system and epoch.

    Satellites that both receivers have, at least `least` in a system: (epoch, system, satellite, reference, dd).
    """
    both = rover.join(base.select(*epoch, satellite, F.col(value).alias("__b")), [*epoch, satellite])
    single = both.select(*epoch, system, satellite, elevation, (F.col(value) - F.col("__b")).alias("sd"))
    top = single.groupBy(*epoch, system).agg(F.min(F.struct(-F.col(elevation), satellite, "sd")).alias("t"), F.count("*").alias("n")).where(F.col("n") >= least)
    out = single.join(top, [*epoch, system]).where(F.col(satellite) != F.col(f"t.{satellite}"))
    return out.select(*epoch, system, satellite, F.col(f"t.{satellite}").alias("reference"), (F.col("sd") - F.col("t.sd")).alias("dd"))


def nearest_point(points: DataFrame, references: DataFrame, key: str, xy: list[str], label: str, reach: float) -> DataFrame:
    """(key, label, distance) of the nearest reference point within `reach`; of equally near ones the lowest label.

    An equi join on cells: a cell's row lists the references in it and in the ones beside, one for each place. Cells are first
    so small that they hold few references; one found no further away than a cell is wide is the nearest, and points
    without one go on with cells twice as wide, up to `reach`. So work follows the points, not the references near them.
    """
    names = [f"__{c}" for c in xy]
    known = references.where(" and ".join(f"`{c}` is not null" for c in xy))
    one = stored(known.groupBy(*[F.col(c).alias(n) for c, n in zip(xy, names)]).agg(F.min(F.struct(label))[label].alias("__label")))
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    levels = _finer(one.groupBy(*[cell(c, reach) for c in names]).count(), 8, 1 << len(xy))
    rest, found = points.select(key, *xy), []
    for level in range(levels, -1, -1):
        size = reach / 2**level
        near = one
        for i, c in enumerate(names):
            near = near.withColumn(f"c{i}", F.explode(F.array(*[cell(c, size) + j for j in (-1, 0, 1)])))
        on = [f"c{i}" for i in range(len(xy))]
        near = near.groupBy(*on).agg(F.collect_list(F.struct(*names, "__label")).alias("__near")).hint("merge")
        within = size * (1 - 1e-9) if level else reach

        def told(h):
            d = F.sqrt(sum(((F.col(c) - h[n]) * (F.col(c) - h[n]) for c, n in zip(xy, names)), F.lit(0.0)))
            return F.struct(d.alias("distance"), h["__label"].alias("label"))

        best = F.array_min(F.filter(F.transform("__near", told), lambda h: h["distance"] <= within))
        met = stored(rest.select("*", *[cell(c, size).alias(k) for c, k in zip(xy, on)]).join(near, on, "left").select(key, *xy, best.alias("__b")))
        found.append(met.where("__b is not null").select(key, "__b"))
        rest = met.where("__b is null").select(key, *xy)
    best = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("__b").alias("b"))
    return best.select(key, F.col("b.label").alias(label), F.col("b.distance").alias("distance"))
