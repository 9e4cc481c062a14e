"""Sequence operators within a track; each is one window over (track, time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def past_features(df: DataFrame, by: str, order: list[str], value: str, rows: int) -> DataFrame:
    """Mean, sample deviation and maximum of the `rows` values strictly before each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumns({f"{value}_mean": F.avg(value).over(w), f"{value}_std": F.stddev_samp(value).over(w), f"{value}_max": F.max(value).over(w)})


def centred_mean(df: DataFrame, by: str, order: list[str], value: str, half: int) -> DataFrame:
    """Mean of the values up to `half` rows to both sides; nulls are left out."""
    return df.withColumn(f"{value}_smooth", F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-half, half)))


def gradient(df: DataFrame, by: str, order: list[str], at: str, value: str) -> DataFrame:
    """Second-order differences per unit of `at`, each side weighted by the step of the other; one-sided at both ends.

    0 for a lone row, null beside rows at the same time.
    """
    w = Window.partitionBy(by).orderBy(*order)
    back, ahead = F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at)
    left = F.when(back > 0, (F.col(value) - F.lag(value).over(w)) / back)
    right = F.when(ahead > 0, (F.lead(value).over(w) - F.col(value)) / ahead)
    inner = (left * ahead + right * back) / (back + ahead)
    rate = F.when(back.isNull() & ahead.isNull(), F.lit(0.0)).when(back.isNull(), right).when(ahead.isNull(), left).otherwise(inner)
    return df.withColumn(f"{value}_rate", rate)


def unwrap(df: DataFrame, by: str, order: list[str], value: str, period: float) -> DataFrame:
    """Add whole periods so that steps between rows stay within half a period."""
    w = Window.partitionBy(by).orderBy(*order)
    jump = F.coalesce(F.rint((F.col(value) - F.lag(value).over(w)) / period), F.lit(0.0))
    return df.withColumn("__jump", jump).withColumn(f"{value}_unwrapped", F.col(value) - period * F.sum("__jump").over(w)).drop("__jump")


def islands(df: DataFrame, by: str, order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """(by, island, n, first, last) of runs of at least `least` rows where the flag holds; first and last by the first order column."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__r", F.row_number().over(w))
    runs = marked.where("__f").withColumn("__i", F.col("__r") - F.row_number().over(w))
    return runs.groupBy(by, "__i").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("n") >= least).drop("__i")


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with `rank` (from 0, by `order` within a group) and `rank_of`, the rows of the group; null keys are a group.

    The table is dealt by ranges of (group, order), so that a group of any size is many tasks. A row's place in its range plus
    the rows of the group in earlier ranges is its rank; only the counts, one row for a group in a range, meet in a window.
    """
    keys = by + order
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__p")
    w = Window.partitionBy(*([f"__k{i}" for i in range(len(by))] or [F.lit(0)]))
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    counts = rows.groupBy(*named, part).agg(F.count("*").alias("__c"), F.min("__id").alias("__lo"))
    counts = counts.withColumns({"__before": F.sum("__c").over(w.orderBy("__p")) - F.col("__c") - F.col("__lo"), "rank_of": F.sum("__c").over(w)}).drop("__c", "__lo")
    on = part.eqNullSafe(counts["__p"])
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(counts[f"__k{i}"])
    return rows.join(counts, on).select(*[rows[c] for c in df.columns], (F.col("__id") + F.col("__before")).alias("rank"), "rank_of")


def count_windows(df: DataFrame, by: list[str], order: list[str], size: int, stride: int) -> DataFrame:
    """Rows with the numbers of the full windows of `size` rows, one every `stride`, that hold them."""
    r = F.col("rank")
    first = F.greatest(F.lit(0), F.ceil((r - size + 1) / stride)).cast("int")
    last = F.least(F.floor(r / stride), F.floor((F.col("rank_of") - size) / stride)).cast("int")
    return ranked(df, by, order).where((F.col("rank_of") >= size) & (last >= first)).withColumn("window", F.explode(F.sequence(first, last))).drop("rank", "rank_of")


def jumps(df: DataFrame, by: list[str], order: list[str], value: str, limit: float | Column) -> DataFrame:
    """Flag rows that differ from the one before by more than the limit; the first row never is."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    return df.withColumn("jump", F.coalesce(step > limit, F.lit(False)))


def fill_linear(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Nulls filled on the line between the last and next value; at the ends with the nearest one."""
    w = Window.partitionBy(by).orderBy(at)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    p, n = F.last(known, True).over(back), F.last(known, True).over(ahead)
    out = df.withColumns({"__p": p, "__n": n})
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col(at) - F.col("__p.t")) / (F.col("__n.t") - F.col("__p.t"))
    filled = F.coalesce(F.col(value), F.when(F.col("__n.t") > F.col("__p.t"), line), F.col("__p.v"), F.col("__n.v"))
    return out.withColumn(f"{value}_filled", filled).drop("__p", "__n")
