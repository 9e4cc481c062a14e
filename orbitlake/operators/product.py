"""Model of the fix rate: classifiers of transitions, a corrector of the base prediction, a calibrator and guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import finite
from . import sequences, trees


@dataclass
class Product:
    classifiers: dict[str, trees.Model]
    corrector: trees.Model
    calibrator: IsotonicRegressionModel | None
    base: str
    by: list[str]
    order: list[str]
    alpha: float
    clip: float


def logit(p: Column) -> Column:
    """Log odds of a rate, which is kept 1e-6 away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return F.log(q / (1.0 - q))


def with_place(df: DataFrame, by: list[str], order: list[str], planned: str | None = None) -> DataFrame:
    """`run_pos`, `run_fraction`, `run_remaining` and `run_windows` of each window in its run.

    The run's length is that of the table, or with `planned` the column's, so that a run can be scored while it goes on;
    a run without a positive planned length has nulls.
    """
    w = Window.partitionBy(*by)
    pos = (F.row_number().over(w.orderBy(*order)) - 1).cast("double")
    n = F.count("*").over(w) if planned is None else F.when(F.col(planned) > 0, F.col(planned))
    out = df.withColumns({"run_pos": pos, "run_windows": n.cast("double")})
    steps = F.greatest(F.col("run_windows") - 1, F.lit(1.0))
    left = F.greatest(F.col("run_windows") - 1 - F.col("run_pos"), F.lit(0.0))
    known = F.col("run_windows").isNotNull()
    return out.withColumns({"run_fraction": F.when(known, F.col("run_pos") / steps), "run_remaining": F.when(known, left / steps)})


def _meta(df: DataFrame, names: list[str], base: str, by: list[str], order: list[str]) -> tuple[DataFrame, list[str]]:
    """The base, its log odds, and each probability with its past, as the corrector's inputs."""
    out, inputs = df.withColumn("__logit", logit(F.col(base))), [base, "__logit"]
    for n in names:
        out = sequences.past_probabilities(out, by, order, n)
        inputs += [n, f"{n}_prev", f"{n}_delta_prev", f"{n}_past_mean"]
    return out, inputs


def _corrected(residual: Column, base: str, alpha: float, clip: float) -> Column:
    step = F.least(F.greatest(residual, F.lit(-clip)), F.lit(clip))
    return F.least(F.greatest(F.col(base) + alpha * step, F.lit(0.0)), F.lit(1.0))


def fit(
    df: DataFrame, features: list[str], targets: dict[str, Column], base: str, actual: str, weight: str, by: list[str], order: list[str],
    fold: str, folds: int, alpha: float = 0.75, clip: float = 0.5, calibrated: bool = False, **options,
) -> Product:
    """Fit over windows with a base prediction and an actual rate, both 0 to 1.

    The corrector learns from probabilities of models that did not see the window's fold, and so does the calibrator from
    corrected rates; otherwise both would trust the classifiers as far as they remember their own rows.
    """
    classifiers, rows = {}, df
    for name, holds in targets.items():
        labelled = df.withColumn("__label", F.coalesce(holds, F.lit(False)).cast("int"))
        classifiers[name] = trees.fit(labelled, features, "__label", weight, fold, folds, **options)
        rows = trees.predict(rows, classifiers[name], name, fold)
    rows, inputs = _meta(rows, list(targets), base, by, order)
    rows = rows.withColumn("__miss", F.col(actual) - F.col(base))
    corrector = trees.fit(rows, inputs, "__miss", weight, fold, folds, loss="squared", **options)
    calibrator = None
    if calibrated:
        scored = trees.predict(rows, corrector, "__residual", fold).withColumn("__rate", _corrected(F.col("__residual"), base, alpha, clip))
        fine = scored.where(finite(F.col("__rate")) & finite(F.col(actual)) & finite(F.col(weight)) & (F.col(weight) > 0))
        data = VectorAssembler(inputCols=["__rate"], outputCol="__x").transform(fine.select("__rate", F.col(actual).alias("__y"), F.col(weight).cast("double").alias("__w")))
        calibrator = IsotonicRegression(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p").fit(data)
    return Product(classifiers, corrector, calibrator, base, by, order, alpha, clip)


def guarded(rate: Column, guards: list[dict]) -> Column:
    """Caps and floors, in turn, where a finite feature is on the guard's side of its threshold.

    A guard is {feature, operator (">=" or "<="), threshold, cap and/or floor}; the result is kept within 0 and 1.
    """
    for g in guards:
        if g["operator"] not in (">=", "<="):
            raise ValueError(f"unknown operator of a guard: {g['operator']}")
        x = F.col(g["feature"]).cast("double")
        on = finite(x) & ((x >= g["threshold"]) if g["operator"] == ">=" else (x <= g["threshold"]))
        for bound, pick in (("cap", F.least), ("floor", F.greatest)):
            if bound in g:
                if not 0 <= g[bound] <= 1:
                    raise ValueError(f"{bound} of a guard must be within 0 and 1")
                rate = F.when(on, pick(rate, F.lit(float(g[bound])))).otherwise(rate)
    return F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))


def predict(df: DataFrame, model: Product, guards: list[dict] = (), blend: float = 1.0, fold: str | None = None) -> DataFrame:
    """The table with a probability a target, `residual` and `rate`; with `fold`, from models that did not see the row's fold."""
    rows = df
    for name, m in model.classifiers.items():
        rows = trees.predict(rows, m, name, fold)
    rows, _ = _meta(rows, list(model.classifiers), model.base, model.by, model.order)
    rows = trees.predict(rows, model.corrector, "residual", fold).withColumn("rate", _corrected(F.col("residual"), model.base, model.alpha, model.clip))
    if model.calibrator is not None:
        # a step function on the driver's side is small: as many points as the calibrator has blocks
        x, y = model.calibrator.boundaries.toArray().tolist(), model.calibrator.predictions.toArray().tolist()
        rows = rows.withColumn("rate", (1.0 - blend) * F.col("rate") + blend * _stepped(F.col("rate"), x, y))
    own = [*df.columns, *model.classifiers, "residual"]
    return rows.select(*own, guarded(F.col("rate"), list(guards)).alias("rate"))


def _stepped(at: Column, x: list[float], y: list[float]) -> Column:
    """Straight lines between the points (x ascending, y not falling), level beyond both ends."""
    points = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in zip(x, y)])
    below, above = F.filter(points, lambda p: p.x <= at), F.filter(points, lambda p: p.x > at)
    a, b = F.element_at(below, -1), F.get(above, F.lit(0))
    return F.when(F.size(below) == 0, F.lit(y[0])).when(F.size(above) == 0, F.lit(y[-1])).otherwise(a.y + (b.y - a.y) * (at - a.x) / (b.x - a.x))
