"""Toxicity: maximum-scoring segments of token log-odds with Dirichlet priors, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, renamed, slices, spread, stored

#: Bound of the labelled rows that the model is fitted on; its units are at most those of the rows with label 1.
TRAIN_ROWS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (6, 5, 4)
#: Score of a word without a known unit, at most.
REST = -0.05


def units(word: str) -> list[str]:
    """The units of a word, the finest first: the word, then its stems of 6, 5 and 4 letters (marked with a star)."""
    return [word, *[word[:n] + "*" for n in _STEMS if len(word) >= n]]


def _counted(batches):
    for batch in batches:
        total: Counter = Counter()
        clean: Counter = Counter()
        for text, toxic in zip(batch["t"].to_pylist(), batch["toxic"].to_pylist()):
            words = Counter(_WORD.findall((text or "").lower()))
            if not toxic:
                clean.update(words)
            for u in {u for w in words for u in units(w)}:
                total[u, toxic] += 1
        rows = list(total.items())
        times = [clean[k[0]] if k[1] == 0 else 0 for k, _ in rows]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64()), pa.array(times, pa.int64())], ["unit", "toxic", "n", "words"])


def _word_scores(model):
    """Scores of distinct words with the times that clean documents hold them."""

    def rows(batches):
        known = model.value.known
        for batch in batches:
            total: Counter = Counter()
            for w, n in zip(batch["unit"].to_pylist(), batch["words"].to_pylist()):
                total[next((known[u] for u in units(w) if u in known), 0.0)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.int64())], ["score", "words"])

    return rows


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int, strength: float) -> tuple[Column, Column]:
    """Log-odds of document frequencies under a Dirichlet prior in proportion to the whole, and their z values.

    The prior has a part for holding the unit and one for lacking it, so a unit in every document has finite odds, whose
    variance, of all four counts, then says that nothing is known.
    """
    share = (toxic + clean) / float(n_toxic + n_clean + 1)
    a, b = toxic + strength * share, clean + strength * share
    without_a, without_b = n_toxic - toxic + strength * (1 - share), n_clean - clean + strength * (1 - share)
    odds = F.log(a / without_a) - F.log(b / without_b)
    return odds, odds / F.sqrt(1 / a + 1 / b + 1 / without_a + 1 / without_b)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first, past, sum) of all maximal scoring segments, left to right, in linear time.

    Each candidate keeps the running total at its left and right end, and the place of the latest candidate before it
    that starts lower. A new one follows these places, and joins back as long as the one it finds also ends lower.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, j = i, before, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, low, back = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = back
        kept.append((first, i + 1, low, total, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def karlin(scores: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """lambda with sum of weights * exp(lambda * score) = 1, and K as the tilted weight of the scores that open a segment.

    For rare hits, K * words * exp(-lambda * score) is then the expected number of chance segments of that score.
    """
    p = weights / weights.sum()
    if scores.max() <= 0 or (p * scores).sum() >= 0:
        return 1.0, 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(hi * scores)).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * scores)).sum() > 1 else (mid, hi)
    lam = (lo + hi) / 2
    return lam, max(float((p * np.exp(lam * scores))[scores > 0].sum()), 1e-6)


class Model:
    """Scores of units, the background score of other words, extreme-value parameters and the calibration."""

    def __init__(self, known: dict[str, float], rest: float, lam: float, k: float):
        self.known, self.rest, self.lam, self.k, self.slope, self.shift = known, rest, lam, k, 1.0, 0.0

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Significant segments in characters, each with its normalised score, and the number of words."""
        known, events, gap, words = self.known, [], 0, 0
        at: list[tuple[int, int]] = []
        cache: dict[str, float | None] = {}
        for m in _WORD.finditer(text.lower()):
            w = m.group()
            words += 1
            if w in cache:
                s = cache[w]
            else:
                s = cache[w] = next((known[u] for u in units(w) if u in known), None)
            if s is None:
                gap += 1
            else:
                if gap:
                    events.append(gap * self.rest)
                    at.append((-1, -1))
                events.append(s)
                at.append(m.span())
                gap = 0
        size = math.log(max(self.k * words, 1.0))
        found = [(at[a][0], at[b - 1][1], self.lam * s - size) for a, b, s in maximal_segments(events)]
        return found, words

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of the normalised scores of significant segments (p under 0.05), or the best one, and those segments."""
        found, _ = self.segments(text)
        if not found:
            return -5.0, []
        real = [f for f in found if f[2] > 2.97]  # 1 - exp(-exp(-x)) < 0.05
        best = max(f[2] for f in found)
        return max(-5.0, min(60.0, sum(f[2] for f in real) if real else best)), real

    def probability(self, x: float) -> float:
        z = self.slope * x + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _evidence(model):
    def rows(batches):
        for batch in slices(batches):
            x = [model.value.evidence(t or "")[0] for t in batch["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([round(v * 4) for v in x], pa.int64()), batch["toxic"]], ["level", "toxic"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, strength: float = 0.01, least_z: float = 2.0, least_odds: float = 3.0) -> Model:
    """Fit on at most train_rows labelled rows, taken by the hash of their id; counts are made by Spark.

    The prior weighs strength times the training rows, 10 at least. Null labels or ids teach nothing; an id with both
    labels counts as 1. Without both labels the model knows no unit, and every document scores alike and under 0.5.
    """
    spark = docs.sparkSession
    chosen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    chosen = stored(chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("place", spread("id")), "toxic-ids")
    # somewhat more by their place on the scale, so that the last merge sees no more than that
    near = chosen.where(F.col("place") * chosen.count() <= 1.1 * train_rows + 100)
    chosen = stored(near.orderBy("place", "id").limit(train_rows).select("id", "toxic"), "toxic-labels")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    train = texts.join(F.broadcast(chosen), "id").select("t", "toxic")  # at most train_rows rows
    tallies = train.mapInArrow(_counted, "unit string, toxic int, n long, words long").groupBy("unit")
    counts = stored(tallies.agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"), F.sum("words").alias("words")), "toxic-units")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = Model({}, REST, 1.0, 1.0)
    if n1 and n0:
        # only units that lean to label 1 can start a segment; others score as the rest of the words do
        odds, z = log_odds(F.col("a"), F.col("b"), n1, n0, max(10.0, strength * (n1 + n0)))
        lean = counts.where("a >= 2").select("unit", odds.alias("odds"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("odds") > least_odds))
        model.known = {r["unit"]: round(r["odds"], 6) for r in lean.select("unit", "odds").collect()}
    if model.known:
        # how often clean words get each score, from the distinct words and their counts
        hits = counts.where("words > 0").select("unit", "words").mapInArrow(_word_scores(spark.sparkContext.broadcast(model)), "score double, words long")
        table = hits.groupBy("score").agg(F.sum("words").alias("words")).orderBy("score").toPandas()
        points, weights = table["score"].to_numpy(), table["words"].to_numpy(float)
        mean = float((points * weights).sum() / max(weights.sum(), 1.0))
        model.rest = min(REST, -2 * mean)  # chance alone must lower the sum
        points = np.where(points == 0, model.rest, points)
        if not (points > 0).any():  # no clean word hits: as if one had
            points, weights = np.append(points, max(model.known.values())), np.append(weights, 1.0)
        model.lam, model.k = karlin(points, weights)
    base = min(math.log((n1 + 0.5) / (n0 + 1.5)), math.log(1 / 3))
    shared = spark.sparkContext.broadcast(model)
    levels = train.mapInArrow(_evidence(shared), "level long, toxic int").groupBy("level", "toxic").count().collect()
    x = np.array([r["level"] / 4 for r in levels])
    y, w = np.array([r["toxic"] for r in levels], float), np.array([r["count"] for r in levels], float)
    model.slope, model.shift = _logistic(x, y, w) if n1 and n0 else (0.0, base)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one feature, with a weak pull to zero slope, by Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = w * p * (1 - p) + 1e-12
        g = np.array([(w * (y - p) * x).sum() - 0.1 * a, (w * (y - p)).sum() - 0.1 * b])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def _scored(model, names: list[str], spans: bool):
    def rows(batches):
        m = model.value
        for batch in slices(batches):
            score, found = [], []
            for text in batch["t"].to_pylist():
                x, real = m.evidence(text or "")
                score.append(m.probability(x))
                found.append([{"start": a, "end": b, "strength": s} for a, b, s in real])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch["t"], *[batch[c] for c in names], pa.array(score, pa.float64()), pa.array(found, kind)], ["t", *names, "score", "passages"])

    return rows


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (default: all but the text), the text, score (0 to 1) and the toxic passages in characters.

    Null or empty text: the score of no evidence, and no passages. Passages count characters of the lower-cased text.
    Equal texts score alike; texts of any length are scanned whole.
    Null ids and repeated rows each get their row; a carried column named like a result gives way to it.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col]
    base, names = carried(docs, text_col, keep, ["score", "passages"])
    cols = [c for c in base.columns if c != "t"]
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = base.mapInArrow(_scored(shared, cols, True), f"t string, {kinds}score double, passages array<struct<start: long, end: long, strength: double>>")
    return renamed(out.withColumnRenamed("t", "__text"), names).withColumnRenamed("__text", text_col)
