"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACE = " \t\n\x0b\x0c\r"
#: Values over which each rule rejects, one for each level from loose to strict. Values are whole thousandths.
RULES = {
    "symbols": [2000, 1500, 1000, 700, 500, 300, 200, 150, 100, 70, 50],
    "dup_lines": [900, 700, 500, 400, 300, 250, 200, 170, 150, 120, 100],
    "repeat_words": [180, 160, 140, 120, 100, 80, 60, 50, 40, 30, 20],
    "long_words": [20000, 18000, 16000, 14000, 12000, 11000, 10000, 9500, 9000, 8500, 8000],
    "short_words": [800, 700, 600, 550, 500, 450, 400, 350, 300, 275, 250],
}
#: Good documents that all rules together may reject in each stratum, and the chance that any stratum exceeds it.
ALPHA, DELTA = 0.05, 0.05


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); n_lines with a word as well.

    Words are runs of other than ASCII white space. Everything is made within a row: no shuffle. Null or empty text: 0
    in all. Columns of these names are replaced.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    out = docs.drop(*[c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_used") if c in docs.columns])
    flat = F.translate(text, SPACE, " " * len(SPACE))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    out = out.select(
        "*",
        words.alias("__words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    out = out.select(
        "*",
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines_used"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # one number for each word, so that windows are made of numbers
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    ).drop("__words", "__lines")
    at = lambda i, k: F.get(F.col("__hashes"), i + F.lit(k))
    starts = F.when(F.col("n_words") >= 5, F.sequence(F.lit(0), F.col("n_words").cast("int") - 5)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__windows", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))).drop("__hashes")
    # texts without a repeated window are done; for the others windows are sorted with their places
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(again, F.sort_array(F.transform("__windows", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    out = out.withColumn("__placed", placed).drop("__windows")
    gram = lambda j: F.get(F.col("__placed"), j)["g"]
    doubled = F.filter("__placed", lambda p, j: (p["g"] == gram(j - 1)) | (p["g"] == gram(j + 1)))
    out = out.withColumn("__at", F.sort_array(F.transform(doubled, lambda p: p["i"]))).drop("__placed")
    gaps = F.aggregate(
        "__at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long")).drop("__at")


def _values() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    whole = lambda a, b: F.floor(F.lit(1000) * a / b).cast("long")
    return {
        "symbols": whole(F.col("n_symbols"), words),
        "dup_lines": whole(F.col("n_dup_lines"), F.greatest("n_lines_used", F.lit(1))),
        "repeat_words": whole(F.col("n_repeat_words"), words),
        "long_words": whole(F.col("word_chars"), words),
        "short_words": whole(F.col("n_words"), chars),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, by summing terms in logs; 1 where k is over n * p (never of use here)."""
    first = n * F.lit(math.log1p(-p))
    step = math.log(p) - math.log1p(-p)
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(F.exp(first).alias("sum"), first.alias("log")),
        lambda acc, i: F.struct((acc["sum"] + F.exp(acc["log"] + F.log(n - i + 1) - F.log(i) + step)).alias("sum"), (acc["log"] + F.log(n - i + 1) - F.log(i) + step).alias("log")),
        lambda acc: acc["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(total)


def least_good(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The fewest good labels with which no rejection at all is proof enough, with that many strata and their pool tested."""
    return math.ceil(math.log(delta / (strata + 1)) / math.log1p(-alpha))


def _first_rejecting(rules: dict[str, list[int]]) -> Column:
    """The loosest level at which a rule rejects the row, from 1; one past the last level if none does."""
    values, depth = _values(), len(next(iter(rules.values())))
    passed = [F.when(reduce(lambda a, b: a & b, [values[r] <= cuts[j] for r, cuts in rules.items()]), 1).otherwise(0) for j in range(depth)]
    return F.lit(1) + sum(passed, F.lit(0))


def levels(counted: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, label_col: str, rules: dict[str, list[int]] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, tested_with, good, level): the strictest level for each stratum that is shown to reject few good documents.

    Labelled good documents (label 1) are the holdout. Levels are tested from loose to strict, all rules of a level
    together: one passes if, should its chance of a false rejection be alpha or more, so few rejections would come with
    probability delta / (strata + 1) at most (exact binomial; Bonferroni over strata and their pool, fixed order within).
    So with chance 1 - delta no stratum that is tested alone loses alpha of its good documents. Strata with fewer good
    labels than least_good() can't pass alone and are tested together (tested_with ''), the bound then holding for them
    together. A level of null: nothing passed. Strata without good labels have no row.
    """
    good = labels.where(labels[label_col] == 1).select(labels[id_col].alias("__id")).where("__id is not null").distinct()
    of = counted.select(counted[id_col].alias("__id"), counted[stratum_col].alias("stratum"), _first_rejecting(rules).alias("first"))
    held = stored(of.join(good, "__id").groupBy("stratum", "first").agg(F.count("*").alias("n")), "quality-levels")
    sizes = held.groupBy("stratum").agg(F.sum("n").alias("own"))
    strata = sizes.count()
    with_ = F.when(F.col("own") >= least_good(strata, alpha, delta), F.concat(F.lit("="), "stratum")).otherwise(F.lit(""))
    named = sizes.withColumn("tested_with", with_)
    tests = held.join(named, "stratum").groupBy("tested_with", "first").agg(F.sum("n").alias("n"))
    steps = tests.groupBy("tested_with").agg(F.sum("n").alias("all")).withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(len(next(iter(rules.values())))))))
    run = Window.partitionBy("tested_with").orderBy("first")
    bounds = steps.join(tests, ["tested_with", "first"], "left").withColumn("rejected", F.sum(F.coalesce("n", F.lit(0))).over(run))
    fine = binomial_tail(F.col("all"), F.col("rejected"), alpha) <= delta / (strata + 1)
    passed = bounds.groupBy("tested_with").agg(F.first("all").alias("good"), F.max(F.when(fine, F.col("first"))).alias("level"))
    return stored(named.join(passed, "tested_with").select("stratum", "tested_with", "good", "level"), "quality-cutoffs")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", rules: dict[str, list[int]] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The id, the counts of word_counts(), base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. kept is false for those,
    and for documents that a rule rejects at the level found for their stratum by levels(); a stratum without a level
    (too few labels, or too many false rejections) loses none but by the base. Null and empty texts fail the base. Null
    strata are a stratum of their own, as ''; null ids keep their row but can't be labelled. Repeated rows each get
    their row, and each counts where labelled; ties of values share a level. Other columns are not read. No rows: no rows.
    """
    narrow = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("__stratum"))
    counted = stored(word_counts(narrow, "__text").drop("__text"), "quality-counts")
    table = levels(counted, labels.select(labels[id_col].alias("__id"), labels[label_col].alias("__label")), "__id", "__stratum", "__label", rules, alpha, delta)
    own = table.where("level is not null").select(F.col("stratum").alias("__stratum"), "level")
    if own.count() <= 10_000:  # a row for each stratum
        own = F.broadcast(own)
    named = counted.join(own, "__stratum", "left")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    over = F.coalesce(_first_rejecting(rules) <= F.col("level"), F.lit(False))
    return named.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~over).alias("kept"))
