"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, and the characters each match (assign: its value) must have at least.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "random"]

#: Characters of the models, at places from 1. Others (place 0) end a chain: steps from or to them are not counted.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
RUN = "[A-Za-z0-9+/_=-]"
#: Shortest strings that are learned from and scored.
LEARN_LEAST, SCORE_LEAST = 8, 20
#: Documents that the labelled strings are taken from, in the mean.
TRAIN_ROWS = 100_000
#: Log-likelihood ratio that tells a secret, in thousandths of a nat: in all, and for each pair of characters.
LEAST_RATIO, LEAST_MEAN = 15_000, 1_000
#: Part of the random model that is learned; the rest is even over the alphabet. Weight of its even prior.
LEARNED, RANDOM_PRIOR = 0.5, 16.0
#: Weight of the prior of ordinary strings, in proportion to single characters: that many steps from a character, so that the
#: few secrets among ordinary strings do not teach the steps from characters that are rare there.
ORDINARY_PRIOR = 1000.0


def match_spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value), in code points, end exclusive.

    Lengths of matches and of what lies between them are summed in blocks of about the root of their number, so that a
    text of k matches takes k to the power 1.5 steps at most.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group) if value_group else found
    gaps = F.split(text, pattern, -1)
    step = "struct<gap:int,size:int,value:string>"
    span = "struct<start:int,end:int,value:string>"
    steps = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["found"]), F.lit(0)).alias("size"), x["value"].alias("value")).cast(step),
    )

    def placed(steps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.slice(steps, j * width + 1, width))
        starts = F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"])),
        )
        spans = F.transform(
            blocks,
            lambda b, j: F.aggregate(
                b,
                F.struct(F.get(starts, j).alias("at"), F.array().cast(f"array<{span}>").alias("all")),
                lambda acc, x: F.struct(
                    (acc["at"] + x["gap"] + x["size"]).alias("at"),
                    F.array_append(acc["all"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")).cast(span)).alias("all"),
                ),
                lambda acc: acc["all"],
            ),
        )
        return F.filter(F.flatten(spans), lambda x: x["value"].isNotNull())

    # the array of steps is bound once as the only element of an array
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(steps), placed), F.lit(0))).otherwise(F.array().cast(f"array<{span}>"))


def base_spans(text: Column) -> list[Column]:
    """Spans of the kinds assign, access and hex; short ones are dropped after matching."""
    long_enough = F.filter(match_spans(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return [long_enough, match_spans(text, ACCESS), match_spans(text, HEX)]


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(value, label): distinct strings from about train_rows documents, taken by the sha256 of their id.

    Label 1: what the base patterns match (of an assignment its value), of 8 characters or more; label 0: other runs of
    the alphabet with 8 or more, up to 64 characters of each. Strings count once however often they occur; one with
    both labels is 1. Null ids and texts teach nothing.
    """
    known = docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t")).where("i is not null and t is not null")
    n = known.count()
    place = F.conv(F.substring(F.sha2("i", 256), 1, 8), 16, 10).cast("long")
    chosen = known.where(place * n < (train_rows << 32)) if n > train_rows else known
    secrets = F.concat(*[F.transform(s, lambda x: x["value"]) for s in base_spans(F.col("t"))])
    rest = F.col("t")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(f"{RUN}{{{LEARN_LEAST},64}}"), 0)
    both = F.concat(
        F.transform(secrets, lambda v: F.struct(v.alias("value"), F.lit(1).alias("label"))),
        F.transform(F.array_distinct(ordinary), lambda v: F.struct(v.alias("value"), F.lit(0).alias("label"))),
    )
    return chosen.select(F.explode(both).alias("x")).where(F.length("x.value") >= LEARN_LEAST).groupBy("x.value").agg(F.max("x.label").alias("label"))


def _places(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pair_counts(samples: DataFrame, value_col: str = "value", label_col: str = "label") -> DataFrame:
    """(label, pair, n): how often each pair of places, none of them 0, follows in the strings of a label."""
    size = len(ALPHABET) + 1
    places = samples.where(samples[value_col].isNotNull() & samples[label_col].isin(0, 1)).select(samples[label_col].alias("label"), _places(samples[value_col]).alias("p"))
    step = lambda c, i: F.when((F.get(F.col("p"), i) > 0) & (c > 0), F.get(F.col("p"), i) * size + c)
    pairs = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), step)
    return places.select("label", F.explode(pairs).alias("pair")).where("pair is not null").groupBy("label", "pair").agg(F.count("*").alias("n"))


def fit(samples: DataFrame, value_col: str = "value", label_col: str = "label") -> list[int]:
    """Log-likelihood ratios of random against ordinary strings for each pair of places, in whole thousandths of a nat.

    Pairs are first-order Markov steps. The random model is half learned from label 1, with the even distribution as
    its other half, as secrets may be of any alphabet; the ordinary one is learned from label 0 and falls back on how often
    single characters follow there.
    Counts are made by Spark; the table has one number for each pair of the alphabet's places.
    """
    size, places = len(ALPHABET) + 1, range(1, len(ALPHABET) + 1)
    counts = {(r["label"], r["pair"]): r["n"] for r in pair_counts(samples, value_col, label_col).collect()}  # two numbers a pair of places at most
    table, even = [0] * size * size, 1 / len(places)
    single = {b: sum(counts.get((0, a * size + b), 0) for a in places) for b in places}
    share = {b: (single[b] + 1) / (sum(single.values()) + len(places)) for b in places}
    for a in places:
        seen = [sum(counts.get((label, a * size + b), 0) for b in places) for label in (0, 1)]
        for b in places:
            ordinary = (counts.get((0, a * size + b), 0) + ORDINARY_PRIOR * share[b]) / (seen[0] + ORDINARY_PRIOR)
            learned = (counts.get((1, a * size + b), 0) + RANDOM_PRIOR * even) / (seen[1] + RANDOM_PRIOR)
            table[a * size + b] = math.floor(1000 * math.log((LEARNED * learned + (1 - LEARNED) * even) / ordinary) + 0.5)
    return table


def ratio(value: Column, table: list[int]) -> Column:
    """Sum of the table over the pairs of a string, in thousandths of a nat; 0 for strings under two characters."""
    size = len(ALPHABET) + 1
    weights = F.from_json(F.lit(json.dumps(table)), "array<int>")  # folded to one literal
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        _places(value),
        start,
        lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(weights, acc["last"] * size + c)).cast("long").alias("sum")),
        lambda acc: acc["sum"],
    )


def scan(docs: DataFrame, table: list[int], text_col: str = "text", least_ratio: int = LEAST_RATIO, least_mean: int = LEAST_MEAN) -> DataFrame:
    """All columns, and secrets: array of (kind, start, end) by start and then kind, in code points, end exclusive.

    Kinds assign, access and hex are the base patterns' matches. Kind random is a run of 20 or more characters of the
    alphabet, not within a base span, whose log-likelihood ratio reaches least_ratio in all and least_mean a pair.
    Whole texts, row by row, without a shuffle. Null text is the empty one and has none. Null ids and repeated rows keep
    their rows; a column named like the result gives way to it. No rows give no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(*[docs[c] for c in docs.columns if c != "secrets"], *[s.alias(f"__{k}") for k, s in zip(KINDS, base_spans(text))], match_spans(text, f"{RUN}{{{SCORE_LEAST},}}").alias("__runs"))
    fixed = F.concat(F.col("__assign"), F.col("__access"), F.col("__hex"))
    outside = F.filter("__runs", lambda r: ~F.exists(fixed, lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    scored = F.transform(outside, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), ratio(r["value"], table).alias("ratio")))
    told = F.filter(scored, lambda r: (r["ratio"] >= least_ratio) & (r["ratio"] >= least_mean * (r["end"] - r["start"] - 1)))
    out = base.withColumn("__random", told)
    placed = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), x["end"].alias("end"))
    order = [F.transform(f"__{k}", placed(i)) for i, k in enumerate(KINDS)]
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform(F.sort_array(F.concat(*order)), lambda x: F.struct(F.get(names, x["place"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.withColumn("secrets", listed).drop(*[f"__{k}" for k in KINDS], "__runs")
