import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import shingle_join
from orbitlake.llm.common import marked, together
from orbitlake.llm.shingle_join import similar_groups

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    low = {}
    for c, (i, _) in zip(comp, rows):
        low[c] = min(low.get(c, i), i)
    return sorted((i, low[c]) for c, (i, _) in zip(comp, rows))


def copies(seed, words, changes):
    """Pairs of a text and a copy of it with so many words changed."""
    rnd, rows = random.Random(seed), []
    for i, n in enumerate(changes):
        w = [rnd.choice("abcdefghij") * rnd.randint(1, 9) + str(rnd.randrange(500)) for _ in range(words)]
        rows.append((2 * i, " ".join(w)))
        for at in rnd.sample(range(2, words, 7), n):
            w[at] = f"new{rnd.random()}"
        rows.append((2 * i + 1, " ".join(w).upper()))
    return rows


def test_pipeline_joins_every_pair_at_or_over_the_similarity(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    # 200 words, 196 shingles: four changes leave about 0.82, three 0.86, two 0.9, five 0.77
    rows = copies(1, 200, [4] * 40 + [3] * 30 + [2] * 20 + [5] * 30)
    want = {i for i, low in brute(rows) if i == low}
    assert 120 < len(want) < 240 and len([i for i in range(0, 240, 2) if i + 1 not in want]) >= 90
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("sample, least", [(16, 4), (1, 2)])
def test_groups_match_brute_force(spark, sample, least):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in copies(2, 60, [0, 1, 1, 2] * 10)]
    base = [t for _, t in rows[:6]]
    for i in range(100, 180):  # dense groups: copies of copies, cut and extended
        w = rnd.choice(base).split()
        w[rnd.randrange(len(w))] = rnd.choice(["zz", "yy", f"x{i}"])
        rows.append((i, " ".join(w[rnd.randint(0, 4) :] + ["end"] * rnd.randint(0, 5))))
    rows += [(900, None), (901, ""), (902, "one Two"), (903, "one two"), (904, " \n"), (3, rows[3][1]), (905, "word " * 40000), (906, "a b c d e f"), (907, "a b c d e")]
    got = similar_groups(spark.createDataFrame(rows, SCHEMA), sample=sample, least=least)
    assert sorted((r.id, r.component_id) for r in got.collect()) == brute(rows)


def test_groups_of_an_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_stay_together_behind_a_split_join(spark):
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    was = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("x"))
        met = rows.join(spark.range(50).select(F.col("id").alias("g"), F.rand().alias("y")), "g")
        dealt = met.repartition(n, together("g")).sortWithinPartitions("g").mapInArrow(lambda batches: batches, met.schema)
        tasks = dealt.select("g", F.spark_partition_id().alias("p")).distinct()
        assert tasks.count() == 25
    finally:
        for k, v in was.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_wide_parity_words_bound_the_difference_and_tell_large_unlike_sets():
    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (500, 600), (3000, 2600), (4096, 4097), (9000, 7300)):
        both = np.unique(rng.integers(-(1 << 62), 1 << 62, n + m))
        for share in (0.0, 0.5, 0.95):
            k = int(min(n, m) * share)
            a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:k], both[n : n + m - k]]))
            least = shingle_join.least_difference(shingle_join.wide_parity(a), shingle_join.wide_parity(b))
            assert least <= len(np.setxor1d(a, b))
            if n > 1 and share < 0.6:
                assert least * 9 > len(a) + len(b)


def test_texts_of_unlike_large_pairs_do_not_travel(spark, monkeypatch):
    rng, ends, real = random.Random(12), {}, shingle_join.stored

    def spy(df, name):
        out = real(df, name)
        if name.endswith("-ends"):
            ends[name] = out.count()
        return out

    monkeypatch.setattr(shingle_join, "stored", spy)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    common = [word() for _ in range(900)]
    rows = [(i, " ".join(common + [word() for _ in range(2100)])) for i in range(6)]
    rows += [(9, rows[0][1] + " more")]
    got = {r["id"]: r["component_id"] for r in shingle_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(6)}, 9: 0}
    assert sum(ends.values()) == 2


def test_a_bitmap_marks_every_key_that_is_held_and_few_others(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 7).alias("key"))
    held = rows.where("id % 10 = 3")
    out = marked(rows, held, ["id", "key"], "may").where("may").toPandas()
    assert set(range(3, 3000, 10)) <= set(out["id"]) and len(out) < 330
    assert marked(rows, held.where("false"), ["id", "key"], "may").where("may").count() == 0
