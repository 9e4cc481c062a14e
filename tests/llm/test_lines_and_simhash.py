import itertools
import random

import numpy as np
import pytest
import xxhash

from orbitlake.llm.line_dedup import PerfectHash, dedup_lines
from orbitlake.llm.simhash import covering_masks, simhash_groups, table_masks

SCHEMA = "doc_id long, text string, n_lines string, t string"


def brute_lines(rows):
    keyed = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keyed.append([(x, x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})) for x in lines])
    docs = {}
    for r, lines in enumerate(keyed):
        for k in {k for _, k in lines if len(k) >= 40}:
            docs.setdefault(k, []).append(rows[r][0])
    top = {k: max((i for i in v if i is not None), default=None) for k, v in docs.items() if len(v) >= 5}
    return [(rows[r][0], "\n".join(x for x, k in lines if k not in top or top[k] == rows[r][0]), len(lines), sum(k in top and top[k] != rows[r][0] for x, k in lines)) for r, lines in enumerate(keyed)]


def line_rows():
    rnd = random.Random(1)
    hot = ["The same LONG line é that many documents hold, number %d" % i for i in range(6)]
    rows = []
    for i in range(60):
        lines = [rnd.choice(hot) if rnd.random() < 0.3 else "own line %d %s" % (i, "x" * rnd.randint(0, 60)) for _ in range(rnd.randint(1, 8))]
        rows.append((i, "\n".join("  " + x.upper() if rnd.random() < 0.3 else x + "\t" for x in lines), "n", "t"))
    return rows + [(100, None, None, None), (101, "", "", ""), (None, hot[0] + "\n" + hot[1], "x", "y"), (5, hot[2], "n", "t"), (5, hot[2], "n", "t"), (200, "\n".join(["ab " * 30000] * 3), "n", "t")]


@pytest.mark.parametrize("limit", [48_000_000, 0])
def test_lines_match_brute_force_by_broadcast_and_by_shards(spark, limit):
    rows = line_rows()
    out = dedup_lines(spark.createDataFrame(rows, SCHEMA), keep=["doc_id", "n_lines", "t"], broadcast_bytes=limit)
    assert out.columns == ["doc_id", "t", "text", "n_lines", "n_dropped"] or set(out.columns) == {"doc_id", "t", "text", "n_lines", "n_dropped"}
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)


def test_lines_of_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_minimal():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    a[:50] = a[0]  # equal first halves
    assert sorted(PerfectHash(a, b).index(a, b).tolist()) == list(range(5000))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = covering_masks(radius)
    for bits in itertools.combinations(range(0, 64, 1 if radius < 3 else 2), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    assert len(table_masks(9, 2)) == 62


def brute_groups(rows, width=3, radius=2):
    prints = []
    for _, text in rows:
        w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    low = {}
    for c, (i, _) in zip(comp, rows):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    return [(i, prints[r], low[comp[r]]) for r, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("limit", [20_000, 2])
def test_simhash_matches_brute_force(spark, limit):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " \n".join(w) if i % 2 else "\t".join(w).upper()))
    rows += [(900, None), (901, ""), (902, "one Two"), (903, "one two"), (None, "  "), (3, rows[3][1]), (904, "word " * 40000)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=limit)
    got = [(r.id, r.fp0 & (1 << 64) - 1, r.component_id) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute_groups(rows), key=key)


def test_simhash_of_an_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
