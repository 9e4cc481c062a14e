import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbitlake.llm import fill_middle, lexical_search, secrets
from orbitlake.llm.queries import op13_secret_scans


def cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 20:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(3)
    made = ["".join(r.choice(["ab", "Zz", " ", "\n", "é", "𝒳", "<", "P>", "<S", ">", "\0", "7", "\U0001f600"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return [None, "", "a", "<P>", "x<M>y", "<", "<P", *made, "word " * 40_000, "é" * 70_000]


def test_middles_match_a_plain_version_and_come_back(spark):
    rows = [(i if i != 9 else None, t, "kept", 5) for i, t in enumerate(odd_texts())]
    rows.append(rows[20])
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, n int").repartition(5)
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back, r.extra) for r in out)
    assert got == Counter((i, t, *cut(i, t), t or "", "kept") for i, t, _, _ in rows)
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_damaged_outputs_are_not_restored(spark):
    df = spark.createDataFrame([("<P>a<S>b", "psm"), ("a<P>b<S>c<M>d", "psm"), ("<P>a<S>b<M>c", "spm"), (None, "plain")], "o string, f string")
    assert [r[0] for r in df.select(fill_middle.restored(F.col("o"), F.col("f"))).collect()] == [None] * 4


def plain_search(docs, items, k):
    held = [(i, Counter(lexical_search.terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_all = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(held, sizes):
            m = n and 10 + (90 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(lexical_search.terms_of(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def search_rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "ÉTÉ", "été", "日本", "a_b", "x-y", "K"]
    docs = [(i * 3 - 50, " ".join(r.choice(words[: r.randint(2, 67)]) for _ in range(r.randint(0, 30)))) for i in range(700)]
    docs += [(9000 + i, docs[5][1]) for i in range(400)] + [(9100, docs[5][1]), (None, docs[5][1]), (77, None), (78, ""), (79, "w1 " * 5000), (80, " ".join(f"z{i}" for i in range(9000)))]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for i in range(30)]
    return docs, [*items, (3, "w1 w2"), (40, None), (41, ""), (42, "unknown"), (43, docs[5][1]), (44, "Z1 z2, z8999!"), (45, "W1;w1")]


@pytest.mark.parametrize("tree, postings, chars", [(8192, 1 << 20, 200_000), (64, 150, 300)])
def test_search_matches_a_plain_ranking(spark, monkeypatch, tree, postings, chars):
    monkeypatch.setattr(lexical_search, "TREE", tree)
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    docs, items = search_rows()
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, rank string, score double").repartition(3)
    got = lexical_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), pass_chars=chars).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_search(docs, items, 10), key=str)


def test_trees_are_the_same_at_any_size_and_close_most_leaves():
    import numpy as np

    r = np.random.default_rng(4)
    ids = r.permutation(3000).astype(np.int64)
    docs = np.repeat(np.arange(3000), 6)
    terms = np.concatenate([r.choice(50, 6, replace=False) for _ in range(3000)])
    gains = r.integers(1, 40, len(docs)) + np.where(ids[docs] < 30, 1000, 0)
    tree = lexical_search.RangeTree(ids, docs, terms, gains, 50)
    wanted = np.array([3, 9, 20])
    member = np.isin(np.arange(50), wanted)
    best = []
    opened = []
    whole = lexical_search.np.bincount
    try:
        lexical_search.np.bincount = lambda *a, **b: opened.append(1) or whole(*a, **b)
        tree.search(wanted, member, best, 5)
    finally:
        lexical_search.np.bincount = whole
    plain = Counter()
    for d, t, g in zip(docs, terms, gains):
        if t in (3, 9, 20):
            plain[int(ids[d])] += int(g)
    assert sorted(best, reverse=True) == sorted(((s, -i) for i, s in plain.items()), reverse=True)[:5]
    assert len(opened) < 20


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(docs, items).collect() == []
    assert lexical_search.ranked_search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).collect() == []
    assert lexical_search.ranked_search(spark.createDataFrame([(1, None), (2, "  ")], docs.schema), items).collect() == []


def plain_spans(text):
    out = []
    kinds = [("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for k, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    return [(kind, s, e) for s, k, kind, e in sorted(out)]


def secret_texts():
    r = random.Random(6)
    bits = ["token", "Api_Key", "APIKEY", "PassWord", "secret", "=", ":", " ", "  ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "deadbeef", "é", "𝒳", "\n", "-", "zebra", "Kite", "ſecret", "toKen"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [None, "", *texts, "token = " * 3000 + "0123456789abcdef " * 5000, "a" * 100_000, 'token=secret=abcdefghijklmnop', "AKIAAKIA" + "B" * 30]


def test_base_spans_match_plain_patterns(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i if i != 4 else None, t, "s", 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, secrets string, start int").repartition(4)
    none = [0] * (len(secrets.ALPHABET) + 1) ** 2
    got = Counter((r.text, tuple(map(tuple, r.secrets)), r.start) for r in secrets.scan(df, none).collect())
    assert got == Counter((t, tuple(plain_spans(t or "")), 1) for t in texts * 2)
    assert secrets.scan(df.limit(0), none).count() == 0


def chain_ratio(table, value):
    places = [secrets.ALPHABET.find(c) + 1 for c in value]
    return sum(table[a * (len(secrets.ALPHABET) + 1) + b] for a, b in zip(places, places[1:]) if a and b)


def test_models_tell_random_strings_from_ordinary_ones(spark):
    r = random.Random(2)
    parts = "get set user name value count index buffer token parse read write open close list map node tree cache time zone file path line word load save find next last".split()
    ordinary = lambda: "".join(p.title() if r.random() < 0.5 else p for p in r.sample(parts, r.randint(4, 6)))
    letters = secrets.ALPHABET
    noise = lambda n=32: "".join(r.choice(letters) for _ in range(n))
    samples = spark.createDataFrame([(noise(), 1) for _ in range(200)] + [(ordinary(), 0) for _ in range(2000)] + [(None, 1), ("", 0), ("x", 1), ("ab", None)], "value string, label int")
    table = secrets.fit(samples)
    held = [(noise(), 1) for _ in range(300)] + [(ordinary(), 0) for _ in range(300)]
    rows = spark.createDataFrame([(i, f"see {v} , é") for i, (v, _) in enumerate(held)], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.secrets if s.kind == "random"] for x in secrets.scan(rows, table).collect()}
    found = [got[i] == [("random", 4, 4 + len(v))] for i, (v, y) in enumerate(held) if y]
    wrong = [bool(got[i]) for i, (v, y) in enumerate(held) if not y]
    assert sum(found) >= 295 and sum(wrong) <= 3
    scored = spark.createDataFrame([(v,) for v, _ in held[::40]] + [("",), ("a",), ("--__--",)], "v string").select("v", secrets.ratio(F.col("v"), table)).collect()
    assert all(s == chain_ratio(table, v) for v, s in scored)


def test_counts_of_pairs_and_log_ratios(spark):
    samples = spark.createDataFrame([("abab", 0), ("a-b", 0), ("zz9", 1)], "value string, label int")
    size = len(secrets.ALPHABET) + 1
    at = lambda x: secrets.ALPHABET.index(x) + 1
    got = {(r.label, divmod(r.pair, size)): r.n for r in secrets.pair_counts(samples).collect()}
    assert got == {(0, (at("a"), at("b"))): 2, (0, (at("b"), at("a"))): 1, (1, (at("z"), at("z"))): 1, (1, (at("z"), at("9"))): 1}
    even = 1 / len(secrets.ALPHABET)
    want = math.log((0.5 * even + 0.5 * even) / ((2 + 1000 * (2 + 1) / (3 + len(secrets.ALPHABET))) / (2 + 1000)))
    assert abs(secrets.fit(samples)[at("a") * size + at("b")] - 1000 * want) < 1
    assert set(secrets.fit(samples.limit(0))) == {0}


def test_labels_come_from_the_base_patterns_once_each(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh.ijkl ordinaryword 0123456789abcdef ordinaryword"), (2, "ordinaryword abcdefgh"), (None, "skippedword"), (3, None)], "doc_id long, text string")
    got = {tuple(r) for r in secrets.labelled_strings(docs).collect()}
    assert got == {("abcdefgh.ijkl", 1), ("0123456789abcdef", 1), ("ordinaryword", 0), ("abcdefgh", 0)}


def test_all_spans_hold_the_base_ones(spark, tmp_path):
    r = random.Random(1)
    # some thousand ordinary words tell what is ordinary
    word = lambda: "".join(r.choice(["al", "pha", "be", "ta", "gam", "ma", "del", "ep", "si", "lon", "ter", "min"]) for _ in range(r.randint(2, 5)))
    docs = [(i, " ".join(word() for _ in range(150)) + (" Xk9fQ2LmZp7RtVw3YbNc4HdJs8Ge" if i == 5 else "")) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x.spans for x in op13_secret_scans(spark, str(tmp_path)).collect()}
    at = docs[5][1].index("Xk9")
    assert rows[5] == f"random:{at}:{at + 28}" and not any(v for i, v in rows.items() if i != 5)
