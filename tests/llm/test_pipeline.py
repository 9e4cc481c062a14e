"""The whole pipeline against a brute-force version of its stages, and the columns it carries."""

import collections
import random

import pytest

from orbitlake.llm import packing, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, n_chars long, score string, n_lines string, kept string, n_bytes string"


def corpus(n=260):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    common = " ".join(word() for _ in range(12))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(12)) for _ in range(r.randint(2, 8))]
        if i % 6 == 0:
            lines.insert(1, common)
        if i % 9 == 0:
            lines.append(passage)
        if i % 8 == 0:
            lines[0] += " vilexword grimpelword nastyoword vilexword"
        rows.append("\n".join(lines))
    for i in range(0, 40, 3):  # near copies: one word of the last line is another
        w = rows[i + 1].split(" ")
        w[-1] = word()
        rows.append(" ".join(w))
    return rows + ["", None, rows[1]]


def grams(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, toxic):
    """(id, text) after the first four stages, by definition; the toxicity verdicts are given."""
    docs = {i: t for i, t in enumerate(rows) if i not in toxic}
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").lower() for x in (t or "").split("\n")]
    where = collections.defaultdict(set)
    for i, t in docs.items():
        for k in keys(t):
            if len(k) >= 40:
                where[k].add(i)
    for i, t in list(docs.items()):
        lost = {k for k in keys(t) if len(where.get(k, ())) >= 5 and max(where[k]) != i}
        docs[i] = "\n".join(x for x, k in zip((t or "").split("\n"), keys(t)) if k not in lost)
    sets = {i: grams(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (sets[i] == sets[j] or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    seen = collections.Counter(t.encode()[a : a + 200] for t in docs.values() for a in range(len(t.encode()) - 199))
    for i, t in docs.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 199):
            if seen[raw[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        docs[i] = bytes(b for b, g in zip(raw, gone) if not g).decode()
    return docs


def test_all_stages_equal_brute_force_and_columns_keep_their_values(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", 7, f"s{i}", f"l{i}", f"k{i}", f"b{i}") for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(260)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {i for i, t in enumerate(texts) if t and "vilexword" in t}
    want, now = brute(texts, toxic), docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
    got = now.collect()
    assert {r.doc_id: r.text or "" for r in got} == want
    assert all((r.lang, r.score, r.n_lines, r.kept, r.n_bytes) == ("en", f"s{r.doc_id}", f"l{r.doc_id}", f"k{r.doc_id}", f"b{r.doc_id}") for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tk = packing._tokenizer(packing_path())
    tokens = {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {r.doc_id: r.doc_tokens for r in packed} == tokens and sum(r.length for r in packed) == sum(tokens.values())


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_without_labels_no_document_is_toxic(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", 0, "x", "x", "x", "x") for i, t in enumerate(corpus(60))], SCHEMA)
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_segments_take_linear_time():
    falling = [float(x) for i in range(60_000) for x in (1.0, -2.0 - i * 1e-6)]
    assert len(toxicity.maximal_segments(falling)) == 60_000
