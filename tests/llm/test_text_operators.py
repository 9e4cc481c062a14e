import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import langid, packing, pieces, quality, suffix_dedup, toxicity, warc

CLASH = "doc_id long, text string, lang string, n_words string, score string, kept string, start string"


def brute_repeats(texts, least=200):
    seen = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out


def repeat_rows():
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(n))
    shared, texts = [words(n) for n in (30, 45, 60, 100, 300, 44, 43, 41)], []
    for _ in range(60):
        x = words(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 2)
            x += " " + p[a : a + r.randint(100, len(p) + 100)] + words(r.randint(0, 20))
        texts.append(x)
    return [*texts, None, "", texts[3], "It " * 900, "ab" * 50, "ab" * 101, words(3000)]


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats_match_brute_force_by_interval_trees_and_by_windows(spark, limit):
    texts = repeat_rows()
    df = spark.createDataFrame([(i if i != 7 else None, t, "x", "n") for i, t in enumerate(texts)], "doc_id long, text string, k string, n string")
    got = suffix_dedup.dedup_repeats(df, keep=["doc_id", "k", "n"], group_limit=limit).collect()
    want = brute_repeats([(t or "").encode() for t in texts])
    assert {r.doc_id: (bytes(r.kept or b""), r.n_removed, r.n_spans) for r in got} == {(i if i != 7 else None): w for i, w in enumerate(want)}
    assert all(r.kept_sha256 == hashlib.sha256(r.kept or b"").hexdigest() and r.n == "n" for r in got)


def test_maximal_repeats_tell_all_occurrences(spark):
    a, b, c = "x" * 5 + "A" * 150, "y" * 5 + "A" * 150, "z" * 5 + "B" * 99
    told = list(suffix_dedup.maximal_repeats([b"ab", b"ab", b"cb"], [b"12345", b"12399", b"12345"], 4))
    assert sorted((x, d, sorted(m)) for x, d, m in told) == [(0, 5, [0, 2]), (2, 3, [0, 1])]
    df = spark.createDataFrame([(1, a + "q" * 300), (2, b + "q" * 300), (3, c)], "doc_id long, text string")
    assert suffix_dedup.repeat_groups(df).select("key").distinct().count() == 2


def test_repeats_keep_whole_characters_and_take_no_rows(spark):
    text = "é" * 300
    df = spark.createDataFrame([(1, text + "a"), (2, "b" + text)], "doc_id long, text string")
    assert {bytes(r.kept) for r in suffix_dedup.dedup_repeats(df, characters=True).collect()} <= {b"a", b"b"}
    assert suffix_dedup.dedup_repeats(df.limit(0)).count() == 0


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n tail"


@pytest.mark.parametrize("least", [0, 50])
def test_archive_round_trip_rejects_magic_in_payloads(spark, least):
    pages = [None, "", FAKE, FAKE, "é<p>\n", "WARC/1.1\r\n", FAKE * 500, "zz", "zz"]
    rows = [(i, f"http://a b/{i}\n", h, "x") for i, h in enumerate(pages)] + [(None, None, "zz", "x")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, offset string"), min_bytes=least, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for r in got:
        text = next((h or "") for i, _, h, _ in rows if i == r.page_id)
        again = len(text.encode()) >= least and top[text] != (-1 if r.page_id is None else r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", top[text]) if again else ("response", None))
        assert r.payload_bytes == len(text.encode()) and (again or r.payload.decode() == text)


def test_damaged_and_cut_archives_leave_other_files_whole(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " + FAKE * (i % 3)) for i in range(60)] + [(99, "http://a/big", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/w", records_per_file=10)
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz")
    assert len(files) > 2
    own = {p: {r.page_id for r in warc.read_archive(spark, str(p)).collect()} for p in files}
    assert sum(map(len, own.values())) == 61
    raw = files[0].read_bytes()
    files[0].write_bytes(raw[: len(raw) // 2])  # cut
    raw = bytearray(files[1].read_bytes())
    raw[len(raw) // 2] ^= 0xFF  # damaged
    files[1].write_bytes(bytes(raw))
    for p in tmp_path.glob("w/.*.crc"):
        p.unlink()
    got = {r.page_id for r in warc.read_archive(spark, f"{tmp_path}/w").collect()}
    assert set().union(*[own[p] for p in files[2:]]) <= got <= set().union(*own.values())


def test_nested_magic_is_read_once():
    import time

    body = FAKE.encode() * 20_000
    began = time.time()
    assert len(list(warc.candidates(body))) > 10_000 and time.time() - began < 20


def test_archive_of_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_counts(t):
    t = t or ""
    words, lines = re.findall("[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(900)] + ["# * " * 40 + " ".join(word() for _ in range(30)) for _ in range(60)]
    texts += [None, "", "a b c d e " * 3 + "é\x0b\x0cx\n\n \na\na", "x " * 30000, "one two"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "q", "s", "k", "t") for i, t in enumerate(texts)], CLASH)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(960)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.apply_rules(docs, labels).collect()}
    assert {i: tuple(x)[1:6] for i, x in got.items()} == {i: brute_counts(t) for i, t in enumerate(texts)}
    assert sum(got[i].kept for i in range(900)) >= 880 and not any(got[i].kept for i in range(900, 960))
    assert any(not x.base_failed and not x.kept for x in got.values())
    assert quality.apply_rules(docs.limit(0), labels).count() == 0
    assert all(x.kept != x.base_failed for x in quality.apply_rules(docs, labels.limit(0)).collect())


def test_levels_reject_per_stratum_as_brute_force_says(spark):
    from math import ceil, comb, log

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(3, 7)))
    rows, marks = [], []
    for lang, good, hard in (("en", 300, 0), ("de", 260, 40), ("fr", 60, 0), ("es", 50, 0), (None, 0, 30)):
        for j in range(good + hard + 30):
            noise = r.choice([0, 0, 0, 1, 2]) if j < good else 25 if j < good + hard else 40
            w = [word() for _ in range(60)]
            for k in range(noise):
                w[k] += "#"
            rows.append((len(rows), " ".join(w), lang))
            marks.append((len(marks), int(j < good + hard)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.apply_rules(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    depth = len(quality.RULES["symbols"])

    def first(x):
        w, c = max(x.n_words, 1), max(x.word_chars, 1)
        n = max(sum(1 for y in (rows[x.doc_id][1] or "").split("\n") if y.strip()), 1)
        v = {"symbols": 1000 * x.n_symbols // w, "dup_lines": 1000 * x.n_dup_lines // n, "repeat_words": 1000 * x.n_repeat_words // w, "long_words": 1000 * x.word_chars // w, "short_words": 1000 * x.n_words // c}
        return next((j + 1 for j in range(depth) if any(v[k] > quality.RULES[k][j] for k in v)), depth + 1)

    level, held = {}, collections.defaultdict(list)
    for i, q in marks:
        if q:
            held[rows[i][2] or ""].append(first(got[i]))
    least = ceil(log(quality.DELTA / (len(held) + 1)) / log(1 - quality.ALPHA))
    pools = collections.defaultdict(list)
    for s, v in held.items():
        pools[s if len(v) >= least else "pool"] += v
    tail = lambda n, k: sum(comb(n, i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (n - i) for i in range(k + 1))
    for s, v in pools.items():
        fine = [j for j in range(1, depth + 1) if sum(x <= j for x in v) <= len(v) * quality.ALPHA and tail(len(v), sum(x <= j for x in v)) <= quality.DELTA / (len(held) + 1)]
        level[s] = max(fine, default=0)
    for x in got.values():
        s = rows[x.doc_id][2] or ""
        at = level[s if s in level else "pool"] if s in held else 0
        assert x.kept == (not x.base_failed and first(x) > at)
    lost = collections.Counter(rows[x.doc_id][2] for x in got.values() if not x.kept and not x.base_failed)
    assert lost["en"] == 30 and lost["fr"] >= 30 and level["de"] < level["en"]  # de has many good documents with symbols


def test_binomial_tail_is_exact(spark):
    from math import comb

    for n, k, p in [(500, 0, 0.01), (1000, 4, 0.01), (300, 12, 0.05)]:
        got = spark.range(1).select(quality.binomial_tail(quality.F.lit(n), quality.F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_maximal_segments_match_brute_force():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) for _ in range(r.randint(0, 14))]

        def split(lo, hi):  # the definition: the best segment, then the same on both sides of it
            best = max(((sum(s[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            a, n = -best[2], -best[1]
            return split(lo, a) + [sum(s[a : a + n])] + split(a + n, hi)

        assert sorted(x for _, _, x in toxicity.maximal_segments(s)) == sorted(split(0, len(s)))


def test_toxicity_separates_held_out_documents(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(1200):
        w = [word() for _ in range(80)]
        if i % 8 == 0:
            for _ in range(3):
                w[r.randrange(80)] = r.choice(["vilex", "nastyo", "grimpel"]) + r.choice(["", "s"])
        rows.append((i, " ".join(w), "en", "n", "s", "k", "t"))
    rows += [(5000, None, None, None, None, None, None), (5001, "", "en", "n", "s", "k", "t"), (None, "vilex " * 20000, "en", "n", "s", "k", "t")]
    docs = spark.createDataFrame(rows, CLASH)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(1200) if i % 5] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id", "score"]).collect()}
    assert all((out[i].score >= 0.5) == (i % 8 == 0) for i in range(0, 1200, 5))
    assert out[5000].score < 0.5 and out[5001].score == out[5000].score and out[None].score > 0.5 and not out[5000].passages
    assert len(out[0].passages) >= 1 and out[0].passages[0].end > out[0].passages[0].start
    empty = toxicity.fit(docs.limit(0), labels)
    assert {x.score for x in toxicity.score(docs, empty).collect()} == {0.25}  # no evidence is not toxic
    assert toxicity.score(docs.limit(0), empty).count() == 0


TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_holds_each_id_once(spark):
    tk = packing._tokenizer(TOKENS)
    r = random.Random(8)
    texts = ["word's don't 42 " * r.randint(0, 900) for _ in range(40)] + [None, "", "<|endoftext|> x", "日本語 ﬁ é é ÀÉ×÷", "long " * 30000, "a b c\x85d"]
    rows = [(i, t, "len", "o") for i, t in enumerate(texts)] + [(None, "no id", "len", "o"), (3, texts[3], "len", "o")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string, offset string"), TOKENS, keep=["doc_id", "length"], with_ids=True).toPandas()
    for i, t in enumerate(texts):
        if i == 3:
            continue
        own = out[out.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert len(out[out.doc_id == 3]) % 2 == 0 and out.doc_id.isna().sum() == 1
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENS).count() == 0


def test_tiny_texts_share_slots(spark):
    rows = [(i, "" if i % 3 else "a b c") for i in range(6000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENS).toPandas()
    assert len(out) == 6000 and out.groupby("sequence_id").length.sum().max() <= 4096
    assert out.sequence_id.nunique() <= out.length.sum() / 4096 + 2
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]


def test_plan_meets_demand_with_few_sequences():
    w = np.arange(64, 0, -1) * 64
    d = (3e4 * np.exp(-w / 900)).astype(int) + 1
    plan = packing.integer_patterns(w, d, 4096)
    assert (sum(p * n for p, n in plan) == d).all() and all(p @ w <= 4096 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.01 * (w @ d) / 4096 + 2


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_best_path_and_decode_to_the_text(spark):
    m = pieces.model(PIECES)
    value = {n: i for i, n in enumerate(m.names) if m.kinds[i] == "normal"}

    def best(text):  # plain dynamic program over characters
        top = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            top[e] = max([top[e - 1] + (m.unknown if text[e - 1] not in value else -1e18)] + [top[s] + m.scores[value[text[s:e]]] for s in range(max(0, e - 20), e) if text[s:e] in value])
        return top[-1]

    for text in ["the cat sat", "Erinnerung, öde!", "日本 x😀", "  two  blanks ", "tab\tline\n\nend.", "a" * 200, "w" * 70 + "é."]:
        ids = np.frombuffer(m.encode([text])[0], "<u4").tolist()
        assert m.decode(m.encode([text])[0]) == text
        score, i = 0.0, 0
        while i < len(ids):
            if m.kinds[ids[i]] == "byte":
                score += m.unknown
                lead = int(m.names[ids[i]][3:5], 16)
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            else:
                score += m.scores[ids[i]]
                i += 1
        assert score == pytest.approx(best(pieces.MARK + text.replace(" ", pieces.MARK)), rel=1e-12)
    own = m.scores[[i for i in range(len(m.names)) if m.kinds[i] == "normal"]]
    assert np.exp(own).sum() == pytest.approx(1.0) and own.max() < 0
    rows = [(1, "a b", "q"), (2, None, "q"), (3, "", "q"), (None, "x " * 50000, "q"), (1, "a b", "q")]
    got = pieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PIECES).collect()
    assert len(got) == 5 and all(r.n_tokens is not None and "q" not in tuple(r) for r in got) and all(r.round_trip for r in got) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert pieces.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_language_code_lengths_are_exact_and_predict(spark):
    r = random.Random(9)
    text = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60))
    rows = [(i, text(["the", "ing", "er", "on"]) if i % 2 else text(["lé", "que", "eau", "ou"]), "en" if i % 2 else "fr") for i in range(80)]
    extra = [(100, None, "en"), (101, "123 ! ½ ²", "fr"), (102, "the ing", None), (None, "eau " * 40000, None)]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows + extra], "doc_id long, text string, lang string, lang_pred string, score string")
    m = langid.fit(docs.where("doc_id % 4 < 2"), order=2)
    got = {x.doc_id: x for x in langid.predict(docs, m, keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") and 0 <= got[i].score <= 1 for i in range(80))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "en" and got[None].lang_pred == "fr"
    # code lengths by plain escapes over counts of the training texts
    own = [langid._normal(t.encode()) for i, t, x in rows if x == "en" and i % 4 < 2]
    counts = collections.defaultdict(collections.Counter)
    for t in own:
        padded = b"  " + t
        for i in range(2, len(padded)):
            for k in range(3):
                counts[padded[i - k : i]][padded[i]] += 1

    def bits(context, byte):
        c = counts.get(context)
        if c and c[byte]:
            return -np.log2(c[byte] / (sum(c.values()) + len(+c)))
        leave = -np.log2(len(+c) / (sum(c.values()) + len(+c))) if c else 0.0
        return leave + (bits(context[1:], byte) if context else 8.0)

    probe = b"  the onering zzq eau"
    want = sum(bits(probe[i - 2 : i], probe[i]) for i in range(2, len(probe)))
    assert m.bits([probe[2:]])[0][m.langs.index("en")] == pytest.approx(want, rel=1e-4)
    none = langid.fit(docs.limit(0))
    assert {x.lang_pred for x in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), m).count() == 0


def test_toxicity_learns_where_a_word_is_in_every_text(spark):
    r = random.Random(8)
    words = [f"plain{i}" for i in "abcdefghij"]
    text = lambda toxic: " ".join([*(r.choice(words) for _ in range(20)), *(["vilest", "scumming"] if toxic else []), "the"])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "the" not in model.known and "vilest" in model.known
    got = {x.doc_id: x.score >= 0.5 for x in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert got == {i: bool(y) for i, _, y in rows}


def test_log_odds_follow_their_formula(spark):
    df = spark.createDataFrame([(3, 1), (10, 30), (10, 0), (0, 30)], "a int, b int")
    odds, z = toxicity.log_odds(F.col("a"), F.col("b"), 10, 30, 10.0)
    for x in df.select("a", "b", odds.alias("odds"), z.alias("z")).collect():
        share = (x.a + x.b) / 41
        cells = [x.a + 10 * share, 10 - x.a + 10 * (1 - share), x.b + 10 * share, 30 - x.b + 10 * (1 - share)]
        want = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
        assert x.odds == pytest.approx(want) and x.z == pytest.approx(want / np.sqrt(sum(1 / c for c in cells)))
