"""What a Python worker holds: few rows at once, and a bounded number of words from one step to the next."""

from __future__ import annotations

import random
import string
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from orbitlake.llm.line_dedup import _probe_all
from orbitlake.llm import suffix_dedup
from orbitlake.llm.packing import WordEncoder
from orbitlake.llm.shingle_join import _prefixes
from orbitlake.llm.toxicity import Model, _scored


def _batch(n: int) -> pa.RecordBatch:
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choices("abc def", k=60)) for _ in range(6)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(n), pa.int64())], ["t", "c0"])


def _peak(step, batch: pa.RecordBatch) -> tuple[list[int], list]:
    tracemalloc.start()
    sizes, ids, before = [], [], tracemalloc.get_traced_memory()[0]
    for out in step(iter([batch])):
        sizes.append(out.num_rows)
        ids += out["c0"].to_pylist() if "c0" in out.schema.names else out["id"].to_pylist()
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert ids == list(range(batch.num_rows))
    return peak, sizes


def test_steps_on_texts_hold_few_rows_of_a_batch():
    small, large = _batch(1000), _batch(8000)
    none = SimpleNamespace(value=[])
    model = SimpleNamespace(value=Model({"abc": 1.0}, -0.05, 1.0, 1.0))
    for step in (_probe_all(none, 1, 40, 5, "c0"), _scored(model, ["c0"], True)):
        step(iter([small]))
        one, _ = _peak(step, small)
        many, sizes = _peak(step, large)
        assert max(sizes) <= 1000
        assert many < 3 * one + 1_000_000
    none = SimpleNamespace(value=(np.empty(0, np.int64), np.empty(0, np.int64)))
    keyed = large.select(["c0", "c0", "t"]).rename_columns(["id", "key", "t"])
    assert max(_peak(_prefixes(5, 4, 5, none), keyed)[1]) <= 1000


def test_an_encoder_keeps_a_bounded_number_of_words_and_forgets_none_in_a_text():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    texts = [" ".join(["often", *("".join(rng.choices(string.ascii_lowercase, k=8)) for _ in range(1000))]) for _ in range(300)]
    assert WordEncoder(path).limit <= 100_000
    few = WordEncoder(path, 5000)
    got = [x for i in range(0, 300, 2) for x in few.encode(texts[i : i + 2])]
    assert len(few.known) + len(few.older) < 20_000
    for i in range(0, 300, 30):
        want = few.tokenizer.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(got[i], "<u4").tolist() == want
    assert few.encode(texts[:1])[0] == got[0]
    # a text of more words than the limit, and older words met again
    both = few.encode([" ".join(texts[:12]), texts[-1]])
    assert np.frombuffer(both[0], "<u4").tolist() == few.tokenizer.encode(" ".join(texts[:12]), add_special_tokens=False).ids
    assert both[1] == got[-1]


def test_the_default_limit_bounds_what_stays_after_many_words():
    rng, encoder = random.Random(4), WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(60):
        encoder.encode([" ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(4000))])
    assert len(encoder.known) + len(getattr(encoder, "older", {})) < 150_000


def test_an_encoder_looks_up_each_different_word_of_a_lot_once_and_gives_new_ones_together():
    encoder, path = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json")
    calls, real = [], encoder.tokenizer

    class Counted:
        def encode(self, text, **kind):
            calls.append(text)
            return real.encode(text, **kind)

        def encode_batch(self, texts, **kind):
            raise AssertionError("an object a word")

    encoder.tokenizer = Counted()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) for _ in range(50)]
    got = encoder.encode(texts)
    assert len(calls) == 1 and len(set(got)) == 1
    assert np.frombuffer(got[0], "<u4").tolist() == real.encode(texts[0], add_special_tokens=False).ids
    rng, odd = random.Random(5), "'''strevlmd0 1\n\t.-Éß÷ÿ×a\"<|!À\x0b\x1c\x85\xa0"
    texts = ["".join(rng.choices(odd if n % 2 else "'strevlmd0 .É", k=rng.randrange(14))) for n in range(4000)]
    for text, raw in zip(texts, WordEncoder(path).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == real.encode(text, add_special_tokens=False).ids, text


def test_a_long_text_is_split_in_pieces_at_white_space(monkeypatch):
    monkeypatch.setattr("orbitlake.llm.packing.CHUNK", 50)
    rng, encoder = random.Random(6), WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join("".join(rng.choices("abc'st.1", k=rng.randrange(1, 9))) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", " ", "x" * 300]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_repeat_removal_goes_on_with_shared_anchors_only_and_keeps_rows_without_spans(spark, monkeypatch):
    rng, kept, real = random.Random(7), {}, suffix_dedup.stored

    def spy(df, name):
        out = real(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "stored", spy)
    alone = lambda n: "".join(rng.choices(string.ascii_lowercase + " ", k=n))
    passage = alone(300)
    rows = [(i, alone(2000)) for i in range(40)] + [(50, alone(500) + passage + "1"), (51, passage + "2" + alone(400)), (60, None), (61, ""), (62, "short"), (62, "short"), (None, "x" * 150)]
    out = suffix_dedup.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in out.collect())
    assert got == sorted((-1 if i is None else i, 300 if i in (50, 51) else 0) for i, _ in rows)
    assert 0 < kept["shared-anchors"] < 30 < kept["anchors"]
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()  # rows without spans are not shuffled
