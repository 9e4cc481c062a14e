"""Language ID by prediction by partial matching: byte context trees with escapes, scored as code lengths."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, renamed, spread, stored, text_bytes

#: Longest context in bytes, and the documents of a language that its tree is grown from (a bounded sample by hash).
ORDER = 4
TRAIN_DOCS = 300
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20
_PROBE = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes, size: int) -> np.ndarray:
    """Each run of `size` bytes as one number; the text opens with blanks in place of what came before it."""
    b = np.frombuffer(b" " * (size - 1) + text, np.uint8).astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def _normal(text: bytes) -> bytes:
    return re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower())


def _gram_counts(order: int):
    def rows(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), text_bytes(batch["t"])):
                by.setdefault(lang, []).append(_normal(text or b""))
            for lang, texts in by.items():
                for size in range(1, order + 2):
                    values, n = np.unique(np.concatenate([grams(t, size) for t in texts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"])

    return rows


class Table:
    """Rows of per-language values under 64-bit keys, found by open addressing in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(4 * max(len(keys), 1) - 1).bit_length())
        self.values = np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])
        self.at, self.keys, self.probes = np.full(1 << self.bits, len(keys), np.int32), np.zeros(1 << self.bits, np.uint64), 0
        left, n = np.arange(len(keys)), len(keys)
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.at[slot] == n
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.at[slot[put]], self.keys[slot[put]] = left[put], keys[left[put]]
            left, self.probes = left[~put], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * _PROBE) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, and the last row (zeros) for keys that are not there."""
        none = len(self.values) - 1
        out = np.full(len(keys), none, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[todo], probe)
            row = self.at[slot]
            hit = (row != none) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = row[hit]
            todo = todo[~hit & (row != none)]
            if not len(todo):
                break
        return out


class Model:
    """Frozen context trees of all languages: code lengths of seen strings and of escapes from seen contexts.

    A byte after a context costs -log2(n / (total + kinds)) if the context has seen it, else the escape
    -log2(kinds / (total + kinds)) and then what it costs after the context without its first byte; below the empty
    context all 256 bytes cost the same. A context that a language never saw costs nothing to leave.
    """

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], order: int):
        self.langs, self.order, self.cost, self.escape = langs, order, {}, {}
        width = len(langs)
        for size in range(1, order + 2):
            lang, gram, n = counts[size]
            keys, at = np.unique(gram, return_inverse=True)
            count = np.zeros((len(keys), width))
            np.add.at(count, (at, lang), n)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            seen = kinds > 0
            out = np.where(seen, -np.log2(np.where(seen, kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            self.escape[size] = Table(contexts, out.astype(np.float32))
            low = self._lower(keys, size - 1)
            own = -np.log2(np.where(count > 0, count, 1) / np.maximum((total + kinds)[of], 1))
            self.cost[size] = Table(keys, np.where(count > 0, own, out[of] + low).astype(np.float32))

    def _lower(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Bits of the last byte of strings of `size` bytes, in every language."""
        if size == 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        keys = keys & np.uint64((1 << (8 * size)) - 1)
        row = self.cost[size].find(keys)
        out = self.cost[size].values[row]
        miss = np.flatnonzero(row == len(self.cost[size].values) - 1)
        if len(miss):
            part = keys[miss]
            out[miss] = self.escape[size].values[self.escape[size].find(part >> np.uint64(8))] + self._lower(part, size - 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language: rows are texts."""
        out, held, size = np.zeros((len(texts), len(self.langs))), [], 0

        def flush():
            cost = self._lower(np.concatenate([g for _, g in held]), self.order + 1)
            ends = np.cumsum([0, *[len(g) for _, g in held]])
            sums = np.add.reduceat(cost.astype(np.float64), ends[:-1], axis=0)
            for (i, _), s in zip(held, sums):
                out[i] += s

        for i, text in enumerate(texts):
            full = grams(text, self.order + 1)
            for s in range(0, len(full), _CHUNK):
                held.append((i, full[s : s + _CHUNK]))
                size += len(held[-1][1])
                if size >= _CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, order: int = ORDER) -> Model:
    """Grow the trees from at most train_docs whole texts of each language, taken by the hash of their id.

    Null languages, ids and texts teach nothing. The number of languages must be small (their trees go to every task).
    """
    ids = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[lang_col].alias("lang")).where("id is not null")
    # some four times as many by their place on the scale, so that no task ranks a language's ids from all over the input
    sizes = F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("n")))
    near = ids.join(sizes, "lang").withColumn("place", spread("id")).where(F.col("place") * F.col("n") <= 4 * train_docs + 100)
    first = Window.partitionBy("lang").orderBy("place", "id")
    chosen = stored(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= train_docs).select("id", "lang").distinct(), "lang-sample")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].alias("lang"), docs[text_col].cast("string").alias("t"))
    train = texts.join(F.broadcast(chosen), ["id", "lang"])  # at most train_docs rows a language
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = train.select("lang", "t").repartition(n).mapInArrow(_gram_counts(order), "lang string, size int, gram long, n long")
    table = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    if not langs:
        return Model([], {s: (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)) for s in range(1, order + 2)}, order)
    code = {x: i for i, x in enumerate(langs)}
    lang = np.array([code[x] for x in table["lang"].to_pylist()])
    size, gram, count = table["size"].to_numpy(), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return Model(langs, {s: (lang[size == s], gram[size == s], count[size == s]) for s in range(1, order + 2)}, order)


def _predicted(model, names: list[str]):
    def rows(batches):
        m = model.value
        for batch in batches:
            texts = batch["t"].to_pylist()
            pred, score, bits_a_byte = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            real = [i for i, t in enumerate(texts) if m.langs and t and _LETTER.search(t)]
            parts = [_normal(texts[i].encode()) for i in real]
            for i, part, row in zip(real, parts, m.bits(parts) if real else []):
                best = int(row.argmin())
                pred[i] = m.langs[best]
                score[i] = float(1 / np.exp2(-np.minimum(row - row[best], 1000.0)).sum())
                bits_a_byte[i] = float(row[best]) / max(len(part), 1)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(pred), pa.array(score, pa.float64()), pa.array(bits_a_byte, pa.float64())], [*names, "lang_pred", "score", "bits_per_byte"])

    return rows


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (default: all but the text), lang_pred, score (posterior of it, 0 to 1) and bits_per_byte.

    A null text, or one without a letter: `und`, score 0, null bits. A tie goes to the first language by name. Null ids
    and repeated rows each get their row; a carried column named like a result gives way to it. No rows: no rows.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col]
    base, names = carried(docs, text_col, keep, ["lang_pred", "score", "bits_per_byte"])
    cols = [c for c in base.columns if c != "t"]
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = base.mapInArrow(_predicted(shared, cols), f"{kinds}lang_pred string, score double, bits_per_byte double")
    return renamed(out, names)
