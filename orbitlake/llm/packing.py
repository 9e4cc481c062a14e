"""Packing by cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, renamed, slices, stored

SEQUENCE = 4096
END_ID = 2
#: Lengths are rounded up to multiples of this in the linear program, so that its rows stay few. Shorter pieces of one
#: length share a slot of this size, as many as it holds.
QUANTUM = 16
#: Rows of counts or slots that go to all tasks at most; more are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Characters whose case, normal form and class are the same in every Unicode version; other texts go to the library whole.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*")
#: Plain characters split at once; a cut falls on white space.
CHUNK = 1 << 20
_GAP = re.compile("[\t\n\x0b\x0c\r ]")
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in map(chr, range(256))], np.uint8)
_KIND = np.array([_SPACE if c in "\t\n\x0b\x0c\r " else _DIGIT if c in "0123456789" else _LETTER if "a" <= c <= "z" or c >= "ß" and c != "÷" else _SYMBOL for c in map(chr, range(256))], np.uint8)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of plain lower-case Latin-1 text, as the vocabulary splits it.

    Words: runs of letters, single digits, runs of other symbols, and 's 't 're 've 'm 'll 'd behind anything but a symbol.
    """
    kind = np.append(_KIND[b], np.uint8(_SPACE))
    other = kind[1:] != kind[:-1]
    single = kind == _DIGIT
    start = (np.append(True, other) | single) & (kind != _SPACE)
    end = (np.append(other, True) | single) & (kind != _SPACE)
    mark = np.flatnonzero((b == ord("'")) & start[:-1] & end[:-1])
    if len(mark):
        wide = np.append(b, np.zeros(3, np.uint8))
        x, y = wide[mark + 1], wide[mark + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        mark, last = mark[one | two], (mark + one + 2 * two)[one | two]
        end[mark] = False
        start[mark + 1] = False
        start[last[~end[last]] + 1] = True
        end[last] = True
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class WordEncoder:
    """Token ids of texts as the tokenizer gives them, with the ids of the words met last kept for the next time.

    The vocabulary splits texts into words before merging, so ids of a text are its words' ids in a row. A Python worker
    keeps its encoder for all its life, so words are kept in two lots: past `limit` words the older lot is given up.
    """

    def __init__(self, path: str, limit: int = 1 << 16):
        self.tokenizer, self.known, self.older, self.limit = _tokenizer(path), {}, {}, limit
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        parts: list[list[bytes]] = [[] for _ in texts]
        lot, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if "<|" in text or not _PLAIN.fullmatch(text):
                parts[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            at = 0
            while at < len(text):
                cut = _GAP.search(text, at + CHUNK) if len(text) > at + CHUNK else None
                stop = cut.start() if cut else len(text)
                lot.append(text[at:stop].encode("latin-1"))
                owners.append(i)
                held, at = held + stop - at, stop
                if held >= CHUNK:
                    self._encode_plain(lot, owners, parts)
                    lot, owners, held = [], [], 0
        if lot:
            self._encode_plain(lot, owners, parts)
        return [b"".join(p) for p in parts]

    def _encode_plain(self, lot: list[bytes], owners: list[int], parts: list[list[bytes]]) -> None:
        """Adds to each owner the ids of its texts; each different word of the lot is looked up once."""
        b = _LOWER[np.frombuffer(b"\n".join(lot), np.uint8)]
        starts, ends = plain_words(b)
        if not len(starts):
            return
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[_KIND[b] != _SPACE])]).dictionary_encode()
        _, at, data = words.dictionary.buffers()
        data, at = data.to_pybytes(), np.frombuffer(at, np.int32)[: len(words.dictionary) + 1].tolist()
        raws = self._raws([data[s:e] for s, e in zip(at, at[1:])])
        ids = np.frombuffer(b"".join(raws), "<u4")
        sizes = np.array([len(r) // 4 for r in raws], np.int64)
        which = words.indices.to_numpy()
        n = sizes[which]
        past = np.cumsum(n)
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - (past - n), n) + np.arange(past[-1])]
        edges = np.cumsum([0, *[len(x) + 1 for x in lot]])
        bounds = np.append(0, past)[np.searchsorted(starts, edges)]
        for i, s, e in zip(owners, bounds[:-1].tolist(), bounds[1:].tolist()):
            parts[i].append(ids[s:e].tobytes())

    def _raws(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these different words."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
        for i in range(0, len(new), 4096):
            known.update(zip(new[i : i + 4096], self._fresh(new[i : i + 4096])))
        return [known[w] for w in words]

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by the tokenizer: all in one text, cut behind the ids that end a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode("latin-1"), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) == len(words) and ends[-1] == len(ids):
            return [ids[s:e].tobytes() for s, e in zip([0, *ends], ends)]
        alone = [w.decode("latin-1") for w in words]  # a vocabulary that marks no ends of words
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(alone, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that words known from earlier tasks stay known."""
    return WordEncoder(path)


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        encoder = _encoder(path)
        for batch in slices(batches):
            ids, texts = batch["c0"], batch["t"].to_pylist()
            for s in range(0, len(texts), 256):
                out = []
                for row, raw in enumerate(encoder.encode([t or "" for t in texts[s : s + 256]]), s):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, size):
                        part = raw[at * 4 : (at + size) * 4]
                        out.append((row, at, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
                if not out:
                    continue
                cols = list(zip(*out))
                take = pa.array(cols[0])
                names = [c for c in batch.schema.names if c[0] == "c"]
                yield pa.RecordBatch.from_arrays([*[batch[c].take(take) for c in names], *[pa.array(cols[i], pa.int64()) for i in (1, 2, 3, 4)], pa.array(cols[5], pa.binary())], [*names, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return rows


def best_pattern(weights: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of weights within `room` of the largest value."""
    unit = int(np.gcd.reduce(weights))
    weights, room = weights // unit, room // unit
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = weights <= r
        if not fits.any():
            best[r] = best[r - 1]
            continue
        total = best[r - weights[fits]] + values[fits]
        i = int(total.argmax())
        if total[i] > best[r - 1] + 1e-12:
            best[r], choice[r] = total[i], np.flatnonzero(fits)[i]
        else:
            best[r] = best[r - 1]
    count, r = np.zeros(len(weights), np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            count[choice[r]] += 1
            r -= weights[choice[r]]
    return float(best[room]), count


def column_generation(weights: np.ndarray, demand: np.ndarray, room: int, rounds: int = 6000, gap: float = 2e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns with their (fractional) numbers that cover the demand with few sequences: the cutting-stock program.

    A simplex over patterns, one row for each length; each entering column is the knapsack answer to the row prices.
    """
    m = len(weights)
    per = room // weights
    basis, inverse, x = np.diag(per).astype(float), np.diag(1.0 / per), demand / per
    for _ in range(rounds):
        prices = inverse.sum(axis=0)  # each pattern costs one sequence
        value, column = best_pattern(weights, np.maximum(prices, 0), room)
        if value <= 1 + 1e-7 or x.sum() <= (1 + gap) * float(prices @ demand) / value:  # the bound of these prices
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m)]


def integer_patterns(weights: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly the demand: rounded down, and the rest packed best-fit."""
    plan, left = [], demand.astype(np.int64).copy()
    for pattern, times in sorted(column_generation(weights, demand, room), key=lambda p: -p[1]):
        use = pattern > 0
        n = min(int(times + 1e-6), int((left[use] // pattern[use]).min())) if use.any() else 0
        if n:
            plan.append((pattern, n))
            left -= pattern * n
    while left.any():
        pattern, space = np.zeros_like(left), room
        for i in np.argsort(-weights, kind="stable"):
            n = min(int(left[i]), space // int(weights[i]))
            pattern[i] += n
            space -= n * int(weights[i])
        use = pattern > 0
        n = max(1, int((left[use] // pattern[use]).min()))
        plan.append((pattern, n))
        left -= pattern * n
    return plan


def slots(plan: list[tuple[np.ndarray, int]], classes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, past rank, each, first sequence): pieces of a class by rank go `each` to a sequence."""
    out, sequence, used = [], 0, np.zeros(len(classes), np.int64)
    for pattern, n in plan:
        for i in np.flatnonzero(pattern):
            each = int(pattern[i])
            out.append((int(classes[i]), int(used[i]), int(used[i]) + each * n, each, sequence))
            used[i] += each * n
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, quantum: int = QUANTUM, with_ids: bool = False) -> DataFrame:
    """Cut token ids of documents into pieces and give each piece a sequence of at most `sequence` tokens.

    A document is its ids and end_id; pieces of `sequence` ids fill a sequence alone, the last piece of each document
    goes where the cutting-stock plan puts its length. Returns the columns in `keep` (default: the id), start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and the ids (little-endian unsigned 32-bit) with with_ids. Null text:
    empty, one piece of end_id. Null ids and repeated rows each get their pieces. A carried column named like a result
    gives way to it. No rows: no rows. Ranks within a length come from counts by hash bucket, so that a length which
    most documents have is still dealt over the cluster.
    """
    spark = docs.sparkSession
    results = ["start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    base, names = carried(docs, text_col, keep if keep is not None else [id_col], results)
    if not names:
        base = base.withColumn("c0", F.lit(0))
    cols = [c for c in base.columns if c != "t"]
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in cols)
    cut = base.mapInArrow(_pieces(tokenizer_path, sequence, end_id, with_ids), f"{kinds}start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    if not with_ids:
        cut = cut.drop("ids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.when(F.col("length") <= quantum, F.col("length")).otherwise(F.least(F.ceil(F.col("length") / quantum) * quantum, F.lit(sequence))).cast("long")
    spread = F.pmod(F.xxhash64("ids_crc32", "doc_tokens", "start", F.monotonically_increasing_id()), F.lit(buckets))
    pieces = stored(cut.withColumns({"size": size, "bucket": spread}), "pieces")
    counts = stored(pieces.groupBy("size", "bucket").count(), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    full, first_slot, shared = histogram.pop(sequence, 0), {}, 0
    for length in [n for n in sorted(histogram) if n <= quantum]:
        first_slot[length] = shared
        shared += -(-histogram.pop(length) // (quantum // length))
    cells = len(histogram) + len(first_slot)
    if shared:
        histogram[quantum] = shared
    classes = np.array(sorted(histogram, reverse=True), np.int64)
    plan = integer_patterns(classes, np.array([histogram[c] for c in classes.tolist()]), sequence) if len(classes) else []
    table = slots(plan, classes)
    n_planned = sum(n for _, n in plan)
    if full:
        table.append((sequence, 0, full, 1, n_planned))
    slot_rows = spark.createDataFrame(table or [(0, 0, 0, 1, 0)], "of long, low long, high long, each long, first long")
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")).drop("count")
    order = ["doc_tokens", "ids_crc32", "start", *cols]
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*order)) - 1)
    if cells * buckets <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = ranked.join(before, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    slot = F.col("rank")
    for length, at in first_slot.items():
        slot = F.when(F.col("size") == length, F.lit(at) + F.floor(F.col("rank") / (quantum // length))).otherwise(slot)
    kind = F.when(F.col("size") <= quantum, F.lit(quantum)).otherwise(F.col("size"))
    ranked = ranked.withColumns({"slot": slot.cast("long"), "kind": kind.cast("long")})
    if len(table) <= BROADCAST_ROWS:
        slot_rows = F.broadcast(slot_rows)
    placed = ranked.join(slot_rows, (F.col("kind") == F.col("of")) & (F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("slot") - F.col("low")) / F.col("each")).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "size", "rank")
    out = placed.withColumn("offset", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return renamed(out.select(*cols[: len(names)], "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "sequence_id", "offset"), names)
