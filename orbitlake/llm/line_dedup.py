"""Line dedup: a sharded minimal perfect hash over frequent line keys; documents probe its arrays."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, carried, group_bounds, renamed, slices, stored, text_bytes, together, whole_groups

#: Keys in a shard of the index, about; a shard is built in one task.
SHARD_KEYS = 200_000
#: Bytes of index blobs up to which tasks get them by broadcast; beyond it probes go to the shards.
BROADCAST_BYTES = 48_000_000
LOWEST = -(1 << 63)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line: stripped of ASCII white space, A-Z lower-cased; None if under `least` code points."""
    if len(line) < least:
        return None
    key = line.strip(SPACE_BYTES)
    if len(key) < least or (not key.isascii() and len(key) - sum(map(key.count, _CONT)) < least):
        return None
    return key.lower()


_CONT = [bytes([b]) for b in range(0x80, 0xC0)]


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(a ^ _mix(b + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of 128-bit keys in levels of bit arrays with ranks, two bits a key and level.

    A key takes the first level where no other key has its place; its index is the rank of that place.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, base, level = [], 0, 0
        while len(a):
            size = max(64, 2 * len(a))
            at = _place(a, b, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, (base + np.cumsum(ones) - ones).astype(np.int64)))
            base += int(ones.sum())
            left = ~alone[at.astype(np.int64)]
            a, b, level = a[left], b[left], level + 1
        self.n = base

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key in 0..n-1; for keys outside the set any index, or -1."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            at = _place(a[todo], b[todo], level, size)
            w, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            word = words[w]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = ranks[w[hit]] + below[hit]
            todo = todo[~hit]
        return out


class Shard:
    """Arrays in the order of the hash: a 64-bit fingerprint, the document count, the largest document id.

    The hash is over the distinct keys that two or more documents hold; any other key meets a foreign fingerprint.
    """

    def __init__(self, a, b, counts, top):
        self.hash = PerfectHash(a, b)
        at = self.hash.index(a, b)
        self.prints, self.counts, self.top = np.empty_like(b), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
        self.prints[at], self.counts[at], self.top[at] = b ^ a, np.minimum(counts, 0xFFFFFFFF), top

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many documents each key is (0 for keys outside the set), and the largest id of those."""
        if not self.hash.n:
            return np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        at = self.hash.index(a, b)
        return np.where((at >= 0) & (self.prints[at] == b ^ a), self.counts[at], 0), self.top[at]


def _line_rows(least: int):
    def rows(batches):
        for batch in slices(batches):
            ids, h1, h2 = batch["c0"].to_pylist(), [], []
            own = []
            for i, text in zip(ids, text_bytes(batch["t"])):
                if not text:
                    continue
                for h in {_hashes(k) for line in text.split(b"\n") if (k := line_key(line, least)) is not None}:
                    h1.append(h[0]), h2.append(h[1]), own.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(own, pa.int64())], ["h1", "h2", "doc"]
            )

    return rows


def _build(batches):
    for t in whole_groups(batches, ["shard"]):
        shard = t["shard"].to_numpy()
        col = {c: t[c].to_numpy() for c in ("h1", "h2", "n", "top")}
        bounds = group_bounds(shard)
        for s, e in zip(bounds[:-1], bounds[1:]):
            made = Shard(col["h1"][s:e].astype(np.int64).view(np.uint64), col["h2"][s:e].astype(np.int64).view(np.uint64), col["n"][s:e], col["top"][s:e].astype(np.int64))
            blob = pickle.dumps(made, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[s])], pa.int64()), pa.array([blob], pa.binary()), pa.array([len(blob)], pa.int64())], ["shard", "blob", "size"])


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> tuple[DataFrame, int]:
    """(shard, blob, size) and the number of shards: the index of line keys of at least min_chars code points.

    A key that one document alone holds needs no place in it: it can't be shared.
    """
    base = docs.select(docs[text_col].cast("string").alias("t"), docs[id_col].cast("long").alias("c0"))
    lines = base.mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long")
    common = stored(
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.coalesce(F.max("doc"), F.lit(LOWEST)).alias("top")).where("n > 1"), "lines"
    )
    shards = max(1, -(-common.count() // SHARD_KEYS))
    by = common.withColumn("shard", F.pmod("h1", F.lit(shards)))
    parts = by.repartition(shards, together("shard")).sortWithinPartitions("shard").mapInArrow(_build, "shard long, blob binary, size long")
    return stored(parts, "line-index"), shards


def _split_keys(text: bytes | None, least: int):
    lines = (text or b"").split(b"\n")
    return lines, [line_key(x, least) for x in lines]


def _rebuilt(batch: pa.RecordBatch, lost: list[dict | set], parsed) -> pa.RecordBatch:
    texts, n, dropped = [], [], []
    for (lines, keys), gone in zip(parsed, lost):
        left = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
        texts.append(b"\n".join(left))
        n.append(len(lines)), dropped.append(len(gone))
    names = [c for c in batch.schema.names if c[0] == "c"]
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.binary()).cast(pa.string()), *[batch[c] for c in names], pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["t", *names, "n_lines", "n_dropped"]
    )


def _probe_all(shared, shards: int, least: int, min_docs: int, id_at: str):
    def rows(batches):
        index = {k: pickle.loads(v) for k, v in shared.value}
        for batch in slices(batches):
            parsed = [_split_keys(t, least) for t in text_bytes(batch["t"])]
            where = [(d, i) for d, (_, keys) in enumerate(parsed) for i, k in enumerate(keys) if k is not None]
            lost: list[set] = [set() for _ in parsed]
            if where and index:
                ids = batch[id_at].to_pylist()
                h = np.array([_hashes(parsed[d][1][i]) for d, i in where], np.uint64).reshape(-1, 2)
                shard = np.ascontiguousarray(h[:, 0]).view(np.int64) % shards
                for s in np.unique(shard):
                    if int(s) not in index:
                        continue
                    at = np.flatnonzero(shard == s)
                    n, top = index[int(s)].probe(h[at, 0], h[at, 1])
                    hit = n >= min_docs
                    for j, best in zip(at[hit].tolist(), top[hit].tolist()):
                        d, i = where[j]
                        if (LOWEST if ids[d] is None else ids[d]) != best:
                            lost[d].add(i)
            yield _rebuilt(batch, lost, parsed)

    return rows


def _asks(shards: int, least: int, id_at: str):
    def rows(batches):
        for batch in slices(batches):
            ids, out = batch[id_at].to_pylist(), []
            for i, key, key2, text in zip(ids, batch["key"].to_pylist(), batch["key2"].to_pylist(), text_bytes(batch["t"])):
                for at, k in enumerate(_split_keys(text, least)[1]):
                    if k is not None:
                        a, b = np.array(_hashes(k), np.uint64).view(np.int64).tolist()
                        out.append((a % shards, a, b, LOWEST if i is None else i, key, key2, at, None))
            kinds = (*[pa.int64()] * 6, pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["shard", "h1", "h2", "doc", "key", "key2", "at", "blob"])

    return rows


def _answer(min_docs: int):
    """Rows sorted so that the index blob of a shard comes before the probes of it; a shard's probes pass in a stream."""

    def rows(batches):
        shard, index = None, None
        for batch in batches:
            of, blobs = batch["shard"].to_numpy(), batch["blob"]
            bounds = group_bounds(of)
            for s, e in zip(bounds[:-1], bounds[1:]):
                if of[s] != shard:
                    shard, index = of[s], None
                if blobs[int(s)].is_valid:
                    index, s = pickle.loads(blobs[int(s)].as_py()), s + 1
                if index is None or s >= e:
                    continue
                part = batch.slice(s, e - s)
                n, top = index.probe(*[part[c].to_numpy().view(np.uint64) for c in ("h1", "h2")])
                gone = pa.array((n >= min_docs) & (top != part["doc"].to_numpy()))
                yield part.select(["key", "key2", "at"]).filter(gone)

    return rows


def _drop(least: int):
    def rows(batches):
        for batch in slices(batches):
            parsed = [_split_keys(t, least) for t in text_bytes(batch["t"])]
            lost = [set(x or ()) for x in batch["gone"].to_pylist()]
            yield _rebuilt(batch, lost, parsed)

    return rows


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop lines that many documents share, except in the largest document id that holds them.

    Returns the columns in `keep` (default: the id), the text left as `text_col`, n_lines (before dropping) and
    n_dropped. Tasks get the index by broadcast while its blobs are within broadcast_bytes; beyond that the hashes
    of the lines go to the shards (salted, each part with its own copy of the shard) and only hits come back.
    Null or empty text: one empty line. A null id ranks below all others. Repeated rows count as documents of their
    own. A carried column named like a result gives way to it. No rows: no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in (keep if keep is not None else [id_col]) if c != text_col]
    index, shards = line_index(docs, id_col, text_col, min_chars)
    size = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    work = docs.withColumn("__id", docs[id_col].cast("long"))
    base, names = carried(work, text_col, ["__id", *keep], ["n_lines", "n_dropped"])
    kinds = ", ".join(f"c{i} {base.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    schema = f"t string, {kinds}, n_lines long, n_dropped long"
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.collect()])
        out = base.mapInArrow(_probe_all(shared, shards, min_chars, min_docs, "c0"), schema)
    else:
        keyed = base.withColumns({"key": F.xxhash64("c0", "t"), "key2": F.xxhash64(F.lit(1), "t", "c0")})
        salts = 16
        asks = keyed.select("c0", "key", "key2", "t").mapInArrow(_asks(shards, min_chars, "c0"), "shard long, h1 long, h2 long, doc long, key long, key2 long, at int, blob binary")
        asks = asks.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
        blobs = index.select("shard", *[F.lit(None).cast(k).alias(c) for c, k in (("h1", "long"), ("h2", "long"), ("doc", "long"), ("key", "long"), ("key2", "long"), ("at", "int"))], "blob", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])).alias("salt"))
        met = asks.unionByName(blobs).withColumn("first", F.col("blob").isNull())
        # the same (shard, salt) must not share a run with another: shard and salt in one key
        met = met.withColumn("shard", F.col("shard") * salts + F.col("salt"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
        hits = met.repartition(parts, together("shard")).sortWithinPartitions("shard", "first").drop("salt", "first").mapInArrow(_answer(min_docs), "key long, key2 long, at int")
        gone = hits.groupBy("key", "key2").agg(F.collect_set("at").alias("gone"))
        out = keyed.join(gone, ["key", "key2"], "left").drop("key", "key2").mapInArrow(_drop(min_chars), schema)
    return renamed(out.withColumnRenamed("t", "__text"), names).drop("__id").withColumnRenamed("__text", text_col)
