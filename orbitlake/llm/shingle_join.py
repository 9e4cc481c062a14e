"""Near copies by the exact similarity of their word shingles: SimHash tables and rare-first prefixes find candidates.

SimHash with covering masks links close copies at once. Sets of similarity 0.8 differ in some ten of 64 bits, past any
radius that covering masks can pay for, so prefixes of the sets find what the tables leave; no pair is lost.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_stored, group_bounds, marked, slices, stored, text_bytes, together, whole_groups
from .simhash import link_edges

#: Shingles that many sampled documents hold come last in the order; at most FREQUENT of them are told apart.
SAMPLE, LEAST, FREQUENT = 16, 4, 1 << 18
#: Pairs looked at in one step within a bucket.
STEP = 1 << 20
#: SimHash radius of the first candidates, and bits of a parity word.
RADIUS, PARITY = 3, 512
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


#: Bytes hashed at once; a cut falls on white space.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(ODD[1])


@lru_cache(maxsize=32)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    run = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))])
    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: differences of one running sum over its bytes."""
    parts, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else n
        b = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.diff(_BLANK[b], prepend=True, append=True).nonzero()[0]
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers(max(1 << 12, 1 << (len(b) - 1).bit_length()))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        parts.append((h ^ (h >> np.uint64(32))) * ODD[2])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed) of all runs of `width` words, lower case; of the whole sequence if shorter."""
    w = word_hashes((text or b"").lower())
    if not len(w):
        return np.empty(0, np.int64)
    k = min(width, len(w))
    n = len(w) - k + 1
    h = w[:n] * ODD[0]
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * ODD[0] + w[i : i + n] * ODD[i % len(ODD)]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


class _Sets(dict):
    """Sets of the nodes met last, so that a node in many pairs is not made again for each."""

    def __init__(self, width: int, room: int = 2_000_000):
        self.width, self.room, self.held = width, room, 0

    def of(self, node: int, text: bytes | None) -> np.ndarray:
        s = self.get(node)
        if s is None:
            s = shingle_set(text, self.width)
            if self.held > self.room:
                self.clear()
                self.held = 0
            self[node] = s
            self.held += len(s) + 20
        return s


def set_print(s: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes as a signed number: each bit is what most of them have there."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        total += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(s), bitorder="little").view("<i8")[0])


def parity(s: np.ndarray, bits: int = PARITY) -> bytes:
    """Bits that tell of each residue of the hashes whether an odd number of them has it.

    Two sets differ in at least as many members as these bits differ.
    """
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1).tobytes()


def wide_parity(s: np.ndarray) -> bytes:
    """A parity word of a bit or more for each member, so that it rules out unlike sets of any size."""
    return parity(s, max(PARITY, 1 << (len(s) - 1).bit_length()) if len(s) else PARITY)


def least_difference(a: bytes, b: bytes) -> int:
    """The bits in which two parity words differ; the longer one is folded to the other's residues."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum(dtype=np.int64))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(p) for p in parts]])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))).cast(pa.list_(pa.int64()))


def _sets(width: int):
    def rows(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([_lists([shingle_set(t, width) for t in text_bytes(part["t"])])], ["h"])

    return rows


def _prefixes(width: int, num: int, den: int, frequent):
    def rows(batches):
        (often, count), seen = frequent.value, set()
        for part in slices(batches):
            nodes, sizes, prints, words, wides, firsts = [], [], [], [], [], []
            for t in text_bytes(part["t"]):
                s = shingle_set(t, width)
                n = len(s)
                nodes.append(_node(s))
                sizes.append(n)
                if nodes[-1] in seen:  # one prefix of a class is enough
                    firsts.append(s[:0])
                    prints.append(None)
                    words.append(None)
                    wides.append(None)
                    continue
                prints.append(set_print(s))
                words.append(parity(s))
                wides.append(wide_parity(s))
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(nodes[-1])
                if len(often) and n:
                    i = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    c = np.where(often[i] == s, count[i], 0)
                    if c.any():
                        s = s[np.argsort(c, kind="stable")]
                firsts.append(s[: n - -(-num * n // den) + 1] if n else s)
            yield pa.RecordBatch.from_arrays([part["id"], part["key"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(words, pa.binary()), pa.array(wides, pa.binary()), _lists(firsts)], ["id", "key", "node", "size", "print", "word", "wide", "prefix"])

    return rows


def _reach(size, pos, num: int, den: int):
    """The largest size of a set that can be similar enough if its first common shingle with this one is at `pos`."""
    return (num + den) * (size - pos) // num - size


def _shared(batches):
    """Rows of shingles that two or more sets hold in their prefixes, each with its mates: the smallest set, the next two.

    In a group of near copies these few pairs join nearly all of it, so that later not all of its pairs need be met.
    """
    for t in whole_groups(batches, ["g"]):
        t = t.take(group_bounds(*[t[c].to_numpy() for c in ("g", "place", "node")])[:-1])
        g, place = t["g"].to_numpy(), t["place"].to_numpy()
        bounds = group_bounds(g)
        n = np.diff(bounds)
        lead, end = np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n)
        some = np.flatnonzero(np.repeat(n > 1, n))
        mates = [lead[some], *[np.where(some + k < end[some], some + k, lead[some]) for k in (1, 2)]]
        cols = {"node": t["node"].to_numpy(), "size": place >> 32, "pos": place & 0xFFFFFFFF}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[some], *[cols[c][some] for c in cols], *[cols[c][m] for m in mates for c in cols])], ["g", *cols, *[f"{c}{i}" for i in range(3) for c in cols]])


def bucket_pairs(node: np.ndarray, size: np.ndarray, pos: np.ndarray, comp: np.ndarray, word: np.ndarray, num: int, den: int, one: bool = False):
    """Pairs of a bucket, in order of size, that can be similar enough and are not in one component yet.

    A pair is out if its parity words differ in more bits than sets that similar can differ in members. With `one`,
    each set has its pair with the smallest such set only.
    """
    reach = _reach(size, pos, num, den)
    low = np.searchsorted(size, -(-num * size // den))
    high = np.minimum(np.arange(len(size)), np.searchsorted(size, reach, "right"))
    n = np.maximum(high - low, 0)
    ends, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
        k = n[start:stop]
        a = np.repeat(np.arange(start, stop), k)
        b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + low[a]
        fine = (size[a] <= reach[b]) & (comp[a] != comp[b])
        a, b = a[fine], b[fine]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            on = np.bitwise_count(word[x] ^ word[y]).sum(axis=1, dtype=np.int64) * (num + den) <= (size[x] + size[y]) * (den - num)
            x, y = x[on], y[on]
            if one and len(x):
                first = np.append(True, x[1:] != x[:-1])
                x, y = x[first], y[first]
            if len(x):
                yield node[x], node[y]
        start = stop


def _pairs(num: int, den: int, one: bool):
    def rows(batches):
        for t in whole_groups(batches, ["g"]):
            g, node, size, pos, comp = (t[c].to_numpy() for c in ("g", "node", "size", "pos", "comp"))
            word = np.frombuffer(b"".join(t["word"].to_pylist()), np.uint64).reshape(len(g), -1)
            bounds, held, n = group_bounds(g), [], 0
            for s, e in zip(bounds[:-1], bounds[1:]):
                if (comp[s:e] == comp[s]).all():
                    continue
                for a, b in bucket_pairs(node[s:e], size[s:e], pos[s:e], comp[s:e], word[s:e], num, den, one):
                    held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                    n += len(a)
                    if n >= STEP:
                        yield _edges(held)
                        held, n = [], 0
            if held:
                yield _edges(held)

    return rows


def _edges(held: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.unique(np.concatenate(held, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], ["a", "b"])


def _alike(width: int, num: int, den: int):
    def rows(batches):
        sets = _Sets(width)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"], batch["tb"]):
                x, y = (sets.of(node, None if node in sets else t.as_py().encode()) for node, t in ((a, ta), (b, tb)))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) * (num + den) >= (len(x) + len(y)) * num)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _near(num: int, den: int):
    def rows(batches):
        for batch in batches:
            size = (batch["size_a"].to_numpy() + batch["size_b"].to_numpy()) * (den - num)
            apart = [least_difference(x.as_py(), y.as_py()) for x, y in zip(batch["wide_a"], batch["wide_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) * (num + den) <= size))

    return rows


def _similar(pairs: DataFrame, base: DataFrame, classes: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs whose sets have |common| / |union| >= num / den. Texts travel, as they pack closer than hashes.

    Only texts of pairs that wide parity words leave do; the words have an eighth of a byte to a quarter for each member.
    """
    of = lambda c: classes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "size_b", "wide_a", "wide_b")
    pairs = stored(near.mapInArrow(_near(num, den), "a long, b long"), f"{name}-near")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(classes.join(ends, "node").select("node", "low.id", "low.key"), f"{name}-ends")
    texts = marked(base, wanted, ["id", "key"], "may").where("may").join(wanted, ["id", "key"]).select("node", "t").dropDuplicates(["node"])
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    links = stored(both.select("a", "b", "ta", "tb").mapInArrow(_alike(width, num, den), "a long, b long"), f"{name}-links")
    drop_stored(wanted, pairs)
    return links


def _joined(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, word, comp) with the components that the links join made one.

    Only components that a link touches are looked at, each as one node; its smallest node stays its name.
    """
    of = lambda c: known.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    up = components(edges, name=f"{name}-cc").select(F.col("node").alias("comp"), "component")
    return stored(known.join(up, "comp", "left").select("node", "word", F.coalesce("component", "comp").alias("comp")), f"{name}-known")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, radius: int = RADIUS, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(id, component_id) for each row: the smallest id reachable over pairs whose shingle sets are num/den similar or more.

    Similarity: distinct shingles in common over distinct shingles in either. Shingles have one order, from rare to
    frequent (by a sample; any order is right), and two sets of that similarity share one in the prefixes of a
    (1 - num/den) part of each; so every such pair is a candidate, and each candidate is decided on the whole sets.
    First meet the sets whose SimHash is within the radius (each pair of such prints shares a table), and in a prefix
    bucket each set with the smallest and the next two; then all those of a bucket that are not in one component yet. Equal sets are one
    class from the start. Null or blank text: the empty set, similar to none but its like. Ids not null.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).withColumn("key", F.xxhash64("t"))
    part = base.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("t").mapInArrow(_sets(width), "h array<long>")
    often = part.select(F.explode("h").alias("g")).groupBy("g").count().where(F.col("count") >= least)
    often = often.orderBy(F.desc("count"), "g").limit(FREQUENT).toArrow().sort_by("g")
    frequent = spark.sparkContext.broadcast((often["g"].to_numpy(), often["count"].to_numpy()))
    full = stored(base.select("id", "key", "t").mapInArrow(_prefixes(width, num, den, frequent), "id long, key long, node long, size long, print long, word binary, wide binary, prefix array<long>"), "prefixes")
    prints = stored(full.select("id", "key", "node"), "prints")
    classes = stored(full.groupBy("node").agg(F.min(F.struct("id", "key")).alias("low"), F.first("size").alias("size"), F.max("print").alias("fp0"), F.max("word").alias("word"), F.max("wide").alias("wide")), "classes")
    posts = full.select("node", "size", F.posexplode("prefix").alias("pos", "g")).select("g", (F.shiftleft("size", 32) + F.col("pos")).alias("place"), "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = "g long, node long, size long, pos long"
    by_shingle = posts.repartition(n, together("g")).sortWithinPartitions("g", "place", "node")
    shared = stored(by_shingle.mapInArrow(_shared, fields + "".join(f", node{i} long, size{i} long, pos{i} long" for i in range(3))), "shared")
    drop_stored(full)
    mates = shared.select("node", "size", "pos", F.explode(F.array(*[F.struct(F.col(f"node{i}").alias("node"), F.col(f"size{i}").alias("size"), F.col(f"pos{i}").alias("pos")) for i in range(3)])).alias("m"))
    small, large = F.least("size", "m.size"), F.greatest("size", "m.size")
    fits = (small * den >= large * num) & ((F.col("size") + F.col("m.size")) * num <= F.least(F.col("size") - F.col("pos"), F.col("m.size") - F.col("m.pos")) * (num + den))
    leads = mates.where(fits & (F.col("node") != F.col("m.node"))).select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))
    close = link_edges(classes.select("node", "fp0"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = stored(leads.union(close).distinct(), "first-pairs")
    links = _similar(first, base, classes, width, num, den, "first")
    known = _joined(classes.select("node", "word", F.col("node").alias("comp")), links, "first")
    done = first.select("a", "b")
    for one, name in ((True, "next"), (False, "other")):  # one pair for each set of a bucket, then all that are left
        rest = shared.select("g", "node", "size", "pos").join(known, "node")
        # buckets that are one component by now have nothing left to tell
        apart = rest.groupBy("g").agg((F.min("comp") != F.max("comp")).alias("apart")).where("apart").select("g")
        rest = rest.join(apart, "g").repartition(n, together("g")).sortWithinPartitions("g", "size", "node").select("g", "node", "size", "pos", "comp", "word")
        pairs = stored(rest.mapInArrow(_pairs(num, den, one), "a long, b long").distinct().join(done, ["a", "b"], "left_anti"), f"{name}-pairs")
        links = _similar(pairs, base, classes, width, num, den, name)
        known = _joined(known, links, name)
        done = done.unionByName(pairs)
    drop_stored(shared)
    joined = classes.select("node", "low").join(known.select("node", F.col("comp").alias("component")), "node")
    roots = joined.groupBy("component").agg(F.min("low.id").alias("component_id"))
    return prints.select("id", "node").join(joined.join(roots, "component").select("node", "component_id"), "node").select("id", "component_id")
