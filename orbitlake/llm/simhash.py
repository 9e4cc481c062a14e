"""SimHash near-dedup with covering locality-sensitive hashing: structured bit masks, no pair within the radius lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_bounds, stored, text_bytes, together, whole_groups

BITS = 64
#: Distinct fingerprints of a bucket beyond which it is dealt out again by a second mask family on its free bits.
BUCKET_LIMIT = 20_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """All runs of `width` words, repeats included; the whole sequence if there are fewer words; none without words."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return [joined[s : e - 1] for s, e in zip(starts, ends[width - 1 :])]


def fingerprint(parts: list[bytes], seed: int = 42) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of the shingles; zero without shingles."""
    h64, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(parts), CHUNK):
        h = np.array([h64(p, seed) for p in parts[i : i + CHUNK]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(parts), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, bits: range | list[int] = range(BITS)) -> list[int]:
    """2^(radius+1)-1 masks over `bits` such that any `radius` of the bits are all outside at least one mask.

    Bit i gets a vector of radius+1 binary digits, and mask v has the bits whose vector has an odd product with v;
    any `radius` vectors leave some v that is orthogonal to all of them. Vectors go round all nonzero values, which
    gives every mask about half of the bits.
    """
    size = (1 << (radius + 1)) - 1
    vector = {b: i % size + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b, x in vector.items() if (x & v).bit_count() & 1) for v in range(1, size + 1)]


#: The bits in another order, from which hot buckets get masks of their own.
SHUFFLED = [(i * 37 + 11) % BITS for i in range(BITS)]


def table_masks(radius: int, blocks: int = 1, order: list[int] | range = range(BITS)) -> list[int]:
    """Masks for the radius over `blocks` equal parts of the bits: one part holds at most radius // blocks of the differences."""
    width = BITS // blocks
    return [m for b in range(blocks) for m in covering_masks(radius // blocks, order[b * width : (b + 1) * width])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(width: int, seeds: tuple[int, ...]):
    def rows(batches):
        for batch in batches:
            found = []
            for text in text_bytes(batch["t"]):
                parts = shingles((text or b"").lower().split(), width)
                found.append([fingerprint(parts, s) for s in seeds])
            cols = np.array(found, np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(np.ascontiguousarray(cols[:, i]).view(np.int64)) for i in range(len(seeds))]], ["id", *[f"fp{i}" for i in range(len(seeds))]])

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, fp0, fp1, ...): 64-bit SimHash fingerprints as signed longs, one for each seed. Null or blank text: zero."""
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    return base.mapInArrow(_prints(width, seeds), "id long, " + ", ".join(f"fp{i} long" for i in range(len(seeds))))


def forest(x: np.ndarray, y: np.ndarray | None, radius: int, both: int) -> list[tuple[int, int]]:
    """Edges (member, root) that span each set of fingerprints linked within the bucket.

    Linked: at most `radius` differing bits in x, and at most `both` in x and y together. A member's neighbours leave
    the unvisited set at once, so that a dense group costs one pass and no pair list is held.
    """
    left, edges, room = np.arange(len(x)), [], 1 << 21
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, room // len(left))
            part, front = front[:step], front[step:]
            d = np.bitwise_count(x[part, None] ^ x[None, left])
            near = d <= radius
            if y is not None:
                near &= d.astype(np.int16) + np.bitwise_count(y[part, None] ^ y[None, left]) <= both
            new = near.any(axis=0)
            edges += [(int(j), int(root)) for j in left[new]]
            front, left = np.concatenate([front, left[new]]), left[~new]
    return edges


def _links(radius: int, both: int, second: bool):
    def rows(batches):
        for t in whole_groups(batches, ["m", "k"]):
            m, k = t["m"].to_numpy(), t["k"].to_numpy()
            node, x = t["node"].to_numpy(), t["fp0"].to_numpy().view(np.uint64)
            y = t["fp1"].to_numpy().view(np.uint64) if second else None
            bounds, out = group_bounds(m, k), []
            for at in np.flatnonzero(np.diff(bounds) > 1):
                s, e = bounds[at], bounds[at + 1]
                out += [(node[s + i], node[s + j]) for i, j in forest(x[s:e], None if y is None else y[s:e], radius, both)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return rows


def _masked(fps: DataFrame, masks: list[int], tag: str = "m") -> DataFrame:
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias(tag), F.col("fp0").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("k")) for i, mask in enumerate(masks)])
    return fps.select("*", F.explode(tables).alias("s")).select("*", "s.*").drop("s")


def link_edges(fps: DataFrame, radius: int, blocks: int = 1, both: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between nodes that join every two fingerprints within the radius, directly or through others.

    fps: (node, fp0[, fp1]), distinct fingerprints. A bucket is the fingerprints that agree under one mask. One with
    more than bucket_limit members is dealt out by a covering family over all bits for the same radius, so that its
    members agree under both masks; links are kept whole, as each family covers each pair.
    """
    second = "fp1" in fps.columns
    both = 2 * BITS if both is None else both
    cols = ["node", "fp0", *(["fp1"] if second else [])]
    tables = _masked(fps.select(*cols), table_masks(radius, blocks))
    hot = tables.groupBy("m", "k").count().where(F.col("count") > bucket_limit).select("m", "k", F.lit(True).alias("hot"))
    hot = stored(hot, "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        # split by the masks of a family for the same radius that deals the bits in another order; what then is still
        # in one bucket agrees in most bits, and a dense bucket costs one pass
        rest = table_masks(radius, blocks, SHUFFLED)
        joined = tables.join(hot, ["m", "k"], "left")
        calm = joined.where("hot is null").select("m", "k", *cols)
        split = _masked(joined.where("hot").select(*cols, F.col("m").alias("m0"), F.col("k").alias("k0")), rest)
        split = split.select((F.lit(-1) - F.col("m0") * len(rest) - F.col("m")).alias("m"), F.xxhash64("k0", "k").alias("k"), *cols)
        tables = calm.unionByName(split)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.repartition(n, together("m", "k")).sortWithinPartitions("m", "k").mapInArrow(_links(radius, both, second), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, blocks: int = 1, both: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fp0, component_id) for each row: component_id is the smallest id reachable over links, itself included.

    Fingerprints link at `radius` or fewer differing bits; with `both`, a second fingerprint (another seed) is made and
    the two may differ in at most `both` bits together. Rows with equal fingerprints are one class from the start, so
    copies cost nothing further. Null or blank text: fingerprint zero, linked like any other. A null id never is the
    smallest; if a whole component has null ids, component_id is null. Repeated rows each get their row. Texts of any
    length are read whole; of the other columns none is read, so their names do not matter.
    """
    seeds = (42,) if both is None else (42, 43)
    names = [f"fp{i}" for i in range(len(seeds))]
    prints = stored(fingerprints(docs, id_col, text_col, width, seeds), "prints")
    node = F.col("fp0") if both is None else F.xxhash64("fp0", "fp1")
    classes = stored(prints.groupBy(*names).agg(F.min("id").alias("low")).withColumn("node", node), "classes")
    edges = link_edges(classes, radius, blocks, both, bucket_limit)
    comp = components(edges, name="simhash")
    joined = classes.join(comp, "node")
    low = joined.groupBy("component").agg(F.min("low").alias("root"))
    roots = joined.select(*names, "component").join(low, "component").select(*names, "root")
    final = classes.join(roots, names, "left").select(*names, F.coalesce("root", "low").alias("component_id"))
    return prints.join(final, names).select("id", *names, "component_id")
