"""Suffix-array dedup: maximal repeats from common-prefix interval trees over content-defined suffixes.

Sampled suffixes: in every run of min_bytes bytes the k-byte string with the smallest hash is an anchor, so two equal
runs have anchors at the same place in them. Anchors with equal k bytes meet in one group, and an enhanced suffix array
over the group (bytes after the anchor, common-prefix lengths, bytes before it) finds the repeats around them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, drop_stored, group_bounds, marked, renamed, slices, stored, text_bytes, together, whole_groups

ANCHOR_BYTES = 40
#: Different contexts of one anchor string beyond which its windows are counted by hash instead, which Spark spreads.
GROUP_LIMIT = 4_000
#: Keys of texts that a task remembers when it leaves out copies; beyond it, it starts anew.
SEEN_TEXTS = 500_000
_BLOCK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = [int(x) | 1 for x in _rng.integers(0, 1 << 63, 64, dtype=np.uint64)]


def _window_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, by doubling."""
    part, size, bits, out, done = _BYTE[buf], 1, k, None, 0
    while True:
        if bits & 1:
            if out is None:
                out, done = part.copy(), size
            else:
                n = len(buf) - done - size + 1
                out = out[:n] * np.uint64(_MUL[size % 61]) + part[done : done + n]
                done += size
        bits >>= 1
        if not bits:
            break
        part = part[:-size] * np.uint64(_MUL[size % 64]) + part[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchor_positions(text: bytes, least: int, k: int) -> np.ndarray:
    """Starts of the anchors of a text: for each run of `least` bytes the first k-byte string with the smallest hash."""
    n, found = len(text), []
    for s in range(0, max(0, n - least + 1), _BLOCK):
        buf = np.frombuffer(text, np.uint8, min(n - s, _BLOCK + least - 1), s)
        h = _window_hashes(buf, k)
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        at = (_window_min(keys, least - k + 1) & _LOW).astype(np.int64) + s
        found.append(at[np.append(True, at[1:] != at[:-1])])
    if not found:
        return np.empty(0, np.int64)
    at = np.concatenate(found)
    return at[np.append(True, at[1:] != at[:-1])]


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _anchor_rows(least: int, k: int):
    xx = xxhash.xxh3_64_intdigest

    def rows(batches):
        for batch in batches:
            copies: dict[tuple, list] = {}
            for key, text in zip(batch["k"].to_pylist(), text_bytes(batch["t"])):
                got = copies.setdefault((key, len(text)), [text, 0])
                got[1] += 1
            h, c, keys, lens, places, weights = [], [], [], [], [], []
            for (key, n), (text, times) in copies.items():
                at = anchor_positions(text, least, k).tolist()
                before = least - k
                for a in at:
                    lo = a - before if a > before else 0
                    h.append(xx(text[a : a + k]))
                    c.append(xx(text[lo : a + least], a - lo))
                places += at
                for col, v in ((keys, key), (lens, n), (weights, times)):
                    col.append(np.full(len(at), v, np.int64))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), cat(keys), cat(lens), pa.array(places, pa.int64()), cat(weights)], ["h", "c", "k", "n", "at", "w"])

    return rows


def _one_of_each(batches):
    """One copy of each text of a task, by its key."""
    seen: set = set()
    for batch in batches:
        fresh = []
        for key in zip(batch["k"].to_pylist(), batch["n"].to_pylist()):
            fresh.append(key not in seen)
            seen.add(key)
        if len(seen) > SEEN_TEXTS:
            seen.clear()
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _contexts(least: int, k: int):
    def rows(batches):
        for batch in batches:
            seen, out = set(), []
            for key, text, needs in zip(batch["k"].to_pylist(), text_bytes(batch["t"]), batch["needs"].to_pylist()):
                if (key, len(text)) in seen:
                    continue
                seen.add((key, len(text)))
                for x in needs:
                    a = x["at"]
                    out.append((x["h"], x["c"], text[max(0, a - least + k) : a], text[a : a + least]))
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
            yield _context_batch(out)

    return rows


def _context_batch(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["h", "c", "before", "after"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) >> 3)


def intervals(lcp: list[int], least: int):
    """(depth, first, last) of each common-prefix interval of a sorted list, by one scan with a stack.

    lcp[i] is the prefix that entries i and i+1 share; intervals of a depth under `least` are not told.
    """
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i
        if not stack or stack[-1][0] < d:
            stack.append((d, first))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int):
    """(lead, depth, members): the strings of lead bytes before and depth bytes from the anchors that members share.

    `before` is reversed (nearest byte first). Told are those of `least` bytes or more that extend neither to the left
    (their left neighbours differ) nor to the right for all members at once.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    right = [after[i] for i in order]
    lcp = [common_prefix(x, y) for x, y in zip(right, right[1:])]
    most = max(map(len, before), default=0)
    for depth, first, last in intervals(lcp, max(1, least - most)):
        inside = sorted(range(first, last + 1), key=lambda i: before[order[i]])
        left = [before[order[i]] for i in inside]
        shared = [common_prefix(x, y) for x, y in zip(left, left[1:])]
        for lead, s, e in intervals(shared, max(0, least - depth)):
            span = inside[s : e + 1]
            if common_prefix(right[min(span)], right[max(span)]) == depth:
                yield lead, depth, [order[i] for i in span]


def _groups_of(batches):
    for t in whole_groups(batches, ["h"]):
        h, c = t["h"].to_numpy(), t["c"].to_pylist()
        before, after = [x[::-1] for x in t["before"].to_pylist()], t["after"].to_pylist()
        bounds = group_bounds(h)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own: dict[int, int] = {}
            for i in range(s, e):
                own.setdefault(c[i], i)
            yield int(h[s]), list(own), [before[i] for i in own.values()], [after[i] for i in own.values()]


def _covers(least: int):
    def rows(batches):
        out = []
        for h, cs, before, after in _groups_of(batches):
            lead, depth = [-1] * len(cs), [-1] * len(cs)
            for left, right, members in maximal_repeats(before, after, least):
                for i in members:
                    lead[i], depth[i] = max(lead[i], left), max(depth[i], right)
            out += [(h, c, x, y) for c, x, y in zip(cs, lead, depth) if y > 0]
            if len(out) > 50_000:
                yield _longs(out, ["h", "c", "lead", "depth"])
                out = []
        yield _longs(out, ["h", "c", "lead", "depth"])

    return rows


def _longs(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = np.array(out, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, i])) for i in range(len(names))], names)


def _told(least: int):
    def rows(batches):
        for h, cs, before, after in _groups_of(batches):
            out = []
            for g, (lead, depth, members) in enumerate(maximal_repeats(before, after, least)):
                out += [(h, g, cs[i], lead, depth) for i in members]
            yield _longs(out, ["h", "g", "c", "lead", "depth"])

    return rows


def _runs(least: int):
    """Each window of `least` bytes over the anchor, by hash; for anchors with very many contexts."""

    def rows(batches):
        for batch in batches:
            out = []
            for h, c, before, after in zip(batch["h"].to_pylist(), batch["c"].to_pylist(), batch["before"].to_pylist(), batch["after"].to_pylist()):
                text, a = before + after, len(before)
                for s in range(len(text) - least + 1):
                    x = xxhash.xxh3_128_intdigest(text[s : s + least])
                    out.append((h, c, a - s, (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)))
            yield _longs(out, ["h", "c", "lead", "r1", "r2"])

    return rows


def _merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        s, e = max(0, s), min(size, e)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if s < e]


def _whole_chars(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold no part of a character: both ends move inwards to where a character starts."""
    out = []
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _cut(names: list[str], characters: bool):
    def rows(batches):
        for batch in slices(batches):
            kept, sizes, removed, spans_of, digest = [], [], [], [], []
            for text, spans in zip(text_bytes(batch["t"]), batch["spans"].to_pylist()):
                raw = text or b""
                runs = _merged(spans or [], len(raw))
                if characters:
                    runs = _whole_chars(raw, runs)
                if runs:
                    ends = [0, *[e for _, e in runs]]
                    left = b"".join(raw[a:b] for a, b in zip(ends, [*[s for s, _ in runs], len(raw)]))
                else:
                    left = raw
                kept.append(text if text is None else left)
                sizes.append(len(raw)), removed.append(len(raw) - len(left)), spans_of.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.binary()), *[batch[c] for c in names], *[pa.array(x, pa.int64()) for x in (sizes, removed, spans_of)], pa.array(digest)],
                ["kept", *names, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(text.alias("t"), F.xxhash64(text).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))


def _candidates(texts: DataFrame, least: int, k: int) -> DataFrame:
    """(h, c, k, n, at, times, kinds): anchors that occur again; times: equal contexts, kinds: different ones."""
    anchors = stored(texts.where(F.col("n") >= least).mapInArrow(_anchor_rows(least, k), "h long, c long, k long, n long, at long, w long"), "anchors")
    again = anchors.groupBy("h").agg(F.sum("w").alias("all")).where("all > 1").select("h")
    shared = stored(anchors.join(again, "h", "left_semi"), "shared-anchors")  # most anchors are alone and end here
    drop_stored(anchors)
    same = shared.groupBy("h", "c").agg(F.sum("w").alias("times"))
    strings = same.groupBy("h").agg(F.count("*").alias("kinds"))
    found = stored(shared.drop("w").join(same.join(strings, "h"), ["h", "c"]), "repeats")
    drop_stored(shared)
    return found


def _contexts_of(texts: DataFrame, found: DataFrame, least: int, k: int) -> DataFrame:
    """(h, c, before, after, kinds): the bytes around one anchor for each context that has others to compare with."""
    one = found.where("kinds > 1").groupBy("h", "c").agg(F.min(F.struct("k", "n", "at")).alias("x")).select("h", "c", "x.*")
    needs = one.groupBy("k", "n").agg(F.collect_list(F.struct("h", "c", "at")).alias("needs"))
    texts = marked(texts.where(F.col("n") >= least), needs, ["k", "n"], "may").where("may").select("t", "k", "n")
    return texts.mapInArrow(_one_of_each, "t string, k long, n long").join(needs, ["k", "n"]).select("k", "t", "needs").mapInArrow(_contexts(least, k), "h long, c long, before binary, after binary")


def repeat_groups(docs: DataFrame, text_col: str = "text", min_bytes: int = 200, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(group, lead, depth, key, at): maximal repeats around anchors with all their occurrences.

    key is xxhash64 of the text, at the anchor's byte; the repeat is the bytes [at - lead, at + depth), told up to
    min_bytes past the anchor and min_bytes - anchor_bytes before it, and of at least min_bytes.
    """
    texts = _keyed(docs, text_col)
    found = _candidates(texts, min_bytes, anchor_bytes)
    around = _contexts_of(texts, found, min_bytes, anchor_bytes).repartition(together("h")).sortWithinPartitions("h")
    told = around.mapInArrow(_told(min_bytes), "h long, g long, c long, lead long, depth long")
    named = told.select(F.xxhash64("h", "g").alias("group"), "h", "c", "lead", "depth")
    full = found.where("times > 1").select(F.xxhash64("h", "c").alias("group"), "h", "c", F.least("at", F.lit(min_bytes - anchor_bytes)).alias("lead"), F.least(F.col("n") - F.col("at"), F.lit(min_bytes)).alias("depth")).distinct()
    return named.union(full).join(found.select("h", "c", F.col("k").alias("key"), "at"), ["h", "c"]).select("group", "lead", "depth", "key", "at").distinct()


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_bytes: int = 200, anchor_bytes: int = ANCHOR_BYTES, characters: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Remove every byte covered by a min_bytes string that also starts anywhere else, in the same text or another.

    Returns the columns in `keep` (default: the id), `kept` (binary; the bytes left, joined), n_bytes, n_removed,
    n_spans and kept_sha256. With characters=True removed runs shrink to whole UTF-8 characters, so that `kept` is text.
    Null text: kept is null, counted as empty. Texts under min_bytes and empty ones stay as they are. Repeated rows are
    occurrences of their own, so both lose all (from min_bytes on). Null ids are kept. A carried column named like a
    result gives way to it. No rows: no rows.
    """
    texts = _keyed(docs, text_col)
    found = _candidates(texts, min_bytes, anchor_bytes)
    around = _contexts_of(texts, found, min_bytes, anchor_bytes)
    hot = stored(found.where(F.col("kinds") > group_limit).select("h").distinct(), "hot-anchors")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot.count():
        around = stored(around, "contexts")
        runs = around.join(hot, "h", "left_semi").mapInArrow(_runs(min_bytes), "h long, c long, lead long, r1 long, r2 long")
        runs = stored(runs, "runs")
        again = runs.groupBy("h", "lead", "r1", "r2").count().where("count > 1")
        wide = runs.join(again, ["h", "lead", "r1", "r2"]).groupBy("h", "c").agg(F.max("lead").alias("lead"), (F.lit(min_bytes) - F.min("lead")).alias("depth"))
        around = around.join(hot, "h", "left_anti")
    covers = around.repartition(n, together("h")).sortWithinPartitions("h").mapInArrow(_covers(min_bytes), "h long, c long, lead long, depth long")
    if hot.count():
        covers = covers.union(wide.select("h", "c", "lead", "depth"))
    whole = F.col("times") > 1
    lead = F.when(whole, F.lit(min_bytes - anchor_bytes)).otherwise(F.col("lead"))
    depth = F.when(whole, F.lit(min_bytes)).otherwise(F.col("depth"))
    spans = found.join(covers, ["h", "c"], "left").select("k", "n", (F.col("at") - lead).alias("s"), (F.col("at") + depth).alias("e")).where("s is not null")
    by = stored(spans.distinct().groupBy("k", "n").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    keep = [c for c in (keep if keep is not None else [id_col]) if c != text_col]
    base, names = carried(docs, text_col, keep, ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    size = F.coalesce(F.octet_length("t"), F.lit(0)).cast("long")
    base = base.withColumns({"k": F.xxhash64("t"), "n": size})
    cols = [f"c{i}" for i in range(len(names))]
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in cols)
    # texts too short for a span, null and empty ones with them, and others that certainly have none stay where they are
    base = marked(base, by, ["k", "n"], "may").withColumn("may", F.col("may") & (F.col("n") >= min_bytes))
    none = base.where("not may").select("t", *cols, F.lit(None).cast(by.schema["spans"].dataType).alias("spans"))
    some = base.where("may").join(by, ["k", "n"], "left").select("t", *cols, "spans")
    out = none.union(some).mapInArrow(_cut(cols, characters), f"kept binary, {kinds}n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return renamed(out, names)
