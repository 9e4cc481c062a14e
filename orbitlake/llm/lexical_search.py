"""Ranked lexical search: max trees over document ranges for each term, searched best first by summed bounds."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Documents of one tree, of a leaf, and children of an inner node.
TREE, LEAF, FAN = 8192, 32, 8
#: Postings after which a tree is closed, and entries of its largest table; both bound a task's memory.
POSTINGS, ENTRIES = 1 << 20, 1 << 23
#: Characters of items that are searched in one pass; more items make more passes.
PASS_CHARS = 200_000
_NO_ID = np.iinfo(np.int64).max
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all code points from 128, in UTF-8; only A-Z are lower-cased."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_TERM_BYTES).split()


def _counted(shared):
    def rows(batches):
        known = shared.value
        for batch in batches:
            n, offsets, terms, times = [], [0], [], []
            for text in batch["t"].cast(pa.large_binary()).to_pylist():
                found = terms_of(text)
                n.append(len(found))
                for w, k in Counter(found).items():
                    if w in known:
                        terms.append(known[w])
                        times.append(k)
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], ["id", "n", "terms", "times"]
            )

    return rows


class RangeTree:
    """Documents in order of their ids, postings by leaf, and for each term and node the most that a document there gets from it."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, gains: np.ndarray, n_terms: int):
        order = np.argsort(ids, kind="stable")
        self.ids, place = ids[order], np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        docs = place[docs]
        by_leaf = np.argsort(docs // LEAF, kind="stable")
        self.docs, self.terms, self.gains = docs[by_leaf], terms[by_leaf], gains[by_leaf]
        leaves = -(-len(ids) // LEAF)
        self.starts = np.searchsorted(self.docs // LEAF, np.arange(leaves + 1))
        width = leaves
        level = np.zeros((width, n_terms), np.int64)
        np.maximum.at(level, (self.docs // LEAF, self.terms), self.gains)
        self.levels = [level]
        while width > 1:
            wider = -(-width // FAN)
            level = np.maximum.reduceat(level, np.arange(0, width, FAN), axis=0)
            self.levels.append(level)
            width = wider

    def search(self, wanted: np.ndarray, member: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put the documents that belong to the k best into `best`, a heap of (score, -id) with the worst first.

        Nodes are opened by falling bound, then rising first id. One is left closed only if its bound is under the k-th
        score, or equal to it with no smaller id inside; so is then all that is left. Scores of 0 are never taken.
        """
        top = len(self.levels) - 1
        bounds = self.levels[top][:, wanted].sum(axis=1)
        heap = [(-int(b), int(i), top) for i, b in enumerate(bounds) if b > 0]
        heap = [(b, int(self.ids[i * LEAF * FAN**lv]), lv, i) for b, i, lv in heap]
        heapq.heapify(heap)
        while heap:
            bound, first, lv, i = heapq.heappop(heap)
            if len(best) == k and (-bound, -first) <= best[0]:
                if -bound < best[0][0]:
                    return
                continue
            if lv:
                a, b = i * FAN, min((i + 1) * FAN, len(self.levels[lv - 1]))
                sums = self.levels[lv - 1][a:b][:, wanted].sum(axis=1)
                for j in np.flatnonzero(sums):
                    child = a + int(j)
                    key = (-int(sums[j]), int(self.ids[child * LEAF * FAN ** (lv - 1)]), lv - 1, child)
                    if len(best) < k or (-key[0], -key[1]) > best[0]:
                        heapq.heappush(heap, key)
                continue
            s, e = self.starts[i], self.starts[i + 1]
            use = member[self.terms[s:e]]
            # sums stay under 2**53, so that doubles hold them
            scores = np.bincount(self.docs[s:e][use] - i * LEAF, weights=self.gains[s:e][use], minlength=1).astype(np.int64)
            for j in np.flatnonzero(scores):
                found = (int(scores[j]), -int(self.ids[i * LEAF + j]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _searched(shared, n_docs: int, n_all: int, k: int):
    def trees(batches, most: int):
        """Tables of up to `most` documents, closed early when their postings are many."""
        held: list[pa.RecordBatch] = []
        rows = postings = 0
        for batch in batches:
            sums = np.append(0, np.cumsum(batch["terms"].value_lengths().to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(sums, sums[at] + POSTINGS - postings))
                stop = min(max(stop, at + 1), at + most - rows, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                rows, postings, at = rows + stop - at, postings + int(sums[stop] - sums[at]), stop
                if rows == most or postings >= POSTINGS:
                    yield pa.Table.from_batches(held)
                    held, rows, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def rows(batches):
        weights, items = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        member = np.zeros(len(weights), bool)
        for t in trees(batches, max(LEAF, min(TREE, ENTRIES // max(len(weights), 1) * LEAF))):
            ids, n = t["id"].fill_null(_NO_ID).to_numpy(), t["n"].to_numpy()
            lists = t["terms"].combine_chunks()
            docs = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            terms, times = lists.flatten().to_numpy(), t["times"].combine_chunks().flatten().to_numpy()
            m = 100 - 90 + (90 * n * n_docs) // n_all
            gains = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs]))
            tree = RangeTree(ids, docs, terms, gains, len(weights))
            for q, wanted in enumerate(items):
                if len(wanted):
                    member[wanted] = True
                    tree.search(wanted, member, best[q], k)
                    member[wanted] = False
        found = [(q, -i, s) for q, b in enumerate(best) for s, i in b]
        ids = pa.array([None if i == _NO_ID else i for _, i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in found], pa.int32()), ids, pa.array([s for _, _, s in found], pa.int64())], ["q", "id", "score"])

    return rows


def _one_pass(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    sets = [sorted(set(terms_of(r["t"]))) for r in items]
    known = {w: i for i, w in enumerate(sorted({w for s in sets for w in s}))}
    counted = stored(docs.mapInArrow(_counted(spark.sparkContext.broadcast(known)), "id long, n long, terms array<int>, times array<long>"), "search-postings")
    n_docs, n_all = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(known))], np.int64)
    wanted = [np.array([known[w] for w in s], np.int64) for s in sets]
    shared = spark.sparkContext.broadcast((weights, wanted))
    found = counted.where(F.size("terms") > 0).mapInArrow(_searched(shared, n_docs, max(n_all, 1), k), "q int, id long, score long")
    run = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = stored(found.withColumn("rank", F.row_number().over(run)).where(F.col("rank") <= k), "search-best")
    drop_stored(counted)
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(items)], "q int, item long")
    return best.join(F.broadcast(names), "q").select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, scores above 0, equal scores by rising id.

    Term counts of all documents are made in one scan that keeps only the items' terms; document frequencies, lengths
    and weights are of all documents. Each task then reads its postings in ranges of documents, builds a tree of maxima
    for each range, and carries the k best so far from range to range, so that later trees are mostly closed at their
    root. It gives k rows an item at most, which are merged by rank: no shuffle of texts or postings.

    Items are searched in passes of pass_chars characters, their terms broadcast; more items make more passes. Every
    row of items is an item, repeated ids too; null texts and items without a term that a document holds give no row.
    Repeated documents are ranked each; null ids come last among equals. Ids are whole numbers. No rows: no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    asked = items.select(items[item_id].cast("long").alias("item"), items[text_col].cast("string").alias("t")).where("t is not null")
    chars = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(chars / pass_chars))
    place = F.pmod(F.xxhash64("item", "t"), F.lit(passes))
    out = None
    for p in range(passes):
        chosen = asked.where(place == p).orderBy("item", "t").collect()  # about pass_chars characters
        if chosen:
            one = _one_pass(texts, chosen, k)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item long, rank int, id long, score long")
