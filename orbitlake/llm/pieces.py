"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, renamed

MARK = "▁"
_LONG = 64
#: Words whose ids a worker keeps; a store of this size is emptied and filled anew.
KNOWN_WORDS = 300_000
_UNKNOWN = 10.0


class DoubleArray:
    """Trie of byte strings in two arrays: the child of state s by byte b is base[s] + b + 1, if its check is s."""

    def __init__(self, words: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            at = 0
            for b in word:
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                    value.append(-1)
                at = tree[at][b]
            value[at] = v
        size = 8 * len(tree) + 8192
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        low, cursor, queue = 257, 257, [(0, 0)]  # past the largest offset, so that every free place will do
        self.value[0] = value[0]
        for node, state in queue:
            children = sorted(tree[node])
            if not children:
                self.base[state] = -1_000_000
                continue
            offsets = [b + 1 for b in children]
            if len(children) == 1:  # any free place will do
                while taken[low]:
                    low += 1
                base = low - offsets[0]
            else:
                at = cursor
                while True:
                    first = np.flatnonzero(~taken[at : at + 2048]) + at - offsets[0]
                    for o in offsets[1:]:
                        first = first[~taken[first + o]]
                    if len(first):
                        base = int(first[0])
                        break
                    at += 2048
                cursor = max(cursor, at)  # places passed by are left to single children
            self.base[state] = base
            for b in children:
                to = base + b + 1
                taken[to], self.check[to], self.value[to] = True, state, value[tree[node][b]]
                queue.append((tree[node][b], to))

    def walk(self, text: bytes, start: int):
        """(end, value) of each entry that starts there."""
        s, base, check, value = 0, self.base, self.check, self.value
        for i in range(start, len(text)):
            to = int(base[s]) + text[i] + 1
            if to < 0 or check[to] != s:
                return
            s = to
            if value[s] >= 0:
                yield i + 1, int(value[s])


def log_scores(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Log scores of the pieces. A file of log probabilities is taken as it stands.

    A file of merge ranks (all scores whole numbers) tells only the order of the pieces. Their probabilities then follow
    Zipf's law with Mandelbrot's shift, p ~ 1 / (rank + 2.7), and sum to 1 over the normal pieces: nothing is trained.
    """
    own = scores[normal]
    if not len(own) or (own != np.rint(own)).any() or np.ptp(own) < 100:
        return scores
    order = np.empty(len(own), np.int64)
    order[np.argsort(-own, kind="stable")] = np.arange(1, len(own) + 1)
    p = 1.0 / (order + 2.7)
    out = np.full(len(scores), -np.inf)
    out[normal] = np.log(p / p.sum())
    return out


class Pieces:
    """The pieces of a model file with their log scores; encodes with unigram Viterbi and decodes.

    Normal pieces make the trie; a character that no piece covers scores the lowest score less 10 and comes out as its
    bytes' pieces (byte fallback). Blanks become the marker and one marker is put in front. Of equal scores the path
    whose last piece starts first wins.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        self.kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in range(n)]
        for i in range(n):
            if self.kinds[i] == "byte":
                self.byte_ids[int(self.names[i][3:5], 16)] = i
        normal = [i for i in range(n) if self.kinds[i] == "normal"]
        self.scores = log_scores(np.array([sp.get_score(i) for i in range(n)]), np.array(normal))
        self.unknown = float(self.scores[normal].min()) - _UNKNOWN
        self.trie = DoubleArray({self.names[i].encode(): i for i in normal})
        self.longest = max(len(self.names[i].encode()) for i in normal)
        # words can be coded apart if no piece reaches over a marker or a line end from the left
        self.apart = not any(MARK in self.names[i].lstrip(MARK) or "\n" in self.names[i] for i in normal)
        # characters that no piece has after a letter: a word that ends in one is coded without it
        after = {b for i in normal for a, b in zip(self.names[i], self.names[i][1:]) if a.isalpha()}
        self.ends = {c for c in ".,;:!?)" if c not in after}
        self.known: dict[str, bytes] = {}

    def _ids(self, word: bytes, cuts: list[tuple[int, int, int]]) -> bytes:
        out: list[int] = []
        for s, e, piece in cuts:
            out += [piece] if piece >= 0 else self.byte_ids[list(word[s:e])].tolist()
        return np.array(out, "<u4").tobytes()

    def viterbi(self, word: bytes) -> bytes:
        """Best path over one long string, byte by byte."""
        n = len(word)
        best, back = np.full(n + 1, -np.inf).tolist(), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if word[s] & 0xC0 == 0x80:
                continue
            width = 1 if word[s] < 0x80 else 2 if word[s] < 0xE0 else 3 if word[s] < 0xF0 else 4
            one = False
            for e, piece in self.trie.walk(word, s):
                one |= e - s == width
                score = best[s] + float(self.scores[piece])
                if score > best[e]:
                    best[e], back[e] = score, (s, piece)
            if not one and best[s] + self.unknown > best[s + width]:
                best[s + width], back[s + width] = best[s] + self.unknown, (s, -1)
        cuts, e = [], n
        while e > 0:
            s, piece = back[e]
            cuts.append((s, e, piece))
            e = s
        return self._ids(word, cuts[::-1])

    def viterbi_many(self, words: list[bytes]) -> list[bytes]:
        """Best paths over many short strings at once: every step is one array operation over all of them."""
        n, width = len(words), max(map(len, words))
        text = np.full((n, width + self.longest + 4), 255, np.int64)  # 255 is in no piece
        size = np.array([len(w) for w in words])
        for i, w in enumerate(words):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        best, start, piece = np.full((n, width + 5), -np.inf), np.zeros((n, width + 5), np.int32), np.full((n, width + 5), -1, np.int32)
        best[:, 0] = 0
        t = self.trie
        for s in range(width):
            live = np.flatnonzero((size > s) & (text[:, s] & 0xC0 != 0x80))
            if not len(live):
                continue
            b = text[live, s]
            char = np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4)))
            one, rows, state = np.zeros(n, bool), live, np.zeros(len(live), np.int64)
            for d in range(self.longest):
                to = t.base[state] + text[rows, s + d] + 1
                ok = (to >= 0) & (t.check[np.maximum(to, 0)] == state)
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                v = t.value[state]
                at = rows[v >= 0]
                if len(at):
                    v = v[v >= 0]
                    score = best[at, s] + self.scores[v]
                    up = score > best[at, s + d + 1]
                    at, e = at[up], s + d + 1
                    best[at, e], start[at, e], piece[at, e] = score[up], s, v[up]
            # whether a piece is just the character
            for w in (1, 2, 3, 4):
                at = live[char == w]
                hit = (start[at, s + w] == s) & (piece[at, s + w] >= 0) & np.isfinite(best[at, s + w])
                one[at[hit]] = True
                at = at[~hit]
                score = best[at, s] + self.unknown
                up = score > best[at, s + w]
                best[at[up], s + w], start[at[up], s + w], piece[at[up], s + w] = score[up], s, -1
        out = []
        starts, ids = start.tolist(), piece.tolist()
        for i, w in enumerate(words):
            cuts, e = [], len(w)
            while e > 0:
                cuts.append((starts[i][e], e, ids[i][e]))
                e = starts[i][e]
            out.append(self._ids(w, cuts[::-1]))
        return out

    _words = re.compile(MARK + "+[^" + MARK + "\n]*|[^" + MARK + "\n]+|\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; an empty text has none."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        split = [self._words.findall(t) if self.apart else [t] for t in marked]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        new = {w for ws in split for w in ws if w not in self.known}
        tails = {w for w in new if w[-1] in self.ends and len(w) > 2 and w[-2].isalpha()}
        new = {x for w in new for x in ((w[:-1], w[-1]) if w in tails else (w,)) if x not in self.known}
        raw = sorted(((w, w.encode("utf-8", "replace")) for w in new), key=lambda x: len(x[1]))
        short = [x for x in raw if len(x[1]) <= _LONG]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            for (w, _), ids in zip(part, self.viterbi_many([b for _, b in part])):
                self.known[w] = ids
        long = {w: self.viterbi(b) for w, b in raw[len(short) :]}
        for w in tails:
            ids = long.get(w[:-1]) or self.known[w[:-1]]
            (long if w[:-1] in long else self.known)[w] = ids + self.known[w[-1]]
        known = self.known
        if long:
            return [b"".join([long[w] if w in long else known[w] for w in ws]) for ws in split]
        return [b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Text of ids: byte pieces joined to characters, markers as blanks, the marker put in front taken off."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not hasattr(self, "_flat"):
            raw = [bytes([int(x[3:5], 16)]) if k == "byte" else b"" if k == "other" else x.encode() for x, k in zip(self.names, self.kinds)]
            self._size = np.array([len(x) for x in raw])
            self._from, self._flat = np.cumsum(self._size) - self._size, np.frombuffer(b"".join(raw), np.uint8)
        size = self._size[at]
        ends = np.cumsum(size)
        out = self._flat[np.repeat(self._from[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def model(path: str) -> Pieces:
    return Pieces(path)


def _coded(shared, names: list[str], with_ids: bool):
    def rows(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part["t"].to_pylist()]
                ids = m.encode(texts)
                back = [m.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part[c] for c in names],
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back]),
                        pa.array([x == t for x, t in zip(back, texts)]),
                        pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                    ],
                    [*names, "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "ids"],
                )

    return rows


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The columns in `keep` (default: all but the text), n_tokens, ids_crc32, decoded_sha256, round_trip and ids.

    round_trip tells if decoding gives the text back; it does unless the text holds the marker itself. Null or empty
    text: no ids, decoded to an empty text. Null ids and repeated rows each get their row; a carried column named like
    a result gives way to it. Of paths with equal scores the one whose last piece starts first wins. No rows: no rows.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col]
    base, names = carried(docs, text_col, keep, ["n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "ids"])
    cols = [c for c in base.columns if c != "t"]
    kinds = "".join(f"{c} {base.schema[c].dataType.simpleString()}, " for c in cols)
    shared = docs.sparkSession.sparkContext.broadcast(model(model_path))  # the size of a vocabulary file
    out = base.mapInArrow(_coded(shared, cols, with_ids), f"{kinds}n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids binary")
    return renamed(out if with_ids else out.drop("ids"), names)
