"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are sequences of words (runs of ASCII letters and digits or of non-ASCII bytes, ASCII lower case). A document holds an
item of m words if some run of its words, of whatever length, is within floor(m * (1 - similarity)) word edits of the item.

The CGK embedding walks over a sequence: at step j it writes the current word and moves on if a random bit of (j, word) says
so. Sequences a few edits apart fall back into step, so their embeddings are close in Hamming distance. A table samples some
steps of a walk. The items' samples are looked up with those of the documents' windows of m words: a window that equals an
item in any of `WALKS` x `TABLES` tables is a candidate, and nothing else is. Candidates are verified by their exact edit distance
with free ends around the window, so that an inserted or deleted word costs one edit. A window equal to its item is found by
every table whose samples lie within it; tests measure the recall at the threshold itself.

An item of more than `PIECE` words is looked for by its pieces of about equal length: of a run within the threshold, some piece is
within the threshold for its own length, as edits add up. What a piece finds is a place for the whole item; places are merged,
and the item is verified as a whole, once enough of its runs of words stand there.

Windows are embedded only where an item can match at all: m words with e edits leave an unchanged run of k = ceil((m - e) / (e + 1))
words, and m - k + 1 - k * e runs of k words unchanged if that is more than one, each shifted by at most e. These bounds lose
nothing.

The items are a stated set, taken in blocks of at most about `item_block` items and `block_words` words; a block's pieces are embedded
in a job, their tables are broadcast (their size is bounded by both parameters) and scanned against all documents.

Cases: null or empty items and items without a word match nothing; a null text matches nothing; a null doc_id or item_id is
carried along; items that repeat in text match each on its own id, in both they are one; a long text is handled in ranges of
words that overlap by more than the longest item; an empty table gives an empty result; other columns are ignored. `start` is
that of a closest run: the first to end, and of these the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MARKS, Words, mix, slices, written

WALKS, TABLES, SAMPLES = 16, 4, 2
#: Words of the longest piece.
PIECE = 128
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: Words of a long text that are handled at once, and windows that are embedded at once.
_RANGE, _WINDOWS = 1 << 18, 1 << 11


def _run_length(m: int, e: int) -> int:
    """Words of an unchanged run that e edits must leave in m words."""
    return max(1, -(-(m - e) // (e + 1)))


def _gram(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values, across all texts."""
    out = np.zeros(max(0, len(h) - k + 1), _U)
    for i in range(k):
        out *= _STEP
        out += h[i : i + len(out)]
    return mix(out)


def samples(m: int) -> np.ndarray:
    """The sampled steps of each walk and table, for sequences of m words: fixed, so that items and windows agree."""
    walks = WALKS * -(-m // 50)  # long sequences drift further apart
    return np.random.default_rng(m).integers(0, max(1, 2 * m - 1), (walks, TABLES, SAMPLES))


def table_keys(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Keys of windows of `sizes` words (at most m) from `starts`, in each table; 0 where a sampled step lies past the window's end."""
    steps = samples(m)
    walks = len(steps)
    at = np.zeros((walks, len(starts)), np.int64)
    read = np.zeros((walks, TABLES, SAMPLES, len(starts)), _U)
    due: dict[int, list[tuple[int, int, int]]] = {}
    for place, step in np.ndenumerate(steps):
        due.setdefault(int(step), []).append(place)
    for j in range(max(due) + 1):
        inside = at < sizes
        w = np.where(inside, h[np.minimum(starts + at, len(h) - 1)], _U(0))
        for walk, t, k in due.get(j, ()):
            read[walk, t, k] = w[walk]
        salt = np.array([(0x9E3779B97F4A7C15 * (walk * 65_536 + j + 1)) % 2**64 for walk in range(walks)], _U)
        at += (mix(w + salt[:, None]) >> _U(63)).astype(np.int64) & inside
    key = np.arange(1, walks * TABLES + 1, dtype=_U).reshape(walks, TABLES, 1)  # keys of different tables do not meet
    for k in range(SAMPLES):
        key = mix(key * _STEP + read[:, :, k])
    key[(read == 0).any(2)] = 0
    return key.reshape(walks * TABLES, len(starts)).T


def _scores(a: list[int], b: list[int], free: bool) -> Iterator[int]:
    """Word edits between all of `a` and the first 1, 2, .. words of `b` (`free`: and a run that ends there), bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    ones, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = ones, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & ones, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | (not free)) & ones, minus << 1 & ones
        up, down = minus | ~(diagonal | plus) & ones, plus & diagonal
        yield score


def edit_distance(a: list[int], b: list[int]) -> int:
    """Word edits (insert, delete, replace) between two sequences, bit-parallel."""
    if not a or not b:
        return len(a) + len(b)
    *_, score = _scores(a, b, False)
    return score


def closest_run(a: list[int], b: list[int]) -> tuple[int, int]:
    """Word edits between `a` and the closest run of `b`, and where that run starts; neither is empty."""
    ends = list(_scores(a, b, True))
    d = min(ends)
    end = ends.index(d) + 1
    back = list(_scores(a[::-1], b[max(0, end - len(a) - d) : end][::-1], False))
    return d, end - max((n for n, x in enumerate(back, 1) if x == d), default=0)


@dataclass
class Item:
    """An item's word hashes, and of its pieces the first word, the length and the keys."""

    id: int | None
    words: np.ndarray
    pieces: list[tuple[int, int, np.ndarray]]


def embedded(ids: list[int | None], texts: pa.Array) -> list[Item]:
    """The items with their pieces' keys."""
    w = Words(texts, lower=True, separators=MARKS)
    h, first = w.hashes[0], w.first
    items, by_length = [], {}
    for k, (i, a, z) in enumerate(zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True)):
        items.append(Item(i, h[a:z], []))
        cuts = np.linspace(0, z - a, max(1, -(-(z - a) // PIECE)) + 1).astype(int).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                by_length.setdefault(hi - lo, []).append((k, a, lo))
    for m, own in by_length.items():
        for at in range(0, len(own), _WINDOWS):
            some = own[at : at + _WINDOWS]
            keys = table_keys(h, np.array([a + lo for _, a, lo in some]), np.full(len(some), m), m)
            for (k, _, lo), x in zip(some, keys, strict=True):
                items[k].pieces.append((lo, m, x))
    return items


class ItemIndex:
    """A block of items: their pieces' tables by length, and the runs that a match must hold."""

    def __init__(self, items: list[Item], similarity: float):
        self.ids = [x.id for x in items]
        self.words = [x.words for x in items]
        self.m = np.array([len(x.words) for x in items], np.int64)
        allowed = lambda m: np.floor(m * (1 - similarity) + 1e-9).astype(np.int64)
        self.edits = allowed(self.m)
        self.reach = int((self.m + 2 * self.edits).max(initial=0))
        pieces = [(k, *p) for k, x in enumerate(items) for p in x.pieces]
        self.item, self.offset, self.piece_m = (np.array([p[c] for p in pieces], np.int64) for c in range(3))
        self.piece_edits = allowed(self.piece_m)
        self.tables = {}
        for m in np.unique(self.piece_m).tolist():
            own = np.flatnonzero(self.piece_m == m)
            keys = np.stack([pieces[k][3] for k in own.tolist()])
            order = np.argsort(keys, axis=None)
            order = order[np.count_nonzero(keys == 0) :]
            self.tables[m] = keys.ravel()[order], np.repeat(own, keys.shape[1])[order]
        runs = np.array([_run_length(m, e) for m, e in zip(self.piece_m.tolist(), self.piece_edits.tolist(), strict=True)], np.int64)
        self.shared = np.maximum(1, self.piece_m - runs + 1 - runs * self.piece_edits)  # an edit breaks at most `runs` of them
        grams: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (item, lo, m, _) in enumerate(pieces):
            g = _gram(self.words[item][lo : lo + m], int(runs[k]))
            grams.setdefault(int(runs[k]), []).append((g, np.full(len(g), k), np.arange(len(g))))
        self.grams = {}
        for k, parts in grams.items():
            g, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(g >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.grams[k] = bits, g[order], item[order], offset[order]
        #: of items in several pieces the run length, how many of its runs a match holds, and their hashes
        self.whole = {}
        for i in np.flatnonzero(np.bincount(self.item, minlength=len(items)) > 1).tolist():
            m, e = int(self.m[i]), int(self.edits[i])
            k = _run_length(m, e)
            self.whole[i] = k, m - k + 1 - k * e, np.unique(_gram(self.words[i], k))

    def windows(self, h: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of pieces the (document, start) of the windows that can be a piece of that length."""
        found: dict[int, list[np.ndarray]] = {}
        counts, docs = np.diff(first), len(first) - 1
        half = 1 << (len(h) + self.reach).bit_length()  # starts lie within it, on either side of 0
        for k, (bits, g, item, offset) in self.grams.items():
            own = _gram(h, k)
            at = np.flatnonzero(bits[(own >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(g, own[at], "left"), np.searchsorted(g, own[at], "right")
            n = hi - lo
            at = np.repeat(at, n)
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(at))
            i, doc = item[which], np.searchsorted(first, at, "right") - 1
            same = at + k <= first[doc + 1] if len(at) else np.zeros(0, bool)
            at, i, doc, which = at[same], i[same], doc[same], which[same]
            base = at - first[doc] - offset[which]
            line = np.sort((i * docs + doc) * (2 * half) + base + half)

            def enough(i, doc, start, line=line):
                """Whether so many of the item's runs start within e words of where they would stand."""
                e, name = self.piece_edits[i], (i * docs + doc) * (2 * half) + start + half
                return np.searchsorted(line, name + e, "right") - np.searchsorted(line, name - e, "left") >= self.shared[i]

            some = enough(i, doc, base)
            i, doc, base = np.unique(np.stack([i, doc, base], 1)[some], axis=0).T
            width = 2 * self.piece_edits[i] + 1
            start = np.repeat(base - self.piece_edits[i] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            i, doc = np.repeat(i, width), np.repeat(doc, width)
            some = enough(i, doc, start)
            i, doc, start = i[some], doc[some], start[some]
            start = np.clip(start, 0, np.maximum(counts[doc] - self.piece_m[i], 0))
            for m in np.unique(self.piece_m[i]).tolist():
                own = self.piece_m[i] == m
                found.setdefault(m, []).append(np.stack([doc[own], start[own]], 1))
        return {m: np.unique(np.concatenate(parts), axis=0) for m, parts in found.items()}

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(piece, document, start) of the windows that meet a piece in a table."""
        found = [np.zeros((0, 3), np.int64)]
        counts = np.diff(first)
        for m, windows in self.windows(h, first).items():
            table, item = self.tables[m]
            for at in range(0, len(windows), _WINDOWS):
                doc, start = windows[at : at + _WINDOWS].T
                keys = table_keys(h, first[doc] + start, np.minimum(m, counts[doc]), m)
                lo, hi = np.searchsorted(table, keys.ravel(), "left"), np.searchsorted(table, keys.ravel(), "right")
                n = hi - lo
                hit = np.repeat(np.arange(len(n)), n) // keys.shape[1]
                which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(hit))
                found.append(np.unique(np.stack([item[which], doc[hit], start[hit]], 1), axis=0))
        return np.concatenate(found)

    def matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, start, edits) of the closest run of words of each document and item within the edits allowed."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        piece, doc, start = self.candidates(h, first).T
        if not len(piece):
            return []
        i, doc, start = np.unique(np.stack([self.item[piece], doc, start - self.offset[piece]], 1), axis=0).T
        e, m = self.edits[i], self.m[i]
        joined = (np.diff(i) == 0) & (np.diff(doc) == 0) & (np.diff(start) <= (m + 2 * e)[1:])
        head, tail = np.flatnonzero(np.r_[True, ~joined]), np.flatnonzero(np.r_[~joined, True])
        i, doc, e, m = i[head], doc[head], e[head], m[head]
        lo = np.maximum(start[head] - 2 * e, 0)
        hi = np.minimum(start[tail] + m + 2 * e, np.diff(first)[doc])
        for k, pair in enumerate(zip(doc.tolist(), i.tolist(), strict=True)):
            near = h[first[pair[0]] + lo[k] : first[pair[0]] + hi[k]]
            if pair[1] in self.whole:
                size, least, grams = self.whole[pair[1]]
                if np.isin(_gram(near, size), grams).sum() < least:
                    continue
            d, at = closest_run(self.words[pair[1]].tolist(), near.tolist())
            if d <= e[k] and (pair not in best or d < best[pair][0]):
                best[pair] = d, int(lo[k]) + at
        return [(d, i, s, e) for (d, i), (e, s) in sorted(best.items())]

    def all_matches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same, long texts in ranges that overlap by more than an item and its edits take."""
        if len(h) <= 2 * _RANGE:
            return self.matches(h, first)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            for at in range(a, z, _RANGE):
                part = h[at : min(at + _RANGE + 2 * self.reach, z)]
                for _, i, s, e in self.matches(part, np.array([0, len(part)])):
                    best[doc, i] = min(best.get((doc, i), (e, s + at - a)), (e, s + at - a))
        return [(d, i, s, e) for (d, i), (e, s) in sorted(best.items())]


_MATCHES = "doc_id long, text_hash long, item_id long, start long, edits int, item_words int"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for b in slices(batches, "text"):
            w = Words(b["text"], lower=True, separators=MARKS)
            found = index.all_matches(w.hashes[0], w.first)
            if found:
                ids, hashes = b["doc_id"].to_pylist(), b["text_hash"].to_pylist()
                rows = [(ids[d], hashes[d], index.ids[i], s, e, int(index.m[i])) for d, i, s, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "item_id", "start", "edits", "item_words"])

    return run


_ITEM = "item_id long, words binary, first array<int>, size array<int>, keys array<binary>"


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        items = embedded(b["item_id"].to_pylist(), b["text"])
        columns = [
            pa.array([x.id for x in items], pa.int64()),
            pa.array([x.words.tobytes() for x in items], pa.binary()),
            *(pa.array([[p[c] for p in x.pieces] for x in items], pa.list_(pa.int32())) for c in (0, 1)),
            pa.array([[p[2].tobytes() for p in x.pieces] for x in items], pa.list_(pa.binary())),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ITEM.split(", ")])


def contaminated(docs: DataFrame, items: DataFrame, *, similarity: float = 0.8, item_block: int = 20_000, block_words: int = 1 << 20) -> DataFrame:
    """doc_id, text_hash (xxhash64), item_id, start (word), edits and item_words of the closest run of each pair that matches."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // item_block), -(-size // (6 * block_words)))  # a word has about six bytes
    out = docs.sparkSession.createDataFrame([], _MATCHES)
    prepared = written(items.repartition(F.xxhash64("item_id", "text")).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))), "items")
    for k in range(blocks):
        rows = prepared.filter(F.col("block") == k).select("item_id", "text").mapInArrow(_embed, _ITEM).collect()
        longs = lambda x: np.frombuffer(x, np.uint64)
        part = [Item(r["item_id"], longs(r["words"]), [(a, m, longs(x)) for a, m, x in zip(r["first"], r["size"], r["keys"], strict=True)]) for r in rows]
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(part, similarity))
        found = docs.mapInArrow(_scan(shared), _MATCHES)
        out = found if k == 0 else out.unionByName(found)
    return out
