"""Token-id shards compressed by Re-Pair: frequent id pairs become nonterminals, round after round, in each shard on its own.

Each round replaces the most frequent pairs, up to `per_round` of them; rounds go on until no pair occurs `least` times or, where
ids and nonterminals fit 16 bits, until these are used up. A rule takes twelve bytes and a replaced pair saves two, so a
pair seen less often than `least` = 8 times, or symbols of 32 bits, would make a shard larger.

Format of a shard (little-endian): the magic b"RPS1"; int64 counts of documents, rules, rounds and symbols; int64 first
nonterminal; then uint32 rule left sides, right sides and expansion lengths, int64 rules at the end of each round, int64
symbols of each document, and the symbols as uint16 where all fit, else uint32 (a last header number tells the width). No
pair crosses a document's end, so a document is decoded from its own symbols; expansion lengths give the symbol that holds
any token without expanding what stands before it.

A store is a Parquet table in the shared folder, one row per shard: atomic to write, safe when an executor is lost, and
readable from any file system that Spark reads. Shards follow each other in ascending doc_id order (`part`, `seq`).

Cases: a null text counts as empty (the end id alone); null doc_ids come first; equal doc_ids stay in a fixed order by
their texts; an empty table gives an empty store; a document larger than `shard_ids` is a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import slices, table_path
from .pieces import encoder

MAGIC = b"RPS1"
#: Slots of the table that finds a pair's rule; a power of two.
_SLOTS = 1 << 20
#: Rules of up to so many ids are expanded once for a shard, longer ones where they stand.
SHORT = 64


def compress(ids: np.ndarray, counts: np.ndarray, first: int, *, least: int = 8, per_round: int = 2048) -> bytes:
    """A shard from the ids of its documents, one after the other. `first`: the smallest number above all ids."""
    s = ids.astype(np.uint32)
    stops = np.cumsum(counts)[counts > 0] - 1  # where each document's last symbol stands
    left, right = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    lengths = np.zeros(0, np.uint32)
    ends = []
    near = None  # where pairs begin that hold a nonterminal of the last round; none: any pair may be frequent
    while True:
        room = min(per_round, (1 << 16) - first - len(left) if first < 1 << 16 else per_round)
        if len(s) < 2 or room <= 0:
            break
        half = 16 if first + len(left) < 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        if near is None:
            wide = s.astype(kind, copy=False)
            pair = (wide[:-1] << kind(half)) | wide[1:]
            pair[stops[:-1]] = kind(-1 % (1 << 2 * half))  # across documents; no pair is so large, as a symbol is still free
            ordered = np.sort(pair)[: len(pair) - len(stops) + 1]
        else:
            pair = (s[near].astype(kind) << kind(half)) | s[near + 1].astype(kind)
            ordered = np.sort(pair)
        if not len(ordered):
            break
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        seen = np.diff(np.r_[edge, len(ordered)])
        often = np.flatnonzero(seen >= least)
        if not len(often):
            break
        waiting = len(often)
        often = often[np.lexsort((ordered[edge[often]], -seen[often]))][:room]
        keys = ordered[edge[often]]
        slot = _slot(keys)
        _, one = np.unique(slot, return_index=True)  # of pairs that share a slot the more frequent one; the others' turn comes next round
        keys = keys[np.sort(one)]
        waiting -= len(keys)
        number = np.int16 if per_round < 1 << 15 else np.int32
        table = np.full(_SLOTS, -1, number)
        table[_slot(keys)] = np.arange(len(keys), dtype=number)
        rule = table.take(_slot(pair))
        at = np.flatnonzero(rule >= 0)
        at = at[keys[rule[at]] == pair[at]]
        rule, hit = rule[at], at if near is None else near[at]
        start = np.r_[True, np.diff(hit) > 1]  # in a run of overlapping hits every second one counts
        place = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
        rule, hit = rule[place % 2 == 0], hit[place % 2 == 0]
        a, b = (keys >> kind(half)).astype(np.uint32), (keys & kind((1 << half) - 1)).astype(np.uint32)
        size = lambda x: np.where(x < first, 1, lengths[np.where(x < first, 0, x - first)] if len(lengths) else 1)  # noqa: E731, B023
        grown = (size(a) + size(b)).astype(np.uint32)
        s[hit] = rule.astype(np.uint32) + np.uint32(first + len(left))
        stops = stops - np.searchsorted(hit + 1, stops, side="right")
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        s = s.take(np.flatnonzero(keep))
        near = None
        if not waiting:
            # all frequent pairs are gone and others only grew rarer: the next frequent ones hold one of these nonterminals
            new = hit - np.arange(len(hit))
            near = np.union1d(new, new - 1)
            near = near[(near >= 0) & (near < len(s) - 1)]
            near = near[~np.isin(near, stops)]
        left, right, lengths = np.r_[left, a], np.r_[right, b], np.r_[lengths, grown]
        ends.append(len(left))
    stops = np.r_[0, stops + 1]
    symbols = np.zeros(len(counts), np.int64)
    symbols[counts > 0] = np.diff(stops)
    wide = np.uint32 if len(s) and int(s.max()) >= 1 << 16 else np.uint16
    head = np.array([len(counts), len(left), len(ends), len(s), first, np.dtype(wide).itemsize], "<i8")
    return b"".join([MAGIC, head.tobytes(), *(x.astype("<u4").tobytes() for x in (left, right, lengths)), np.array(ends, "<i8").tobytes(), symbols.astype("<i8").tobytes(), s.astype(wide).tobytes()])


def _slot(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return (pair * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _run(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after the other."""
    return flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


class Shard:
    """Decodes a shard: all of it, one document, or a range of a document's ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self.docs, rules, rounds, n, self.first, width = np.frombuffer(data, "<i8", 6, 4).tolist()
        at = 4 + 48
        take = lambda kind, k: np.frombuffer(data, kind, k, at)
        self.left, at = take("<u4", rules), at + 4 * rules
        self.right, at = take("<u4", rules), at + 4 * rules
        self.lengths, at = take("<u4", rules), at + 4 * rules
        self.ends, at = take("<i8", rounds), at + 8 * rounds
        self.starts, at = np.r_[0, np.cumsum(take("<i8", self.docs))], at + 8 * self.docs
        self.symbols = take("<u2" if width == 2 else "<u4", n)
        self._table = None

    def _short(self) -> tuple[np.ndarray, np.ndarray]:
        """What each terminal and each rule of up to SHORT ids stands for, one after the other, and where each begins."""
        if self._table is None:
            flat, starts = np.arange(self.first, dtype=np.uint32), np.arange(self.first + len(self.left))
            for low, high in zip(np.r_[0, self.ends][:-1].tolist(), self.ends.tolist(), strict=True):
                rules = low + np.flatnonzero(self.lengths[low:high] <= SHORT)
                parts = np.stack([self.left[rules], self.right[rules]], 1).reshape(-1)  # symbols of the rounds before
                size = self.lengths[rules].astype(np.int64)
                starts[self.first + rules] = len(flat) + np.cumsum(size) - size
                flat = np.concatenate([flat, _run(flat, starts[parts], self.sizes(parts))])
            self._table = flat, starts
        return self._table

    def _expand(self, s: np.ndarray) -> np.ndarray:
        s = s.astype(np.uint32)
        while len(at := np.flatnonzero(self.sizes(s) > SHORT)):
            rule = s[at] - self.first
            s[at] = self.left[rule]
            s = np.insert(s, at + 1, self.right[rule])
        flat, starts = self._short()
        return _run(flat, starts[s], self.sizes(s))

    def sizes(self, s: np.ndarray) -> np.ndarray:
        """Expansion lengths of symbols."""
        s = s.astype(np.int64)
        return np.where(s < self.first, 1, self.lengths[np.maximum(s - self.first, 0)] if len(self.lengths) else 1).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        total = np.r_[0, np.cumsum(self.sizes(self.symbols))]
        return np.diff(total[self.starts])

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def part(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1 of document k: expands only the symbols that hold them."""
        s = self.symbols[self.starts[k] : self.starts[k + 1]]
        ends = np.cumsum(self.sizes(s))
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left") + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return self._expand(s[a:b])[skip : skip + max(0, hi - lo)]


_STORE = "part int, seq int, n_ids long, doc_ids array<long>, payload binary"


def _encode(path: str, end_id: int | None, shard_ids: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys, flats, sizes, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, keys, flats, sizes, held
            ids, counts = np.concatenate(flats), np.concatenate(sizes)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([compress(ids, counts, first)], pa.binary())]
            seq, keys, flats, sizes, held = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_ids", "doc_ids", "payload"])

        for b in slices(batches, "text"):
            flat, counts = enc.ids(b["text"].to_pylist())
            if end_id is not None:
                flat, counts = np.insert(flat, np.cumsum(counts), end_id), counts + 1
            if held and held + len(flat) > shard_ids:
                yield shard()
            keys += b["doc_id"].to_pylist()
            flats.append(flat)
            sizes.append(counts)
            held += len(flat)
        if keys:
            yield shard()

    return run


def write_store(docs: DataFrame, tokenizer: str, out: str, *, end_id: int | None = 2, shard_ids: int = 1_000_000) -> None:
    """Encodes every whole text, appends `end_id` to each document, and writes the shards to the folder `out`."""
    first = encoder(tokenizer).library.get_vocab_size(with_added_tokens=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(_encode(tokenizer, end_id, shard_ids, first), _STORE).write.parquet(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            shard = Shard(row["payload"])
            ids, counts = shard.ids().astype("<u4"), shard.counts()
            ends = np.r_[0, np.cumsum(counts)]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for k in range(0, len(crc), 5000):
                cut = slice(k, k + 5000)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][cut], pa.int64()), pa.array(row["before"] + ends[:-1][cut], pa.int64()), pa.array(counts[cut], pa.int64()), pa.array(crc[cut], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the whole store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""
    store = spark.read.schema(_STORE).parquet(path)
    # sums within each part, and over a row per part: as many as the writer had partitions
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", upto(W.orderBy("part")).alias("parts_before"))
    starts = store.select("part", "seq", "n_ids").withColumn("own", upto(W.partitionBy("part").orderBy("seq"))).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("own") + F.col("parts_before")).alias("before"))
    return store.join(starts, ["part", "seq"]).select("doc_ids", "payload", "before").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    out = table_path(docs.sparkSession, "repair-store")
    write_store(docs, tokenizer, out, **how)
    return read_index(docs.sparkSession, out)
