"""Blocks of tokens, and the counts of their word n-grams over the whole table, given back to each block.

A text's words become tokens of a block: a written row that holds a few million tokens as places in the block's own list of
distinct words. A block asks for each of its distinct grams once: sorted 64-bit hashes, cut into cells by the hash, with the
block's own counts. All blocks' questions of a cell meet in one group; its answer is as long as the question and in its order, so
that no hash has to travel back: the counts over all blocks, and for each gram whether this block is the first that counts it
(sums over distinct grams are sums over these). Cells are ranges of a uniform hash and a block sends a gram once, however often it
holds it: a word that makes a third of all tokens is one row a block.

A text of more than a block's tokens is cut into segments, each with the few tokens before or after it that its grams need.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import SEPARATORS, Words, mix, slices, written

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Counts up to this one are told apart in the counts of counts.
COUNTED = 64


def table_of(separators: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, place by place of its items, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return struct.pack("<q", len(planes)) + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    size = struct.unpack_from("<q", data)[0]
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a gram and one more word after it."""
    return mix(gram * _STEP + word)


@dataclass
class Block:
    """Tokens of some segments of texts."""

    words: np.ndarray  # distinct hashes
    tokens: np.ndarray  # places in words
    broken: np.ndarray  # whether something stands between this token and the one before that no gram may span
    row: np.ndarray  # of each segment: a number of its row
    size: np.ndarray  # tokens
    own: np.ndarray  # (first, end) of the tokens that the segment does not share with its neighbours
    start: np.ndarray  # whether it begins its text
    label: list  # its row's label
    flag: np.ndarray  # its row's flag

    @property
    def hashes(self) -> np.ndarray:
        return self.words[self.tokens]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its segment, its place there, and whether it is the segment's own."""
        seg = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        return seg, at, (at >= self.own[seg, 0]) & (at < self.own[seg, 1])


_BLOCK = "block long, words binary, tokens binary, broken binary, row binary, size binary, own binary, start binary, label array<string>, flag binary, spelled array<string>"


def _blocks(separators: np.ndarray, breaks: np.ndarray | None, end: np.uint64 | None, before: int, after: int, most: int, spell: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, rows, held = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            nonlocal made, held
            h, broken, spans = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
            words, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small places, which pack well
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            spelled = None
            if spell:
                texts, which = [x[6] for x in held], np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
                at = first[order]
                spelled = [texts[k][s:e].tobytes().decode(errors="replace") for k, (s, e) in zip(which[at].tolist(), spans[at].tolist(), strict=True)]
            meta = [x[3] for x in held]
            made += 1
            values = [
                (task << 33) + made - 1,
                pack(words[order]),
                pack(place[inverse]),
                np.packbits(broken).tobytes(),
                pack(np.array([m[0] for m in meta], np.int64)),
                pack(np.array([len(x[0]) for x in held], np.int64)),
                pack(np.array([m[1:3] for m in meta], np.int64).reshape(-1)),
                np.packbits([m[3] for m in meta]).tobytes(),
                [x[4] for x in held],
                np.packbits([bool(x[5]) for x in held]).tobytes(),
                spelled,
            ]
            kinds = [pa.int64(), *[pa.binary()] * 7, pa.list_(pa.string()), pa.binary(), pa.list_(pa.string())]
            held = []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        waiting = 0
        for b in slices(batches, "text"):
            w = Words(b["text"], lower=True, separators=separators)
            low = w.data.copy() if spell else None
            if spell:
                upper = (low >= 65) & (low <= 90)
                low[upper] += 32
            marks = np.flatnonzero(breaks[w.data]) if breaks is not None else None
            labels, flags = b["label"].to_pylist(), b["flag"].to_pylist()
            salts = b["salt"].to_pylist()
            for k, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                h = w.hashes[0][a:z] if not salts[k] else mix(w.hashes[0][a:z] ^ _U(salts[k] % 2**64))
                spans = np.stack([w.starts[a:z], w.stops[a:z]], 1)
                broken = np.zeros(z - a, bool)
                if marks is not None and z > a:
                    broken[1:] = np.searchsorted(marks, spans[1:, 0]) != np.searchsorted(marks, spans[:-1, 1])
                if end is not None:
                    h, broken, spans = np.r_[h, end], np.r_[broken, False], np.r_[spans, [[0, 0]]]
                row = (task << 33) + rows
                rows += 1
                for at in range(0, max(1, len(h)), most):
                    lo, to = max(0, at - before), min(len(h), at + most)
                    hi = min(len(h), to + after)
                    if waiting and waiting + hi - lo > most:
                        yield block()
                        waiting = 0
                    held.append((h[lo:hi], broken[lo:hi], spans[lo:hi], (row, at - lo, to - lo, at == 0), labels[k], flags[k], low))
                    waiting += max(1, hi - lo)
        if held:
            yield block()

    return run


def token_blocks(docs: DataFrame, *, separators: tuple[int, ...] = SEPARATORS, breaks: tuple[int, ...] = (), end: np.uint64 | None = None, before: int = 0, after: int = 0, block_tokens: int = 1 << 20, spell: bool = False) -> DataFrame:
    """The blocks of docs (text, label string, flag boolean, salt long), a written table.

    Words are lower-cased (A-Z) and cut at separators; breaks are separators that no gram may span; `end` is a token's hash that every
    text gets at its end; a segment shares `before` and `after` tokens with its neighbours; a salt other than null makes words of rows
    with another salt other words; `spell` keeps the words.
    """
    run = _blocks(table_of(separators + breaks), table_of(breaks) if breaks else None, end, before, after, block_tokens, spell)
    return written(docs.select("text", "label", "flag", "salt").mapInArrow(run, _BLOCK), "token-blocks")


def block_of(row: dict) -> Block:
    tokens = unpack(row["tokens"], np.uint32)
    n = len(unpack(row["size"], np.int64))
    bits = lambda c, m: np.unpackbits(np.frombuffer(row[c], np.uint8), count=m).astype(bool)
    return Block(
        unpack(row["words"], np.uint64), tokens, bits("broken", len(tokens)), unpack(row["row"], np.int64), unpack(row["size"], np.int64), unpack(row["own"], np.int64).reshape(n, 2), bits("start", n), row["label"], bits("flag", n)
    )


# ---------------------------------------------------------------------------------------------- questions and answers

#: A level's grams of a block: the hash at each token, whether there is a gram, and how much it counts there.
Grams = tuple[np.ndarray, np.ndarray, np.ndarray]


def _cells(sorted_hashes: np.ndarray, cells: int) -> np.ndarray:
    """Where each cell's hashes begin; cells are equal ranges of the hash."""
    lows = [-(-(c << 64) // cells) for c in range(cells)]
    return np.r_[np.searchsorted(sorted_hashes, np.array(lows, np.uint64)), len(sorted_hashes)]


def _ask(grams: Callable[[Block], list[Grams]], cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for level, (h, there, weight) in enumerate(grams(block_of(row)), 1):
                    asked, inverse = np.unique(h[there], return_inverse=True)
                    own = np.bincount(inverse, weight[there], len(asked)).astype(np.int64)
                    at = _cells(asked, cells)
                    some = np.flatnonzero(at[1:] > at[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64())]
                        + [pa.array([pack(x[at[c] : at[c + 1]]) for c in some.tolist()], pa.binary()) for x in (asked, own)],
                        ["level", "cell", "block", "asked", "own"],
                    )

    return run


def _answer(t: pa.Table) -> pa.Table:
    t = t.sort_by("block")
    parts = [unpack(x, np.uint64) for x in t["asked"].to_pylist()]
    own = np.concatenate([unpack(x, np.int64) for x in t["own"].to_pylist()])
    grams, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, inverse, own)
    counting = np.flatnonzero(own > 0)
    _, first_of = np.unique(inverse[counting], return_index=True)  # rows stand in the order of blocks
    first = np.zeros(len(inverse), bool)
    first[counting[first_of]] = True
    ends = np.r_[0, np.cumsum([len(p) for p in parts])]
    cut = [slice(a, z) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    seen = total[total > 0]
    of_counts = np.bincount(np.minimum(seen, COUNTED + 1), minlength=COUNTED + 2).tolist() + [int(seen.sum())]
    n = len(cut)
    return pa.table(
        {
            "level": pa.array(t["level"].to_pylist() + [t["level"][0].as_py()], pa.int32()),
            "cell": pa.array(t["cell"].to_pylist() + [t["cell"][0].as_py()], pa.int32()),
            "block": pa.array([*t["block"].to_pylist(), -1], pa.int64()),
            "total": pa.array([pack(total[inverse[c]]) for c in cut] + [None], pa.binary()),
            "first": pa.array([np.packbits(first[c]).tobytes() for c in cut] + [None], pa.binary()),
            "stats": pa.array([None] * n + [of_counts], pa.list_(pa.int64())),
        }
    )


def counts(blocks: DataFrame, grams: Callable[[Block], list[Grams]]) -> DataFrame:
    """The answers to all blocks, a written table; `grams` gives the levels' grams of a block."""
    cells = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.drop("spelled").mapInArrow(_ask(grams, cells), "level int, cell int, block long, asked binary, own binary")
    return written(asked.groupBy("level", "cell").applyInArrow(_answer, "level int, cell int, block long, total binary, first binary, stats array<long>"), "gram-counts")


def counts_of_counts(answers: DataFrame) -> dict[int, list[int]]:
    """For each level how many distinct grams count 0, 1, .., COUNTED, more than that, and the sum of all counts."""
    rows = answers.filter("block = -1").select("level", F.posexplode("stats").alias("r", "n")).groupBy("level", "r").agg(F.sum("n").alias("n")).collect()
    levels = max((r["level"] for r in rows), default=0)
    found = {(r["level"], r["r"]): r["n"] for r in rows}
    return {k: [found.get((k, r), 0) for r in range(COUNTED + 3)] for k in range(1, levels + 1)}


def answered(block: Block, grams: list[Grams], answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the count of each token's gram (0 where there is none), and the tokens and hashes of the grams that this block
    counts first, a token for each."""
    out, answers = [], answers.sort_by([("level", "ascending"), ("cell", "ascending")])
    levels = np.array(answers["level"].to_pylist(), np.int64)
    for level, (h, there, _) in enumerate(grams, 1):
        asked, at, inverse = np.unique(h[there], return_index=True, return_inverse=True)
        own = np.flatnonzero(levels == level).tolist()
        total = [unpack(answers["total"][k].as_py(), np.int64) for k in own]
        first = [np.unpackbits(np.frombuffer(answers["first"][k].as_py(), np.uint8), count=len(n)).astype(bool) for k, n in zip(own, total, strict=True)]
        n = np.zeros(len(h), np.int64)
        if len(asked):
            n[there] = np.concatenate(total)[inverse]
        new = np.concatenate(first) if first else np.zeros(0, bool)
        out.append((n, np.flatnonzero(there)[at[new]], asked[new]))
    return out


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block's row, its answers) for every block."""

    def both(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist()[0], right)

    told = answers.filter("block >= 0").select("block", "level", "cell", "total", "first")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(both, schema)
