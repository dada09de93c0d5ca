"""Helpers that the training-data operators share: slices of batches and vectorised word hashing.

Word hashing works on the UTF-8 bytes of an Arrow column with a handful of NumPy passes per batch, so a word costs
nanoseconds and no Python object is made for it. A 64-bit polynomial over the bytes, finished by a mixing step, stands for
a word; where a false equality would change a result, two hashes with different bases are used together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..shared import table_path, written  # noqa: F401  used by the operators beside this module

#: The six ASCII separators of the word definition (space, tab, line feed, vertical tab, form feed, return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Text bytes that one NumPy pass takes; keeps the temporaries near the CPU caches and bounds a task's memory.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------------------------------------- Arrow helpers


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `limit` bytes in each; a longer value stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(data), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n + 1 offsets into them; null counts as empty."""
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(pa.large_string()).cast(kind), b"") if column.null_count else column.cast(pa.large_string()).cast(kind)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


# ---------------------------------------------------------------------------------------------- words


_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i < n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        b = _BASES[base]
        up, down = np.full(size, b, _U), np.full(size, _U(pow(int(b), -1, 1 << 64)), _U)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 4 * CHUNK_BYTES:  # tables for one very long text are not kept
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


#: The bytes that end a word where case and punctuation do not count: all ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, ends: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in all texts, and for each of n texts the index of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64)
    inside = ~separators[data]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power_tables(base, len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(((_LOWER[data] if lower else data).astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(_U))


def _parts(data: np.ndarray, ends: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK_BYTES that end at a separator or at a text's end, so that no word is cut."""
    at, reach = 0, 1 << 16
    while at < len(data):
        to = at + CHUNK_BYTES
        if to >= len(data):
            yield at, len(data)
            return
        text_end = int(ends[np.searchsorted(ends, to)])
        while to < text_end:
            here = np.flatnonzero(separators[data[to : min(to + reach, text_end)]])
            if len(here):
                to += int(here[0])
                break
            to = min(to + reach, text_end)
        yield at, to
        at = to


class Words:
    """The words of a column of texts: their spans in `data`, their hashes, and each text's first word (n + 1 values).

    Bytes are hashed in parts of about CHUNK_BYTES, so a long text costs its own size and 24 bytes a word, no more.
    """

    def __init__(self, column: pa.Array, bases: tuple[int, ...] = (0,), lower: bool = False, separators: np.ndarray = _SEP):
        self.data, self.ends = utf8(column)
        starts, stops, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[np.zeros(0, _U)] for _ in bases]
        for at, to in _parts(self.data, self.ends, separators):
            inner = self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, to)]
            part = self.data[at:to]
            s, e, _ = words(part, np.r_[0, inner - at, to - at], separators)
            starts.append(s + at)
            stops.append(e + at)
            for k, base in enumerate(bases):
                hashes[k].append(word_hashes(part, s, e, base, lower))
        self.starts, self.stops = np.concatenate(starts), np.concatenate(stops)
        self.hashes = [np.concatenate(h) for h in hashes]
        self.first = np.searchsorted(self.starts, self.ends)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie within one text, and for each text the index of its first window.

    A text of fewer words has none. Window j of a text starts at the text's word j.
    """
    counts = np.diff(first)
    out = np.zeros(max(0, len(hashes) - size + 1), _U)
    step = _BASES[base]
    for k in range(size):
        out *= step
        out += hashes[k : k + len(out)]
    full = np.maximum(counts - size + 1, 0)
    index = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=index[1:])
    keep = np.repeat(first[:-1] - index[:-1], full) + np.arange(index[-1])
    return mix(out[keep]), index
