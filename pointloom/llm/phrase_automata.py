"""Substring dedup with repeated-phrase automata: every word that an earlier passage of `span` words already holds goes.

Documents are dealt by a hash into blocks of bounded text; all steps below work on blocks, and rows between them are packed.

1. Phrases. Each window of 20 words names one of its eleven 10-word phrases, the one with the smallest hash: equal windows
   name equal phrases at the same place, wherever they stand. A block sends each distinct phrase once; a phrase named only
   once in the corpus belongs to no repeated window.
2. Passages. For each recurring phrase a block sends the distinct runs of at most thirty words that its windows cover, dealt
   by the phrase's hash, so that all occurrences of a window meet. There recurring windows are confirmed by a second 64-bit hash
   and joined to maximal passages: neighbours stay together if they stand together wherever either stands. A block is told its
   passages, each by one place where it stands in the block, and whether that place is the first of the corpus (by doc_id, then
   start).
3. Automata. Each block compiles its passages into Aho-Corasick automata of bounded size, words being single letters, and
   streams all its documents, whole, through them. This alone finds where a passage stands; a hit counts if a 64-bit hash of
   its words is the passage's. All occurrences but the corpus' first are marked, and words in marked passages are removed.

Work and traffic grow with the corpus, not with its square: a document meets the automata of its own block only, and these hold
what recurs in it. A phrase or passage that a third of all documents share is one row for each block. A phrase that over
`hot_blocks` blocks name, in ever other surroundings, is not dealt as one group: its windows go each by its own hash.

Cases: a null text has no words; rows that repeat both doc_id and text are one document and get the same result; rows that
repeat a doc_id with other texts are told apart by a hash of the text; null doc_ids come first; a long text is hashed in parts
and never copied as separate words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Words, mix, slices, window_hashes

_U = np.uint64
_NONE = -(1 << 63)  # stands for a null doc_id, which comes first
#: Words of a text whose windows are handled at once.
_RANGE = 1 << 18
#: Letters that stand for words. Few, as a node's children are searched one by one; a hit's words are confirmed by their hash.
_LETTERS = 64
_STEP = _U(0x9E3779B97F4A7C15)


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of each run of `width` values of g."""
    v, at, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        right = v[step:] < v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


class _Runs:
    """The runs of a batch's windows that name one occurrence of a phrase: text, first window, number of windows, phrase hash."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, span: int):
        half = span // 2
        g, index = window_hashes(hashes, first, half)
        width = span - half + 1
        full = np.maximum(np.diff(index) - width + 1, 0)
        ends = np.r_[0, np.cumsum(full)]
        doc = np.repeat(np.arange(len(full)), full)
        start = np.arange(ends[-1]) - ends[doc]
        at = _smallest(g, width)[index[doc] + start] if len(doc) else np.zeros(0, np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
        self.window = np.flatnonzero(new)  # the run's first window among all of the batch
        self.doc, self.start = doc[self.window], start[self.window]
        self.n = np.diff(np.r_[self.window, len(doc)])
        self.phrase = g[at[self.window]]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _virtual(w: Words, span: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of words whose windows are handled at once: (their place, first words within, texts, words before them in the text)."""
    texts, counts = len(w.first) - 1, np.diff(w.first)
    if len(w.starts) <= 2 * _RANGE:
        yield slice(0, len(w.starts)), w.first, np.arange(texts), np.zeros(texts, np.int64)
        return
    for k in range(texts):
        for at in range(0, max(int(counts[k]) - span + 1, 0), _RANGE):
            lo, hi = int(w.first[k]) + at, min(int(w.first[k]) + at + _RANGE + span - 1, int(w.first[k + 1]))
            yield slice(lo, hi), np.array([0, hi - lo]), np.array([k]), np.array([at])


def _deal(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by shard, the shards, and the offsets of their places in that order."""
    p = ((h >> _U(20)) % _U(shards)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    keys = p[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, keys[cut], np.r_[cut, len(keys)]


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by p, as a table for each p."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        p = b["p"].to_numpy()
        cuts = np.r_[0, 1 + np.flatnonzero(p[1:] != p[:-1]), len(p)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and p[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = p[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _flat(t: pa.Table, column: str) -> np.ndarray:
    parts = [c.flatten() for c in t[column].chunks]
    return np.concatenate([x.to_numpy(zero_copy_only=False) for x in parts]) if parts else np.zeros(0, np.int64)


def _sizes(t: pa.Table, column: str) -> np.ndarray:
    parts = [np.diff(c.offsets.to_numpy()) for c in t[column].chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# ---------------------------------------------------------------------------------------------- phrases

_PHRASES = "p int, block int, phrase array<long>, many array<boolean>"
_TOLD = "block int, phrase array<long>, hot array<boolean>"


def _phrases(span: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        found = [np.zeros(0, _U)]
        seen: set[int] = set()
        for b in slices(t.to_batches(), "text"):
            b = _new_rows(b, seen)
            w = Words(b["text"])
            for place, first, _, _ in _virtual(w, span):
                found.append(_Runs(w.hashes[0][place], first, span).phrase)
        phrase, count = np.unique(np.concatenate(found), return_counts=True)
        order, p, ends = _deal(phrase, shards)
        block = np.full(len(p), t["block"][0].as_py())
        cols = pa.array(p, pa.int32()), pa.array(block, pa.int32()), _list(phrase[order].view(np.int64), ends, pa.int64()), _list((count > 1)[order], ends, pa.bool_())
        return pa.table(cols, ["p", "block", "phrase", "many"])

    return run


def _new_rows(b: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows whose key (doc_id and text) has not come before: rows that repeat are one document."""
    keep = []
    for k in b["key"].to_pylist():
        keep.append(k not in seen)
        seen.add(k)
    return b if all(keep) else b.filter(pa.array(keep))


def _recurring(hot_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_shard(batches):
            block = np.repeat(t["block"].to_numpy(), _sizes(t, "phrase"))
            phrase = _flat(t, "phrase")
            _, back, seen = np.unique(phrase, return_inverse=True, return_counts=True)
            known = np.zeros(len(seen), bool)
            known[back[_flat(t, "many").astype(bool)]] = True
            keep = np.flatnonzero(((seen > 1) | known)[back])
            if len(keep):
                hot = (seen > hot_blocks)[back[keep]]
                yield from _packed(block[keep], {"phrase": (phrase[keep], pa.int64()), "hot": (hot, pa.bool_())})

    return run


def _packed(block: np.ndarray, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """A row for each block (rows of one block stand together), with its values as lists."""
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[cut, len(block)]
    yield pa.RecordBatch.from_arrays([pa.array(block[cut], pa.int32()), *(_list(v, ends, kind) for v, kind in columns.values())], ["block", *columns])


# ---------------------------------------------------------------------------------------------- passages

_SENT = "p int, block int, doc array<long>, key array<long>, start array<int>, n array<int>, count array<int>, check array<long>"
_NOTHING = pa.schema([("p", pa.int32()), ("block", pa.int32()), *((c, pa.list_(k)) for c, k in zip(("doc", "key", "start", "n", "count", "check"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True))]).empty_table()
_PASSAGES = "block int, key array<long>, start array<int>, n array<int>, earliest array<boolean>"


def _send(span: int, shards: int):
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        phrase, hot = _flat(told, "phrase").view(_U), _flat(told, "hot").astype(bool)
        order = np.argsort(phrase)
        phrase, hot = phrase[order], hot[order]
        parts, checks, seen = [], [np.zeros(0, _U)], set()
        for b in slices(t.to_batches(), "text") if len(phrase) else ():
            b = _new_rows(b, seen)
            w = Words(b["text"], bases=(0, 1))
            ids, keys = b["doc_id"].fill_null(_NONE).to_numpy(), b["key"].to_numpy()
            for place, first, texts, before in _virtual(w, span):
                r = _Runs(w.hashes[0][place], first, span)
                at = np.minimum(np.searchsorted(phrase, r.phrase), len(phrase) - 1)
                hit = phrase[at] == r.phrase
                window, doc, start, n, name, one = (x[hit] for x in (r.window, r.doc, r.start, r.n, r.phrase, hot[at]))
                check, _ = window_hashes(w.hashes[1][place], first, span, base=1)
                alone = np.repeat(one, n)  # a hot phrase's windows go one by one
                pick = _ranges(window, n)
                head = np.ones(len(pick), bool)
                head[np.arange(len(pick))] = alone
                head[np.cumsum(n) - n] = True
                lead = np.flatnonzero(head)
                run_of = np.repeat(np.arange(len(n)), n)[lead]
                offset = pick[lead] - window[run_of]
                parts.append((ids[texts[doc[run_of]]], keys[texts[doc[run_of]]], start[run_of] + offset + before[doc[run_of]], np.diff(np.r_[lead, len(pick)]), np.where(one[run_of], check[pick[lead]], name[run_of])))
                checks.append(check[pick])
        if not parts:
            return _NOTHING
        doc, key, start, n, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        check = np.concatenate(checks)
        at = np.cumsum(n) - n
        # equal runs of the block are one, at the first of their places
        order = np.lexsort((start, key, doc, n, check[at + n - 1], check[at], name))
        same = [x[order] for x in (name, check[at], check[at + n - 1], n)]
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in same])])
        count = np.diff(np.r_[new, len(order)])
        order = order[new]
        deal, p, ends = _deal(name[order], shards)
        order, count = order[deal], count[deal]
        total = np.r_[0, np.cumsum(n[order])][ends]
        block = np.full(len(p), t["block"][0].as_py())
        lists = [_list(x[order], ends, k) for x, k in ((doc, pa.int64()), (key, pa.int64()), (start, pa.int32()), (n, pa.int32()))]
        cols = [pa.array(p, pa.int32()), pa.array(block, pa.int32()), *lists, _list(count, ends, pa.int32()), _list(check[_ranges(at[order], n[order])].view(np.int64), total, pa.int64())]
        return pa.table(cols, ["p", "block", "doc", "key", "start", "n", "count", "check"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard the maximal passages whose windows recur, for each block that holds them."""
    for t in _by_shard(batches):
        block = np.repeat(t["block"].to_numpy(), _sizes(t, "n"))
        doc, key, start, n, count, check = (_flat(t, c) for c in ("doc", "key", "start", "n", "count", "check"))
        at = np.cumsum(n) - n
        order = np.lexsort((start, key, doc))  # runs in the order of the corpus, so that a window's first place comes first
        check = check[_ranges(at[order], n[order])]
        block, doc, key, start, n, count = (x[order] for x in (block, doc, key, start, n, count))
        owner = np.repeat(np.arange(len(n)), n)
        _, first, back = np.unique(check, return_index=True, return_inverse=True)
        total = np.bincount(back, count[owner]).astype(np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])  # windows that have a next one in their run
        both, pair = np.unique(back[inner] * len(total) + back[inner + 1], return_inverse=True)
        together = np.bincount(pair, count[owner[inner]], len(both)).astype(np.int64)[pair]
        joined = np.zeros(len(check), bool)  # to the window before it
        joined[inner + 1] = (total[back[inner]] == together) & (total[back[inner + 1]] == together)
        often = total[back] > 1
        lead = np.flatnonzero(often & ~joined)
        if not len(lead):
            continue
        last = np.append(np.flatnonzero(~joined)[1:], len(check))
        length = last[np.searchsorted(np.flatnonzero(~joined), lead)] - lead
        run = owner[lead]
        window = lead - (np.cumsum(n) - n)[run]
        earliest = first[back[lead]] == lead
        by = np.argsort(block[run], kind="stable")
        yield from _packed(block[run][by], {"key": (key[run][by], pa.int64()), "start": ((start[run] + window)[by], pa.int32()), "n": (length[by], pa.int32()), "earliest": (earliest[by], pa.bool_())})


# ---------------------------------------------------------------------------------------------- automata


def _letters(hashes: np.ndarray) -> np.ndarray:
    """A letter for each word; equal words have equal ones."""
    return (hashes % _U(_LETTERS)).astype(np.uint8) + np.uint8(2)


class _Sums:
    """Hashes of any range of words."""

    def __init__(self, hashes: np.ndarray):
        power = np.full(len(hashes) + 1, _STEP, _U)
        back = np.full(len(hashes) + 1, _U(pow(int(_STEP), -1, 1 << 64)), _U)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.total = np.r_[_U(0), np.cumsum(hashes * np.cumprod(power)[:-1])]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.back[lo])


class _Passages:
    """A block's passages, spelt, with their hashes and the place that keeps its words, if it is in this block."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hash: list[int] = []
        self.kept: list[tuple[int, int]] = []  # (key, start); no key for passages that stand earlier in another block

    def add(self, text: str, value: int, key: int | None, start: int) -> None:
        k = self.number.setdefault(text, len(self.hash))
        while k < len(self.hash) and self.hash[k] != value:  # other words with the same letters
            text += "\1"
            k = self.number.setdefault(text, len(self.hash))
        if k == len(self.hash):
            self.hash.append(value)
            self.kept.append((key, start))
        elif key is not None:
            self.kept[k] = key, start

    def automata(self, limit: int) -> Iterator:
        """Automata of passages of about `limit` words together."""
        import ahocorasick

        held, size = ahocorasick.Automaton(ahocorasick.STORE_ANY), 0
        alike: dict[str, list[int]] = {}
        for text, k in self.number.items():
            alike.setdefault(text.rstrip("\1"), []).append(k)
        for text, ks in alike.items():
            held.add_word(text, (len(text), ks))
            size += len(text)
            if size >= limit:
                held.make_automaton()
                yield held
                held, size = ahocorasick.Automaton(ahocorasick.STORE_ANY), 0
        if size:
            held.make_automaton()
            yield held


def _remove(span: int, clean_as_is: bool, passing: tuple[str, ...], automaton_words: int):
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        batches = list(slices(t.to_batches(), "text"))
        passages = _Passages()
        where: dict[int, list[tuple[int, int, bool]]] = {}
        for key, start, n, earliest in zip(*(_flat(told, c).tolist() for c in ("key", "start", "n", "earliest")), strict=True):
            where.setdefault(key, []).append((start, n + span - 1, bool(earliest)))
        for b in batches if where else ():
            at = [(k, key) for k, key in enumerate(b["key"].to_pylist()) if key in where]
            if not at:
                continue
            w = Words(b["text"].take(pa.array([k for k, _ in at])))
            sums, text = _Sums(w.hashes[0]), _letters(w.hashes[0]).tobytes().decode()
            for first, (_, key) in zip(w.first.tolist(), at, strict=False):
                places = where.pop(key, ())  # a row that repeats it has the same words
                lo = np.array([first + s for s, _, _ in places], np.int64)
                hi = lo + np.array([n for _, n, _ in places], np.int64)
                for (s, _, earliest), a, z, value in zip(places, lo.tolist(), hi.tolist(), sums.of(lo, hi).tolist(), strict=True):
                    passages.add(text[a:z], value, key if earliest else None, s)
        hashes = np.array(passages.hash, _U)
        automata = list(passages.automata(automaton_words))
        out = []
        for b in batches:
            w = Words(b["text"])
            gone = np.zeros(len(w.starts) + 1, np.int32)
            if automata:
                _mark(w, b["key"].to_numpy(), automata, passages, hashes, gone)
            out.append(_cut(b, w, np.cumsum(gone[:-1]) > 0, clean_as_is, passing))
        return pa.Table.from_batches(out)

    return run


def _mark(w: Words, keys: np.ndarray, automata: list, passages: _Passages, hashes: np.ndarray, gone: np.ndarray) -> None:
    """Streams the texts through the automata; adds 1 to `gone` where a passage that goes begins and takes 1 where it ends."""
    texts = len(w.first) - 1
    # a mark that no passage holds stands between texts
    shift = np.repeat(np.arange(texts), np.diff(w.first))
    code = np.full(len(w.starts) + texts, 1, np.uint8)
    code[np.arange(len(w.starts)) + shift] = _letters(w.hashes[0])
    text = code.tobytes().decode()
    sums = _Sums(w.hashes[0])
    mark_at = w.first[1:] + np.arange(texts)  # places of the marks
    for automaton in automata:
        found = [(end, n, k) for end, (n, ks) in automaton.iter(text) for k in ks]
        if not found:
            continue
        end, n, which = np.array(found, np.int64).T
        doc = np.searchsorted(mark_at, end)
        hi = end + 1 - doc
        lo = hi - n
        sure = sums.of(lo, hi) == hashes[which]
        lo, hi, which, doc = lo[sure], hi[sure], which[sure], doc[sure]
        start = lo - w.first[doc]
        kept = [passages.kept[k] for k in which.tolist()]
        stays = np.array([a == key and b == s for (a, b), key, s in zip(kept, keys[doc].tolist(), start.tolist(), strict=True)], bool)
        np.add.at(gone, lo[~stays], 1)
        np.add.at(gone, hi[~stays], -1)


def _cut(b: pa.RecordBatch, w: Words, gone: np.ndarray, clean_as_is: bool, passing: tuple[str, ...]) -> pa.RecordBatch:
    """The rows with their numbers of words and the texts of the words that stay, joined by one space."""
    texts = len(w.first) - 1
    doc = np.repeat(np.arange(texts), np.diff(w.first))
    removed = np.bincount(doc[gone], minlength=texts)
    stay = np.flatnonzero(~gone)
    more = np.zeros(len(stay), bool)
    more[:-1] = doc[stay][1:] == doc[stay][:-1]  # another word of the text follows
    data = w.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.starts[stay]] += 1
    edge[w.stops[stay]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    spaces = w.stops[stay][more]
    keep[spaces] = True
    data[spaces] = 0x20
    ends = np.r_[0, np.cumsum(keep)][w.ends]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(data[keep].tobytes())]).cast(pa.large_string())
    if clean_as_is:
        kept = pc.if_else(pa.array(removed > 0), kept, b["text"].cast(pa.large_string()))
    columns = [b[c] for c in ("doc_id", *passing)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), kept.cast(pa.string())], ["doc_id", *passing, "n_words", "n_removed", "kept_text"])


def remove_repeats(
    docs: DataFrame,
    *,
    span: int = 20,
    passing: tuple[str, ...] = (),
    clean_as_is: bool = False,
    block_bytes: tuple[int, int] = (1 << 20, 1 << 23),
    hot_blocks: int = 4096,
    automaton_words: int = 1 << 20,
) -> DataFrame:
    """doc_id, the columns `passing`, n_words, n_removed and kept_text of every document.

    kept_text: the kept words joined by one space; with `clean_as_is` a text that loses nothing stays as it was. A block holds
    a 4096th of all text, but at least and at most `block_bytes`; none of the last three parameters changes a result.
    """
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, size // min(block_bytes[1], max(block_bytes[0], size // 4096)))
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "key": F.xxhash64("text", F.col("doc_id").cast("long"))})
    docs = docs.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "doc_id", *passing, "text")
    # every step takes the same columns, dealt in the same way: Spark reuses the exchange
    held = docs.groupBy("block")
    phrases = held.applyInArrow(_phrases(span, shards), _PHRASES)
    told = phrases.repartition("p").sortWithinPartitions("p").mapInArrow(_recurring(hot_blocks), _TOLD)
    sent = held.cogroup(told.groupBy("block")).applyInArrow(_send(span, shards), _SENT)
    passages = sent.repartition("p").sortWithinPartitions("p").mapInArrow(_confirm, _PASSAGES)
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*docs.drop("block", "key", "text").schema, *more])
    return held.cogroup(passages.groupBy("block")).applyInArrow(_remove(span, clean_as_is, passing, automaton_words), schema)
