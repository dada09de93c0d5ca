"""Collocations: phrases of 2 to 5 words and their scores, counted by multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z) and cut into pieces at marks and line ends, pieces into words at spaces and tabs. Everything is per
language: a word's hash is mixed with its language's, so words of two languages never meet.

1. Routing by leading words. `gram_counts` counts single words and pairs over the whole table, each pair once a block. A pair that is
   too rare is abandoned, with all longer phrases that hold it.
2. Suffixes. Where a pair that goes on leads, a block takes the suffix of up to five words, as long as its pairs go on. Equal ones
   of a block are one row with a number. They are routed to cells by their first three words.
3. Multikey quicksort. A cell holds pointers to suffixes and splits them three ways by the word at a depth: those before a pivot, equal
   to it, and after it; the equal ones go on at the next depth, to the last. The weight of an equal part is its phrase's
   count; a part whose weight is below the least count is abandoned, unsorted.

Counts of phrases are then a table. Each cut of a candidate joins the counts of its two parts; scores are exact decimals of 38
digits. A candidate goes if a longer one with the same count holds it: some phrase one word longer then has that count too, as
counts can only fall on the way, so two joins tell. The best of each language are found in two steps, by salted groups first.

Cases: a null text is empty; a null language is `und`; rows that repeat count as often as they stand; long texts are cut into segments
that share four words; an empty table gives an empty one; equal scores go by count, then by the phrase's bytes; other columns
are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import gram_counts as G
from .common import written

#: What separates words within a piece, and what ends a piece.
SPACES = (0x20, 0x09)
ENDS = (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
#: Words of the longest phrase, and of those that route a suffix.
DEPTH, LEADING = 5, 3


def _pairs(b: G.Block) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token and the next one, and whether they are a pair of one piece."""
    h, (seg, _, _) = b.hashes, b.segments()
    out, there = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    out[:-1] = G.longer(h[:-1], h[1:])
    there[:-1] = (seg[1:] == seg[:-1]) & ~b.broken[1:]
    return out, there


def _grams(b: G.Block) -> list[G.Grams]:
    _, _, own = b.segments()
    pair, there = _pairs(b)
    return [(b.hashes, np.ones(len(own), bool), own.astype(np.int64)), (pair, there, own.astype(np.int64))]


def quicksort(words: np.ndarray, weight: np.ndarray, least: int, shortest: int) -> Iterator[tuple[np.ndarray, int]]:
    """Phrases of at least `shortest` words that begin a suffix (a row of words, 0 after its end), and their weights, if at least `least`."""
    parts = [(np.arange(len(words)), 0)]
    while parts:
        at, depth = parts.pop()
        if weight[at].sum() < least:
            continue
        key = words[at, depth]
        pivot = key[len(key) // 2]
        equal = at[key == pivot]
        if len(equal) < len(at):
            parts += [(at[key < pivot], depth), (at[key > pivot], depth)]
        total = int(weight[equal].sum())
        if pivot and total >= least:
            if depth + 1 >= shortest:
                yield words[equal[0], : depth + 1], total
            if depth + 1 < words.shape[1]:
                parts.append((equal, depth + 1))


_PHRASE = "a long, words array<long>, gram long, heads array<long>, tails array<long>"


def _phrases(words: np.ndarray, count: np.ndarray) -> dict[str, pa.Array]:
    """Columns of phrases of one length (a row of words each): hashes of the whole, of its first 1, 2, .. words and of the rest."""
    m = words.shape[1]
    fold = lambda a, z: words[:, a] if z == a + 1 else G.longer(fold(a, z - 1), words[:, z - 1])
    lists = lambda cols: pa.array(list(np.stack(cols, 1).view(np.int64)), pa.list_(pa.int64()))
    return {
        "a": pa.array(count, pa.int64()),
        "words": lists([words[:, k] for k in range(m)]),
        "gram": pa.array(fold(0, m).view(np.int64)),
        "heads": lists([fold(0, k) for k in range(1, m)]),
        "tails": lists([fold(k, m) for k in range(1, m)]),
    }


_OUT = f"kind string, lang string, word long, spelled string, {_PHRASE}, cell int, suffixes binary"
_KINDS = {
    "kind": pa.string(), "lang": pa.string(), "word": pa.int64(), "spelled": pa.string(), "a": pa.int64(), "words": pa.list_(pa.int64()), "gram": pa.int64(), "heads": pa.list_(pa.int64()), "tails": pa.list_(pa.int64()),
    "cell": pa.int32(), "suffixes": pa.binary(),
}


def _rows(n: int, **columns) -> pa.Table:
    return pa.table({c: (columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(n, t) for c, t in _KINDS.items()})


def _suffixes(least: int, cells: int):
    def run(row: dict, answers: pa.Table) -> pa.Table:
        b = G.block_of(row)
        (c1, first1, g1), (c2, first2, _) = G.answered(b, _grams(b), answers)
        seg, _, own = b.segments()
        h = b.hashes
        langs = np.array(b.label, object)[seg] if len(seg) else np.zeros(0, object)
        out = []
        names, which = np.unique(np.array(b.label, object).astype(str), return_inverse=True)
        n = np.bincount(which[seg[own]], minlength=len(names))
        out.append(_rows(len(names), kind=["total"] * len(names), lang=names.tolist(), a=n))
        often = first1[c1[first1] >= least]
        out.append(_rows(len(often), kind=["word"] * len(often), lang=langs[often].tolist(), word=h[often].view(np.int64), spelled=[row["spelled"][k] for k in b.tokens[often].tolist()], a=c1[often]))
        pair = first2[c2[first2] >= least]
        if len(pair):
            out.append(_rows(len(pair), kind=["phrase"] * len(pair), lang=langs[pair].tolist(), **_phrases(np.stack([h[pair], h[pair + 1]], 1), c2[pair])))
        # suffixes that start here and go on while pairs do
        goes = c2 >= least
        long = np.ones(len(h), np.int64)
        alive = np.ones(len(h), bool)
        for k in range(1, DEPTH):
            step = np.zeros(len(h), bool)
            step[: max(0, len(h) - k + 1)] = goes[k - 1 :]
            alive &= step
            long += alive
        start = np.flatnonzero(own & (long >= LEADING))
        if len(start):
            words = np.zeros((len(start), DEPTH), np.uint64)
            for k in range(DEPTH):
                some = long[start] > k
                words[some, k] = h[start[some] + k]
            lead = words[:, 0]
            for k in range(1, LEADING):
                lead = G.longer(lead, words[:, k])
            whole = lead
            for k in range(LEADING, DEPTH):
                whole = G.longer(whole, words[:, k])
            _, at, times = np.unique(whole, return_index=True, return_counts=True)
            words, lead = words[at], lead[at]
            lang = which[seg[start[at]]]
            cell = (lead % np.uint64(cells)).astype(np.int64)
            for l in range(len(names)):  # a block has a few languages at most
                own_cells = np.where(lang == l, cell, -1)
                order = np.argsort(own_cells, kind="stable")
                ends = np.searchsorted(own_cells[order], np.arange(cells + 1))
                some = np.flatnonzero(np.diff(ends))
                packed = [G.pack(np.c_[words[o], times[o].astype(np.uint64)[:, None]].reshape(-1)) for o in (order[ends[c] : ends[c + 1]] for c in some.tolist())]
                out.append(_rows(len(some), kind=["suffix"] * len(some), lang=[str(names[l])] * len(some), cell=some, suffixes=packed))
        return pa.concat_tables(out)

    return run


def _sorted(least: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = np.concatenate([G.unpack(x, np.uint64).reshape(-1, DEPTH + 1) for x in t["suffixes"].to_pylist()])
        by_length: dict[int, tuple[list, list]] = {}
        for words, count in quicksort(rows[:, :DEPTH], rows[:, DEPTH].astype(np.int64), least, LEADING):
            have = by_length.setdefault(len(words), ([], []))
            have[0].append(words)
            have[1].append(count)
        names = ["lang", "a", "words", "gram", "heads", "tails"]
        out = [pa.table({c: pa.array([], _KINDS[c]) for c in names})]
        for words, count in by_length.values():
            out.append(pa.table({"lang": pa.array([key[0].as_py()] * len(count), pa.string()), **_phrases(np.stack(words), np.array(count))}))
        return pa.concat_tables(out)

    return run


def phrase_counts(docs: DataFrame, *, least: int = 100, block_tokens: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang, a, words, gram, heads, tails: hashes) of 2 to 5 words that stand `least` times or more, such single words (lang,
    word, spelled, a), and each language's number of words (lang, n)."""
    lang = F.coalesce("lang", F.lit("und"))
    rows = docs.select("text", lang.alias("label"), F.lit(True).alias("flag"), F.xxhash64(lang).alias("salt"))
    blocks = G.token_blocks(rows, separators=SPACES, breaks=ENDS, after=DEPTH - 1, block_tokens=block_tokens, spell=True)
    answers = G.counts(blocks, _grams)
    cells = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(G.with_answers(blocks, answers, _suffixes(least, cells), _OUT), "suffixes")
    deep = found.filter("kind = 'suffix'").select("lang", "cell", "suffixes").groupBy("lang", "cell").applyInArrow(_sorted(least), f"lang string, {_PHRASE}")
    short = found.filter("kind = 'phrase'").select("lang", *(c.split()[0] for c in _PHRASE.split(", ")))
    words = found.filter("kind = 'word'").select("lang", "word", "spelled", "a")
    totals = found.filter("kind = 'total'").groupBy("lang").agg(F.sum("a").alias("n"))
    return written(short.unionByName(deep), "phrases"), words, totals


def collocations(docs: DataFrame, *, least: int = 100, best: int = 2000, block_tokens: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    phrases, words, totals = phrase_counts(docs, least=least, block_tokens=block_tokens)
    count = phrases.select("gram", "a").union(words.select("word", "a"))
    cuts = phrases.select("lang", "gram", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut"))
    cuts = cuts.select("lang", "gram", "a", "k", F.col("cut.heads").alias("head"), F.col("cut.tails").alias("tail"))
    cuts = cuts.join(count.toDF("head", "l"), "head").join(count.toDF("tail", "r"), "tail").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # the two phrases of one word less that a phrase holds go if they stand no more often than it
    inner = phrases.filter(F.size("words") > 2).select("a", F.explode(F.array(F.element_at("heads", -1), F.get("tails", F.lit(0)))).alias("gram")).distinct()
    kept = scored.join(inner, ["gram", "a"], "left_anti")
    text = phrases.select("gram", F.posexplode("words").alias("place", "word")).join(words.select("word", "spelled"), "word")
    text = text.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("place", "spelled"))).alias("w"))  # five words at most
    text = text.select("gram", F.array_join(F.transform("w", lambda x: x["spelled"]), " ").alias("phrase"))
    rows = kept.join(text, "gram").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", F.pmod("gram", F.lit(64)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))  # of at most 64 x best rows
    return some.withColumn("rank", rank).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
