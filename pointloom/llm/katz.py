"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights, scores of whole texts.

P_n(w | context) is discount(c) * c / C for an n-gram seen c times in the training texts, C times its context; for others it is
alpha(context) * P_(n-1)(w | shorter context), and alpha = 1 where the context was never seen. P_0 = 1: all words that training
lacks are one unknown symbol, which gets what the discounts of the single words leave. A text's first word stands after a
start mark, which is context only; its end is a token.

* Discounts. Turing's (r + 1) n_(r+1) / (r n_r) for r up to 5, where it lies between 0 and 1; else and beyond, those of the line
  through log n_r over log r, r up to `gram_counts.COUNTED` (Gale and Sampson): (1 + 1/r)^(slope + 1), the slope at most -1.05. Every
  count is discounted a little, so every context leaves something to the words not seen after it.
* Weights. alpha(context) = (1 - sum of P_n) / (1 - sum of P_(n-1)), both over the words seen after the context: the
  probabilities of each context sum to one, exactly.

Counts come from `gram_counts`: blocks of tokens ask cells of grams. A block then knows all its seen grams' probabilities, sums the
two sums above over the grams it counts first, scores its texts, and names the weights that the unseen grams need. Weights are
a table (level, context, alpha); what texts ask of it is joined to it by context and summed by text. Nothing of the corpus
but the counts of counts (a few hundred numbers) and three totals reaches the driver.

Cases: a null text is an empty one (one token, its end); a null doc_id counts as training; rows that repeat are texts of their own,
each is learned and scored; a text of millions of words is cut into segments and summed; an empty table gives an empty one; no
training text at all gives every token probability 1 (score 0) and the base its only symbol; other columns are ignored. Grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import gram_counts as G
from .common import written

_U = np.uint64
#: Marks, not hashes of words: the end of a text as a token, its start as a context.
END, START = _U(0x0E0D0E0D0E0D0E0D), _U(0x57A8757A8757A875)
#: Turing's estimate is taken up to this count.
TURING = 5
_OUT = "kind string, row long, doc string, held_out boolean, n_tokens long, n_known long, base_score double, score double, level int, context long, p double, q double, times long"


def discounts(n_r: list[int]) -> tuple[np.ndarray, float]:
    """The discount of each count up to COUNTED (that of 0 is 0), and the exponent for larger ones; n_r from `counts_of_counts`."""
    r = np.array([k for k in range(1, G.COUNTED + 1) if n_r[k]], float)
    slope = -2.0
    if len(r) > 1:
        x, y = np.log(r), np.log(np.array([n_r[int(k)] for k in r], float))
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    power = min(slope, -1.05) + 1
    k = np.arange(1, G.COUNTED + 1)
    out = np.r_[0.0, (1 + 1 / k) ** power]
    for c in range(1, TURING + 1):
        if n_r[c] and 0 < (turing := (c + 1) * n_r[c + 1] / (c * n_r[c])) < 1:
            out[c] = turing
    return out, power


def _discounted(c: np.ndarray, d: tuple[np.ndarray, float]) -> np.ndarray:
    """discount(c) * c."""
    large = c > G.COUNTED
    out = d[0][np.where(large, 0, c)] * c
    out[large] = c[large] * (1 + 1 / c[large]) ** d[1]
    return out


def _grams(order: int) -> Callable[[G.Block], list[G.Grams]]:
    def grams(b: G.Block) -> list[G.Grams]:
        seg, at, own = b.segments()
        weight = (own & b.flag[seg]).astype(np.int64)
        known = at + b.start[seg]  # tokens before this one, the start mark included
        out = [(b.hashes, np.ones(len(seg), bool), weight)]
        for level in range(2, order + 1):
            before = np.r_[START, out[-1][0][:-1]]
            if level == 2:
                before[(at == 0) & b.start[seg]] = START
            out.append((G.longer(before, b.hashes), known >= level - 1, weight))
        return out

    return grams


def _contexts(block: G.Block, grams: list[G.Grams], level: int) -> np.ndarray:
    """The hash of each token's context at a level."""
    if level == 1:
        return np.zeros(len(block.tokens), _U)
    seg, at, _ = block.segments()
    before = np.r_[START, grams[level - 2][0][:-1]]
    if level == 2:
        before[(at == 0) & block.start[seg]] = START
    return before


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    names, inverse = np.unique(key, return_inverse=True)
    return names, *(np.bincount(inverse, v, len(names)) for v in values)


def _score(order: int, model: dict):
    grams_of = _grams(order)

    def run(row: dict, answers: pa.Table) -> pa.Table:
        b = G.block_of(row)
        grams = grams_of(b)
        told = G.answered(b, grams, answers)
        seg, at, own = b.segments()
        tokens, texts, distinct = model["tokens"], model["texts"], model["distinct"]
        seen_log, highest, p_of = np.zeros(len(seg)), np.zeros(len(seg), np.int64), []
        context_counts, contexts, out = [], [], []
        for level, (c, first, _) in enumerate(told, 1):
            context = _contexts(b, grams, level)
            if level == 1:
                of = np.full(len(seg), tokens, np.int64)
            else:
                of = np.r_[0, told[level - 2][0][:-1]]
                if level == 2:
                    of = np.where((at == 0) & b.start[seg], texts, of)
                of = np.where(grams[level - 1][1], of, 0)
            seen = c > 0
            p = np.zeros(len(seg))
            p[seen] = _discounted(c[seen], model["discounts"][level]) / of[seen]
            seen_log[seen] = np.log10(p[seen])
            highest[seen] = level
            p_of.append(p)
            context_counts.append(of)
            contexts.append(context)
            if len(first):
                names, ps, qs = _sums(context[first], p[first], p_of[level - 2][first] if level > 1 else np.zeros(len(first)))
                out.append({"kind": ["weight"] * len(names), "level": [level] * len(names), "context": names.view(np.int64), "p": ps, "q": qs})
        n = len(b.size)
        add = lambda v: np.bincount(seg[own], v[own], n)
        base = np.log10((told[0][0] + 1) / (tokens + distinct + 1))
        out.append(
            {"kind": ["text"] * n, "row": b.row, "doc": b.label, "held_out": ~b.flag, "n_tokens": add(np.ones(len(seg))).astype(np.int64), "n_known": add(told[0][0] > 0).astype(np.int64), "base_score": add(base), "score": add(seen_log)}
        )
        for level in range(1, order + 1):
            asks = np.flatnonzero(own & (highest < level) & (context_counts[level - 1] > 0))
            if len(asks):
                pairs = np.stack([b.row[seg[asks]].view(_U), contexts[level - 1][asks]], 1)
                names, times = np.unique(pairs, axis=0, return_counts=True)
                out.append({"kind": ["ask"] * len(names), "row": names[:, 0].copy().view(np.int64), "level": [level] * len(names), "context": names[:, 1].copy().view(np.int64), "times": times})
        kinds = {"kind": pa.string(), "row": pa.int64(), "doc": pa.string(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "level": pa.int32(), "context": pa.int64(), "p": pa.float64(), "q": pa.float64(), "times": pa.int64()}
        return pa.concat_tables([pa.table({c: pa.array(x[c], t) if c in x else pa.nulls(len(x["kind"]), t) for c, t in kinds.items()}) for x in out])

    return run


def train_and_score(docs: DataFrame, training: Column, *, order: int = 2, block_tokens: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """Scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs. Weights: level, context (a
    hash), alpha of the model that the rows for which `training` holds give."""
    rows = docs.select("text", F.col("doc_id").cast("long").cast("string").alias("label"), F.coalesce(training, F.lit(True)).alias("flag"), F.lit(None).cast("long").alias("salt"))
    blocks = G.token_blocks(rows, end=END, before=order - 1, block_tokens=block_tokens)
    answers = G.counts(blocks, _grams(order))
    n_r = G.counts_of_counts(answers)
    texts = rows.filter("flag").count()
    words = n_r.get(1, [0] * (G.COUNTED + 3))
    model = {"tokens": words[-1], "texts": texts, "distinct": sum(words[:-1]), "discounts": {k: discounts(n) for k, n in n_r.items()}}
    scored = written(G.with_answers(blocks, answers, _score(order, model), _OUT), "scored")
    weights = scored.filter("kind = 'weight'").groupBy("level", "context").agg(((1 - F.sum("p")) / (1 - F.sum("q"))).alias("alpha"))
    asked = scored.filter("kind = 'ask'").select("row", "level", "context", "times")
    # what stands before any word and at a text's start is asked by all texts: two weights, for all of them
    common = (F.col("level") == 1) | (F.col("context") == F.lit(int(START.view(np.int64))))
    met = asked.filter(~common).join(weights.filter(~common), ["level", "context"]).unionByName(asked.filter(common).join(F.broadcast(weights.filter(common)), ["level", "context"]))
    backed = met.groupBy("row").agg(F.sum(F.col("times") * F.log10("alpha")).alias("backed"))
    texts_ = scored.filter("kind = 'text'").groupBy("row", "doc", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    out = texts_.join(backed, "row", "left").select(
        F.col("doc").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score")
    )
    return out, weights


def score(docs: DataFrame, training: Column, *, order: int = 2) -> DataFrame:
    return train_and_score(docs, training, order=order)[0]
