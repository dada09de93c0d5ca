"""Language identification by prediction by partial matching (PPM, escape method C) over bytes.

Each language has a context tree of orders 0 to 3: counts of the bytes that followed each context in its training texts. The
statistics are frozen after training, so the code length of a byte depends on the last four bytes alone: its count in the
longest known context, or that context's escape and the code in the next shorter one, down to a uniform byte. The code length
of a text is the exact sum over all its bytes; the language with the shortest code (and a prior from the number of training
documents) is predicted, and the score is its posterior probability.

Byte 3-grams and 4-grams that any language knows are numbered once for all languages; per text byte one table look-up gives
the number and one more the code lengths under every language. ASCII letters are taken in lower case.

Training is the fit of a classifier: it takes at most about `fit_bytes` of text of each language, from documents drawn by a hash
of doc_id and text; a document of over `fit_doc_bytes` gives a slice of that size. Every language with a labelled text is
learned. The tables have a column for each language, so beyond `full_langs` languages each one's share of text, and with it the
slice, shrinks with the square of their number, to `LEAST_BYTES` at least. The prior counts all labelled documents. Predictions
cover every byte of every text.

Cases: a text that is null or has no letter gives `und` and score 0; so does every text where nothing could be learned; a
null doc_id is no held-out row; null labels are not learned from; repeated rows are predicted one by one; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, utf8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PAD = b"\n\n\n"
LEAST_BYTES = 2048
#: Languages, and bytes, whose code lengths are held at once.
_COLUMNS, _PART = 16, 1 << 17


class ContextTrees:
    """The frozen trees of all languages, as look-up tables."""

    def __init__(self, texts: dict[str, list[bytes]], counts: dict[str, int] | None = None):
        self.langs = sorted(texts)
        counts = counts or {x: len(t) for x, t in texts.items()}
        total = sum(counts[x] for x in self.langs)
        self.prior = np.array([-np.log2(counts[x] / total) for x in self.langs])
        data = [np.concatenate([np.frombuffer(_PAD + t, np.uint8) for t in texts[x]]) for x in self.langs]
        data = [_FOLD[d] for d in data]
        seen = np.unique(np.concatenate(data))
        self.classes = np.zeros(256, np.int64)  # class 0: bytes that no language knows
        self.classes[seen] = 1 + np.arange(len(seen))
        a = self.size = len(seen) + 1
        grams = [[], [], [], []]
        for d in data:
            c = self.classes[d]
            for n in range(4):
                code = np.zeros(len(c) - n, np.int64)
                for k in range(n + 1):
                    code = code * a + c[k : k + len(code)]
                grams[n].append(np.unique(code, return_counts=True))
        langs = len(self.langs)
        self.uniform = np.float32(8.0)
        # order 0 and 1: dense tables; order 2 and 3: numbered grams, 0 for unknown ones
        codes3, codes4 = (np.unique(np.concatenate([g for g, _ in grams[n]])) for n in (2, 3))
        self.to3 = np.zeros(a * a * a, np.int32)
        self.to3[codes3] = 1 + np.arange(len(codes3))
        self.to4 = np.zeros((len(codes3) + 1) * a, np.int32)
        self.to4[self.to3[codes4 // a].astype(np.int64) * a + codes4 % a] = 1 + np.arange(len(codes4))
        full = [np.arange(a), np.arange(a * a), np.r_[0, codes3], np.r_[0, codes4]]
        cost, escape = [], []
        for n in range(4):
            codes = full[n]
            own = np.empty((len(codes), langs), np.float32)
            esc = np.zeros((1 if n == 0 else len(full[n - 1]), langs), np.float32)
            context = codes // a if n else np.zeros(len(codes), np.int64)
            if n == 3:
                context = self.to3[context].astype(np.int64)
            shorter = codes % (a**n) if n else None
            if n == 3:
                shorter = self.to3[shorter].astype(np.int64)
            for x in range(langs):
                g, k = grams[n][x]
                count = np.zeros(len(codes))
                if n < 2:
                    count[g] = k
                else:
                    count[1 + np.searchsorted(full[n][1:], g)] = k
                    context[0] = shorter[0] = 0
                sums = np.bincount(context, count, len(esc))
                kinds = np.bincount(context, count > 0, len(esc))
                if n == 3:
                    sums[0] = kinds[0] = 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    esc[:, x] = np.where(sums > 0, -np.log2(kinds / (sums + kinds)), 0)
                    coded = -np.log2(count / (sums + kinds)[context])
                below = self.uniform if n == 0 else cost[n - 1][shorter, x]
                own[:, x] = np.where(count > 0, coded, esc[context, x] + below)
            cost.append(own)
            escape.append(esc)
        self.cost, self.escape = cost, escape

    def code_lengths(self, data: np.ndarray, of: slice = slice(None)) -> np.ndarray:
        """Bits of each byte from the fourth on, under each language (of those in `of`)."""
        c, a = self.classes[_FOLD[data]], self.size
        two = c[:-1] * a + c[1:]
        three = self.to3[two[:-1] * a + c[2:]].astype(np.int64)
        four = self.to4[three[:-1] * a + c[3:]]
        cost, escape = [x[:, of] for x in self.cost], [x[:, of] for x in self.escape]
        bits = cost[3][four]
        rare = np.flatnonzero(four == 0)
        context, here = three[rare], three[rare + 1]
        low = np.where((here > 0)[:, None], cost[2][here], escape[2][two[rare + 1]] + cost[1][two[rare + 2]])
        bits[rare] = escape[3][context] + low
        return bits


def fit(table: DataFrame, lang: Column, *, fit_bytes: int = 1_000_000, fit_doc_bytes: int = 65_536, full_langs: int = 64) -> ContextTrees | None:
    """Trees from the rows whose `lang` is not null."""
    size = F.octet_length("text")
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = table.select("text", lang.alias("lang"), h.alias("h")).filter(F.col("lang").isNotNull() & (size > 0))
    taken = F.sum(F.least(size, F.lit(fit_doc_bytes))).alias("bytes")
    sums = rows.groupBy("lang").agg(taken, F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    if not sums:
        return None
    scale = min(1.0, (full_langs / len(sums)) ** 2)
    own_bytes, piece = max(LEAST_BYTES, int(fit_bytes * scale)), max(LEAST_BYTES, int(fit_doc_bytes * scale))
    # what is drawn has at most `piece` bytes a document; the document with the least hash is drawn whatever the share
    shares = [(r["lang"], max(r["least"] + 1, int((1 << 30) * min(1.0, own_bytes / min(r["bytes"], r["n"] * piece))))) for r in sums]
    drawn = rows.join(F.broadcast(table.sparkSession.createDataFrame(shares, "lang string, below long")), "lang").filter("h < below")
    start = 1 + F.pmod("h", F.greatest(size - piece, F.lit(0)) + 1).cast("int")
    drawn = drawn.select("lang", F.col("text").cast("binary").substr(start, F.lit(piece)).alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(bytes(r["text"]))
    return ContextTrees(texts, {r["lang"]: r["n"] for r in sums})


def _add_lengths(trees: ContextTrees, data: np.ndarray, ends: np.ndarray, of: slice, total: np.ndarray) -> None:
    """Adds to `total` the code length of each text (padded by three bytes) under the languages in `of`, part by part."""
    for lo in range(3, len(data), _PART):
        hi = min(lo + _PART, len(data))
        bits = np.zeros((hi - lo + 1, len(trees.langs[of])))
        np.cumsum(trees.code_lengths(data[lo - 3 : hi], of), axis=0, out=bits[1:])
        some = slice(int(np.searchsorted(ends, lo, "right")) - 1, int(np.searchsorted(ends, hi)))
        first = np.clip(ends[:-1][some] + 3, lo, hi) - lo
        last = np.clip(ends[1:][some], lo, hi) - lo
        total[some, of] += bits[np.maximum(last, first)] - bits[first]


def _predict(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees = shared.value
        for b in slices(batches, "text"):
            padded = pc.binary_join_element_wise(pa.scalar("\n\n\n", pa.large_string()), pc.fill_null(b["text"].cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
            data, ends = utf8(padded)
            total = np.zeros((b.num_rows, len(trees.langs))) + trees.prior
            for at in range(0, len(trees.langs), _COLUMNS):
                _add_lengths(trees, data, ends, slice(at, at + _COLUMNS), total)
            best = total.argmin(1)
            score = 1 / np.exp2(np.minimum(total.min(1)[:, None] - total, 0)).sum(1)
            known = np.asarray(b["lettered"].to_numpy(zero_copy_only=False), bool)
            pred = np.where(known, np.array(trees.langs, object)[best], "und")
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], [*keep, "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, passing: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """The columns `passing`, held_out, lang_pred and score of every document; learns from `lang` of the rows not held out."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    own = F.when(~held_out(F.col("doc_id")), F.col("lang"))
    trees = fit(docs.select("doc_id", "text", "lang"), own, **how)
    rows = docs.select(*passing, held_out(F.col("doc_id")).alias("held_out"))
    if trees is None:
        return rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by fit_bytes and the number of languages
    schema = T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    used = [*passing, *(c for c in ("text",) if c not in passing)]
    rows = docs.select(*used, held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(_predict(shared, _unchanged(schema)), schema)


def _unchanged(schema: T.StructType) -> list[str]:
    """The columns that go through unchanged: all but the two predictions."""
    return [c for c in schema.names if c not in ("lang_pred", "score")]
