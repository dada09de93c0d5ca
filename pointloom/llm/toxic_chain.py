"""Toxicity by a classifier chain: linear models for one category after the other, each fed with the probabilities of those
before it.

Features are the presence of byte n-grams of words (n = 4, 5, 6, 8; ASCII lower case; a word's start counts as a byte), hashed
into 2**20 buckets, of which the `features` that differ most between the rows with and without each category are kept. Every
link is a logistic regression over these features and the earlier links' probabilities. A link is trained with out-of-fold
probabilities of the earlier ones: the models that score a fold have their features chosen and their weights fitted on the
other folds alone (equal texts share a fold), so that a link learns from what the earlier ones give on unseen texts; when
documents are scored, models fitted on all rows feed each other. A document is marked where the first category's probability
reaches the threshold (in steps of a two-hundredth) that gives the out-of-fold probabilities the best F1.

The fit takes at most about `fit_rows` labelled rows, drawn by a hash; prediction covers every byte of every text.

Cases: a label row with a null category, or of an unknown document, is not learned from; label rows of a document that agree
count once, those that differ count each; a category with one value only gives its rate to all; no usable label rows: all
probabilities are null and no document is marked; a null or empty text is scored by its absence of features; a null doc_id is
carried along; repeated rows are scored one by one; features that differ equally go by their bucket; a long text is read in
parts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import CHUNK_BYTES, MARKS, mix, slices, utf8, written

BITS = 20
SIZES = (4, 5, 6, 8)
#: ASCII letters in lower case, and one mark for all ASCII that is no letter or digit.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[MARKS] = 32


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Part by part and for each gram size: the texts of the grams that lie within a word or start at the mark before it, and their buckets."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
    data, ends = utf8(padded)  # each text starts with a mark, so no gram reaches into the next text
    for lo in range(0, len(data), CHUNK_BYTES):
        plain = _PLAIN[data[lo : lo + CHUNK_BYTES + max(SIZES) - 1]].astype(np.uint64)
        marks = np.r_[0, np.cumsum(plain == 32)]
        for n in SIZES:
            size = min(len(plain) - n + 1, CHUNK_BYTES)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint64)
            for k in range(n):
                code *= np.uint64(0x100000001B3)
                code += plain[k : k + size]
            at = np.flatnonzero(marks[n : n + size] == marks[1 : size + 1])
            yield np.searchsorted(ends, lo + at, "right") - 1, (mix(code[at]) >> np.uint64(64 - BITS)).astype(np.int64)


def _pairs(column: pa.Array, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted; with `number` only buckets that have one, as that number less 1."""
    parts, held = [np.zeros(0, np.int64)], 0
    for doc, bucket in grams(column):
        if number is not None:
            bucket = number[bucket]
            doc, bucket = doc[bucket > 0], bucket[bucket > 0] - 1
        parts.append(np.unique(doc << 32 | bucket))
        held += len(parts[-1])
        if held > 4 * CHUNK_BYTES:  # a long text repeats its grams
            parts = [np.unique(np.concatenate(parts))]
            held = 0
    pairs = np.unique(np.concatenate(parts))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _count(kinds: int, folds: int):
    """Of each partition and fold: in how many rows, and rows of each category, a bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 1 + kinds, 1 << BITS), np.int32)
        for b in slices(batches, "text"):
            doc, bucket = _pairs(b["text"])
            fold = b["fold"].to_numpy()[doc]
            for j in range(folds):
                for c in range(1 + kinds):
                    some = fold == j if c == 0 else (fold == j) & (b[f"c{c - 1}"].to_numpy(zero_copy_only=False)[doc] > 0)
                    total[j, c] += np.bincount(bucket[some], minlength=1 << BITS).astype(np.int32)
        for j in range(folds):
            seen = np.flatnonzero(total[j, 0])
            for at in range(0, len(seen), 100_000):
                s = seen[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), j), pa.int32()), pa.array(s, pa.int32()), *(pa.array(t[s], pa.int64()) for t in total[j])], ["fold", "bucket", "n", *(f"n{c}" for c in range(kinds))])

    return run


def _features(shared):
    """Replaces the text by the names of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, f = _pairs(b["text"], shared.value)
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f, pa.int32()).cast(pa.string()))
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), lists], [*keep, "f"])

    return run


def _score(shared, models: list[tuple[np.ndarray, float]], features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, f = _pairs(b["text"], shared.value)
            p = np.zeros((b.num_rows, len(models)))
            for k, (w, base) in enumerate(models):
                z = base + np.bincount(doc, w[:features][f], b.num_rows) + p[:, :k] @ w[features : features + k]
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(p[:, k]) for k in range(len(models)))], ["doc_id", *(f"p{k}" for k in range(len(models)))])

    return run


def _fit(rows: DataFrame, names: list[str], k: int, max_iter: int) -> tuple[np.ndarray, float]:
    """Weights (of the features `names`, then of the earlier probabilities) and intercept of link k."""
    rates = rows.agg(F.avg(f"c{k}")).first()[0]
    if rates is None or rates in (0.0, 1.0):
        return np.zeros(len(names) + k), {None: 0.0, 0.0: -50.0, 1.0: 50.0}[rates]
    present = CountVectorizerModel.from_vocabulary(names or ["none"], inputCol="f", outputCol="v").setBinary(True)
    x = VectorAssembler(inputCols=["v", *(f"o{j}" for j in range(k))], outputCol="x").transform(present.transform(rows))
    m = LogisticRegression(featuresCol="x", labelCol=f"c{k}", maxIter=max_iter, regParam=0.0005, standardization=False).fit(x.select(f"c{k}", "x"))
    w = m.coefficients.toArray()
    return (w if names else w[1:]), float(m.intercept)


def _choose(rows: DataFrame, kinds: int, folds: int, features: int) -> list[list[int]]:
    """The buckets chosen without each fold, and last without none: those that differ most in each category, by the z-test of two rates."""
    sums = ", ".join(f"n{k} long" for k in range(kinds))
    by = ["n", *(f"n{k}" for k in range(kinds))]
    seen = rows.groupBy("fold").agg(F.count(F.lit(1)), *(F.sum(f"c{k}") for k in range(kinds))).collect()
    rates = []
    for j in range(folds + 1):
        total, *yes = (sum(r[1 + c] for r in seen if r["fold"] != j) for c in range(1 + kinds))
        rates += [(j, k, float(y), float(total)) for k, y in enumerate(yes) if 0 < y < total]
    counts = rows.select("fold", "text", *(f"c{k}" for k in range(kinds))).mapInArrow(_count(kinds, folds), f"fold int, bucket int, n long, {sums}")
    counts = written(counts.groupBy("fold", "bucket").agg(*(F.sum(c).alias(c) for c in by)), "counts")
    without = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda j: j != F.col("fold")))
    counts = counts.withColumn("j", without).groupBy("j", "bucket").agg(*(F.sum(c).alias(c) for c in by))
    counts = counts.select("j", "bucket", "n", F.posexplode(F.array(*by[1:])).alias("k", "yes"))
    known = rows.sparkSession.createDataFrame(rates, "j int, k int, all_yes double, total double")  # a row for each fold and category
    counts = counts.join(F.broadcast(known), ["j", "k"])
    yes, rest = F.col("all_yes"), F.col("total") - F.col("all_yes")
    p1, p0, p = (F.col("yes") + 0.5) / (yes + 1), (F.col("n") - F.col("yes") + 0.5) / (rest + 1), (F.col("n") + 1) / (F.col("total") + 2)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / yes + 1 / rest))
    rank = F.row_number().over(W.partitionBy("j", "k").orderBy(F.col("z").desc(), "bucket"))
    best = counts.withColumn("z", z).withColumn("rank", rank).filter(F.col("rank") <= features // kinds).select("j", "bucket").distinct().collect()
    return [sorted(r["bucket"] for r in best if r["j"] == j) for j in range(folds + 1)]


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, fit_rows: int = 20_000, features: int = 3072, folds: int = 4, max_iter: int = 25) -> DataFrame:
    """doc_id, the probability of each category (in the chain's order) and `toxic` (the first one's reaches the threshold).

    `categories` maps names to 0/1 columns over `labels`, in the order of the chain.
    """
    spark = docs.sparkSession
    names, kinds = list(categories), len(categories)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cs = [f"c{k}" for k in range(kinds)]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("double").alias(f"c{k}") for k, c in enumerate(categories.values()))).dropna().distinct()
    below = lambda share: share * (1 << 30)
    # about fit_rows label rows, so small enough to send to all
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id", *cs), F.lit(1 << 30)) < below(min(1.0, fit_rows / max(1, known.count())))))
    # rows may share a doc_id, so what is found is drawn from again
    share = min(1.0, fit_rows / max(1, docs.select("doc_id").join(drawn, "doc_id").count()))
    found = docs.join(drawn, "doc_id").filter(F.pmod(F.xxhash64(F.lit(2), "doc_id", "text", *cs), F.lit(1 << 30)) < below(share))
    rows = written(found.select("text", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"), *cs), "labelled")
    if rows.isEmpty():
        return docs.select("doc_id", *(F.lit(None).cast("double").alias(n) for n in names), F.lit(False).alias("toxic"))
    chosen = _choose(rows, kinds, folds, features)
    every = sorted(set().union(*chosen))
    place = {bucket: k for k, bucket in enumerate(every)}
    numbers = [[place[x] for x in own] for own in chosen]
    table = rows.mapInArrow(_features(spark.sparkContext.broadcast(_numbered(every))), "fold int, " + ", ".join(f"{c} double" for c in cs) + ", f array<string>")
    table = written(table, "features")
    models, threshold = [], 0.5
    for k in range(kinds):
        called = [[str(x) for x in own] for own in numbers]
        models.append(_fit(table, called[folds], k, max_iter))
        if k == 0 or k + 1 < kinds:
            parts = [(*_fit(table.filter(F.col("fold") != j), called[j], k, max_iter), np.array(numbers[j], np.int64)) for j in range(folds)]
            send = spark.sparkContext.broadcast(parts)
            table = written(table.mapInArrow(_out_of_fold(send, k, len(every)), T.StructType([*table.schema, T.StructField(f"o{k}", T.DoubleType())])), "features")
        if k == 0:
            threshold = _threshold(table)
    shared = spark.sparkContext.broadcast(_numbered(chosen[folds]))
    out = docs.mapInArrow(_score(shared, models, len(chosen[folds])), "doc_id long, " + ", ".join(f"p{k} double" for k in range(kinds)))
    return out.select("doc_id", *(F.col(f"p{k}").alias(n) for k, n in enumerate(names)), (F.col("p0") >= threshold).alias("toxic"))


def _threshold(table: DataFrame, steps: int = 200) -> float:
    """The probability from which on o0 tells c0 best by F1; of equally good ones that nearest to a half."""
    seen = table.groupBy(F.floor(F.col("o0") * steps).cast("int").alias("b")).agg(F.sum("c0").alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    yes, n = np.zeros(steps + 1), np.zeros(steps + 1)
    for r in seen:
        yes[r["b"]], n[r["b"]] = r["yes"], r["n"]
    if yes.sum() in (0, n.sum()):
        return 0.5
    hits, marked = np.cumsum(yes[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    f1 = 2 * hits / (yes.sum() + marked)
    best = np.flatnonzero(f1 >= f1[1:].max() - 1e-12)
    best = best[best > 0]
    return float(best[np.abs(best - steps / 2).argmin()] / steps)


def _numbered(buckets: list[int]) -> np.ndarray:
    """A number from 1 for each of the buckets, 0 for all others."""
    number = np.zeros(1 << BITS, np.int32)
    number[buckets] = 1 + np.arange(len(buckets))
    return number


def _out_of_fold(shared, k: int, width: int):
    """Adds o{k}: the probability by the model that was fitted without the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, lists = b["fold"].to_numpy(), b["f"]
            f, row = lists.flatten().cast(pa.int32()).to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            out = np.zeros(b.num_rows)
            for j, (w, base, own) in enumerate(shared.value):
                weight = np.zeros(width)
                weight[own] = w[: len(own)]
                z = base + np.bincount(row, weight[f], b.num_rows) + sum((w[len(own) + i] * b[f"o{i}"].to_numpy() for i in range(k)), np.zeros(b.num_rows))
                out = np.where(fold == j, 1 / (1 + np.exp(-np.clip(z, -500, 500))), out)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, f"o{k}"])

    return run
