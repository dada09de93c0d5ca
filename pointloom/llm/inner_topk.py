"""Exact top-k inner products over integer vectors, blocks of candidates sorted by falling length.

The candidates are dealt to blocks of bounded size by ranges of their length. The block of the longest vectors, of fixed
size, goes first and gives each query a floor: its k-th score there. The floor over the query's length is the least length of a
candidate that could reach it (Cauchy-Schwarz): its reach. Queries are dealt to blocks by their reach, and a query block is sent
only to candidate blocks whose longest vector is as long as its least reach (lengths are told apart in quarter powers of two of
their squares), and these only to it. Every pair starts from that floor. Within a pair, the candidates are taken in slices of falling length; a query stops at the first
slice whose longest vector times the query's length cannot reach its floor (Cauchy-Schwarz). For the queries that go on, the
vectors are rotated by the singular vectors of the longest ones; the product of the first rotated components plus the product
of the lengths of the rest bounds the score from above, and only pairs whose bound, with a margin for rounding, reaches the
floor get their exact integer score. Floors rise as scores come in. Nothing is dropped that could be among the k best.

The search is queries times candidates at worst, as any exact one; the queries are a stated set, and each task holds one
block of either. Cases: vectors that are null or empty, or hold null or non-finite components, and rows without vec_id take
no part; vectors of different dimensions are never compared; equal scores go to the smaller vec_id; rows that repeat a vec_id
are no candidates of each other, and as queries each of them gets its own list; fewer candidates than k give all; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import written

#: Leading rotated components that enter the first bound.
HEAD = 16
#: Candidates of one slice, all of about one length.
SLICE = 512


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component; rows with a null or non-finite component are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return table.filter(F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _pack(batches: Iterator[pa.RecordBatch], size: int, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Rows sorted by falling length become blocks: a row with the ids and vectors of up to `size` of them and one dimension, the
    longs in columns `more`, and the level of the longest one."""
    columns, vectors, width, held = [], [], None, 0

    def block() -> pa.RecordBatch:
        v = np.concatenate(vectors)
        top = _level(float((v.reshape(held, -1).astype(float) ** 2).sum(1).max()))
        packed = [np.concatenate([c[k] for c in columns]).astype("<i8").tobytes() for k in range(1 + len(more))] + [v.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *(pa.array([p], pa.binary()) for p in packed), pa.array([top], pa.int32())], ["dims", "ids", *more, "vectors", "level"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own, lists = [batch[c].to_numpy() for c in ("vec_id", *more)], batch["v"]
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        dims = np.diff(ends)
        cuts = np.r_[0, 1 + np.flatnonzero(dims[1:] != dims[:-1]), len(dims)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            while lo < hi:
                if held and (held >= size or dims[lo] != width):
                    yield block()
                    columns, vectors, held = [], [], 0
                width, to = int(dims[lo]), min(hi, lo + size - held)
                columns.append([c[lo:to] for c in own])
                vectors.append(flat[ends[lo] : ends[to]])
                held, lo = held + to - lo, to
    if held:
        yield block()


def _level(n2: float) -> int:
    """Squared lengths in steps of a quarter power of two; grows with n2."""
    return int(np.floor(4 * np.log2(n2 + 1)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then by id."""
    return np.lexsort((ids, -scores))[:k]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of the candidates among its k best that reach its floor."""
    order = np.argsort(-(c * c).sum(1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    cf, qf = c.astype(float), q.astype(float)
    lead = cf[: min(len(cf), 4 * c.shape[1])]
    turn = np.linalg.svd(lead, full_matrices=True)[2].T
    ct, qt = cf @ turn, qf @ turn
    head = min(HEAD, c.shape[1])
    c_rest, q_rest = np.sqrt((ct[:, head:] ** 2).sum(1)), np.sqrt((qt[:, head:] ** 2).sum(1))
    c_len, q_len = np.sqrt((cf * cf).sum(1)), np.sqrt((qf * qf).sum(1))
    floor = floor.astype(float)
    exact = float(c_len.max(initial=0)) * float(q_len.max(initial=0)) < 2.0**50  # then products of whole doubles are exact, in any order
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    active = np.arange(len(q))
    slack = lambda x: x * (1 + 1e-9) + 1e-6
    for at in range(0, len(c), SLICE):
        active = active[slack(q_len[active] * c_len[at]) >= floor[active]]
        if not len(active):
            break
        part = slice(at, at + SLICE)
        bound = qt[active, :head] @ ct[part, :head].T + np.outer(q_rest[active], c_rest[part])
        scale = np.outer(q_len[active], c_len[part])
        open_ = bound + 1e-9 * scale + 1e-6 >= floor[active, None]
        for j in np.flatnonzero(open_.any(1)):
            i = active[j]
            near = np.flatnonzero(open_[j])
            ids = c_ids[part][near]
            scores = np.rint(cf[part][near] @ qf[i]).astype(np.int64) if exact else c[part][near] @ q[i]
            keep = (scores >= floor[i]) & (ids != q_ids[i])
            if keep.any():
                ids, scores = np.r_[found[i][0], ids[keep]], np.r_[found[i][1], scores[keep]]
                best = _best(ids, scores, k)
                found[i] = ids[best], scores[best]
                if len(best) == k:
                    floor[i] = max(floor[i], scores[best[-1]])
    return found


_FOUND = "row long, query_id long, vec_id long, score long"


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                longs = lambda c: np.frombuffer(r[c], "<i8")  # noqa: B023, E731
                q_ids, c_ids = longs("q_ids"), longs("ids")
                found = search(q_ids, longs("q_vectors").reshape(len(q_ids), -1), c_ids, longs("vectors").reshape(len(c_ids), -1), longs("floor"), k)
                n = [len(a) for a, _ in found]
                columns = np.repeat(longs("row"), n), np.repeat(q_ids, n), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "vec_id", "score"])

    return run


def _floors(k: int, shared):
    """Of blocks of queries each query with its floor, the k-th score among the leaders of the same dimension, and the least level of a
    candidate that could reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids = np.frombuffer(r["ids"], "<i8")
                q = np.frombuffer(r["vectors"], "<i8").reshape(len(q_ids), -1)
                floor = np.full(len(q_ids), -(1 << 62), np.int64)
                for dims, ids, vectors in shared.value:
                    if dims == r["dims"]:
                        c_ids = np.frombuffer(ids, "<i8")
                        found = search(q_ids, q, c_ids, np.frombuffer(vectors, "<i8").reshape(len(c_ids), -1), floor, k)
                        floor = np.array([max(f, s[-1]) if len(s) == k else f for f, (_, s) in zip(floor.tolist(), found, strict=True)], np.int64)
                q2 = (q.astype(float) ** 2).sum(1)
                reach = np.where((floor > 0) & (q2 > 0), floor.astype(float) ** 2 / np.maximum(q2, 1), 0)
                need = [_level(x * (1 - 1e-9)) for x in reach.tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * r["dims"], pa.int32()), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["row"], "<i8")), pa.array(q_ids), lists, pa.array(floor), pa.array(need, pa.int64())], ["row", "vec_id", "v", "floor", "need"])

    return run


def _least_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the least need of their queries instead of all."""
    for b in batches:
        least = [int(np.frombuffer(x, "<i8").min()) for x in b["need"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("dims", "ids", "row", "floor", "vectors")), pa.array(least, pa.int32())], ["dims", "q_ids", "row", "floor", "q_vectors", "need"])


def top_inner_products(vectors: DataFrame, is_query: Column, *, k: int = 20, block: int = 4096, query_block: int = 1024, leaders: int = 2048, salts: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query row; a row is no candidate of its own."""
    kind = "dims int, ids binary, vectors binary, level int"
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows = vectors.withColumn("n2", length)
    by = [F.col("n2").desc(), F.col("vec_id")]
    blocks = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("vec_id", "v").mapInArrow(lambda it: _pack(it, block), kind), "candidate-blocks")
    # a number for each query row, as ids may repeat; written before anything asks for it again
    asked = rows.filter(is_query).repartition("vec_id").withColumn("row", F.monotonically_increasing_id()).select("vec_id", "row", "v")
    asked = asked.mapInArrow(lambda it: _pack(it, query_block, ("row",)), "dims int, ids binary, row binary, vectors binary, level int")
    # a fixed number of the longest vectors, whatever the table's size
    longest = rows.orderBy(*by).limit(leaders).select("vec_id", "v").coalesce(1).mapInArrow(lambda it: _pack(it, leaders), kind).drop("level").collect()
    shared = vectors.sparkSession.sparkContext.broadcast([tuple(r) for r in longest])
    floors = written(asked.mapInArrow(_floors(k, shared), "row long, vec_id long, v array<long>, floor long, need long"), "query-floors")
    alike = [F.size("v"), F.col("need"), F.col("vec_id"), F.col("row")]
    ranged = floors.repartitionByRange(*alike).sortWithinPartitions(*alike)
    packed = ranged.mapInArrow(lambda it: _pack(it, query_block, ("row", "floor", "need")), "dims int, ids binary, row binary, floor binary, need binary, vectors binary, level int")
    packed = written(packed.mapInArrow(_least_need, "dims int, q_ids binary, row binary, floor binary, q_vectors binary, need int"), "query-blocks")
    # either side is repeated for the other's live blocks, so that each pair is a task's row of bounded size; of a dimension
    # and level (a few hundred levels) only the number of blocks is known to all
    c_groups = blocks.groupBy("dims", "level").agg(F.count(F.lit(1)).alias("c_groups"))
    q_groups = packed.groupBy("dims", "need").agg(F.count(F.lit(1)).alias("q_groups"))
    group = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = blocks.join(F.broadcast(c_groups), ["dims", "level"]).join(F.broadcast(q_groups), "dims").filter("level >= need")
    left = left.withColumn("cg", group("ids", "c_groups")).withColumn("qg", every("q_groups")).drop("c_groups", "q_groups")
    right = packed.join(F.broadcast(q_groups), ["dims", "need"]).join(F.broadcast(c_groups), "dims").filter("level >= need")
    right = right.withColumn("qg", group("row", "q_groups")).withColumn("cg", every("c_groups")).drop("c_groups", "q_groups")
    found = left.hint("shuffle_hash").join(right, ["dims", "level", "need", "cg", "qg"]).select("ids", "vectors", "q_ids", "row", "q_vectors", "floor").mapInArrow(_pairs(k), _FOUND)
    # a query's partial lists, one of each block that it met, are ranked by groups first
    best = [F.col("score").desc(), "vec_id"]
    some = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("rank", F.row_number().over(W.partitionBy("row", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*best))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
