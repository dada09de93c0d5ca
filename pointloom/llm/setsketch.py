"""Near-duplicate documents by SetSketch registers: band, estimate by joint likelihood, verify on the full shingle sets.

A document's set holds its distinct 5-word shingles. A register is the truncated, exponentially spaced minimum of the set's
elements under one hash: floor(1 - log_b(x)) of the smallest exponential value x, in one byte. Registers of a union are the
larger of both, and two registers agree with a probability slightly above the Jaccard similarity J.

1. Equal sets are one node (a 128-bit sum hash of the set); all further work is between different sets.
2. Eight registers form a band. Nodes that agree in one of 40 bands are candidates: at J = 0.85 a pair is missed with a
   probability of 0.728 ** 40 = 3e-6. Lower thresholds take shorter bands (`bands`), at J = 0.8 53 of six: 0.738 ** 53 = 1e-7.
3. In each bucket every node is compared with one hub, and then with another one. Nodes found in one component need no further
   comparison among themselves; where a bucket still holds several components, every pair that crosses them is compared, in
   blocks of bounded size: first by their registers alone, and then, where these leave any pair open, by the full sets of the
   nodes in open pairs. Only links leave the task. Of buckets that hold the same nodes one is taken. So a group of thousands of
   near copies costs a few comparisons a node, and no pair that could join two components is left out.
4. A pair whose similarity by joint maximum likelihood (given both set sizes) is incompatible with the threshold is dropped
   (likelihood ratio over `RATIO`, more than five standard deviations); all others are counted on their full sets.
5. Components by minimum labels.

Cases: no words, or a null text: empty set, linked with nothing; fewer words than five: the whole sequence is the one
shingle; a null doc_id never is a component's smallest and is kept; repeated doc_ids are separate rows; a long text is hashed
in parts; a set that holds over a ten-thousandth of all rows is told to its rows by broadcast (there are fewer than ten thousand
such sets), so that no task gathers its copies; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, mix, slices, window_hashes, written
from .components import components

REGISTERS = 320
BASE = 1.1
#: Twice the difference of log-likelihoods beyond which a similarity of the threshold is ruled out.
RATIO = 30.0
#: Nodes of a bucket that meet in one task.
BLOCK = 1024
_OFFSET = 24
_U = np.uint64


def bands(percent: int) -> tuple[int, int]:
    """Number and length of the longest bands, up to eight registers, that miss a pair at the threshold less than 5e-6 times."""
    rows = next((r for r in range(8, 1, -1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) < 5e-6), 1)
    return REGISTERS // rows, rows


def _multipliers() -> np.ndarray:
    state = mix(np.arange(1, 2 * REGISTERS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (state & _U(0xFFFFFFFF)).astype(np.uint32).reshape(2, -1) | np.uint32(1)


_MUL = _multipliers()


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and n + 1 offsets."""
    w = Words(column, lower=True)
    hashes, first = w.hashes[0], w.first
    flat, index = window_hashes(hashes, first, size)
    out, counts = [], np.zeros(len(first) - 1, np.int64)
    for k in range(len(counts)):
        n = int(first[k + 1] - first[k])
        if n >= size:
            s = np.sort(flat[index[k] : index[k + 1]])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            h = _U(n)
            with np.errstate(over="ignore"):
                for w in hashes[first[k] : first[k + 1]]:
                    h = h * _U(0x9E3779B97F4A7C15) + w
            s = mix(np.array([h], _U))
        else:
            continue
        out.append(s)
        counts[k] = len(s)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, _U)), offsets


def registers(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of registers for each non-empty set."""
    at = offsets[:-1][np.diff(offsets) > 0]
    low, high = flat.astype(np.uint32), (flat >> _U(32)).astype(np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    least = np.empty((REGISTERS, len(at)), np.uint32)
    for i in range(REGISTERS):
        np.multiply(low, _MUL[0, i], out=x)
        np.add(x, high, out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, _MUL[1, i], out=x)
        np.right_shift(x, 13, out=y)
        np.bitwise_xor(x, y, out=x)
        least[i] = np.minimum.reduceat(x, at)
    smallest = -np.log1p(-(least.T + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)) + _OFFSET, 0, 255).astype(np.uint8)


def _keys(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The 128-bit sum hashes of non-empty sets that start at `at`."""
    if not len(at):
        return []
    key = np.stack([np.add.reduceat(mix(flat + _U(0x5851F42D4C957F2D)), at), np.add.reduceat(mix(flat ^ _U(0x14057B7EF767814F)), at)], 1).astype("<u8")
    return [k.tobytes() for k in key]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        flat, offsets = shingle_sets(b["text"])
        sizes = np.diff(offsets)
        full = sizes > 0
        at = offsets[:-1][full]
        keys, sketches = [None] * len(sizes), [None] * len(sizes)
        if len(at):
            key, regs = _keys(flat, at), registers(flat, offsets)
            for k, place in enumerate(np.flatnonzero(full).tolist()):
                keys[place], sketches[place] = key[k], regs[k].tobytes()
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n_shingles", "key", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        flat, offsets = shingle_sets(b["text"])
        full = np.diff(offsets) > 0
        same = np.zeros(len(full), bool)  # a repeated doc_id may bring another text than the node's
        same[full] = [k == w for k, w in zip(_keys(flat, offsets[:-1][full]), b["key"].filter(pa.array(full)).to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([b["node"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "shingles"])
        yield out.filter(pa.array(same))


# ---------------------------------------------------------------------------------------------- estimation


_SHARE, _LOG_BASE = (BASE - 1) / BASE, np.log(BASE)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * _SHARE) / _LOG_BASE
    a, b = p(u - v * j), p(v - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def _slope(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The derivative of the log-likelihood, which is concave, by j."""
    x, y = np.clip(u - v * j, 1e-12, 1), np.clip(v - u * j, 1e-12, 1)
    a, b = -np.log1p(-x * _SHARE) / _LOG_BASE, -np.log1p(-y * _SHARE) / _LOG_BASE
    da, db = -v * _SHARE / (1 - x * _SHARE) / _LOG_BASE, -u * _SHARE / (1 - y * _SHARE) / _LOG_BASE
    return more * da / a + less * db / b - same * (da + db) / np.clip(1 - a - b, 1e-12, 1)


def possible(left: np.ndarray, right: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of register rows are compatible with a similarity of percent / 100, given the set sizes."""
    ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    more, less = np.count_nonzero(left > right, axis=1).astype(float), np.count_nonzero(left < right, axis=1).astype(float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    bar = np.minimum(percent / 100, top)
    known = (u, v, more, less, REGISTERS - more - less)
    # where the likelihood still rises at the threshold, the likeliest similarity lies beyond it
    below = np.flatnonzero(ok & (_slope(bar, *known) < 0))
    if len(below):
        known, bar = tuple(x[below] for x in known), bar[below]
        lo, hi = np.zeros(len(below)), bar.copy()
        for _ in range(24):
            mid = (lo + hi) / 2
            rising = _slope(mid, *known) > 0
            lo, hi = np.where(rising, mid, lo), np.where(rising, hi, mid)
        ok[below] = 2 * (_log_likelihood((lo + hi) / 2, *known) - _log_likelihood(bar, *known)) <= RATIO
    return ok


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                ok = possible(_rows(b["sa"]), _rows(b["sb"]), b["na"].to_numpy().astype(float), b["nb"].to_numpy().astype(float), percent)
                yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], ["a", "b"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by (bucket, ob, mb) a table for each."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("bucket", "ob", "mb")], 1)
        cuts = np.r_[0, 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1)), batch.num_rows]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and tuple(keys[lo]) != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = tuple(keys[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Meeting:
    """The rows of a meeting, and which pairs of an outsider and a member of another component are open."""

    def __init__(self, t: pa.Table, percent: int):
        self.percent, self.t = percent, t
        self.sketch, self.label, self.size, self.outside = _rows(t["sketch"]), t["label"].to_numpy(), t["n"].to_numpy(), t["outside"].to_numpy()

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each outsider with the members whose registers agree often enough, most first."""
        ins = np.flatnonzero(~self.outside)
        share = self.percent / 100
        least = REGISTERS * (share - 5.5 * (share * (1 - share) / REGISTERS) ** 0.5)  # over five standard deviations below the mean at the threshold
        for o in np.flatnonzero(self.outside).tolist():
            fits = 100 * np.minimum(self.size[ins], self.size[o]) >= self.percent * np.maximum(self.size[ins], self.size[o])
            near = ins[fits & (self.label[ins] != self.label[o])]
            agree = np.count_nonzero(self.sketch[near] == self.sketch[o], axis=1)
            order = np.argsort(-agree, kind="stable")
            near = near[order[agree[order] >= least]]
            if len(near):
                yield o, near

    def open(self, o: int, near: np.ndarray) -> np.ndarray:
        """Which of `near` the likelihood leaves open."""
        return possible(np.broadcast_to(self.sketch[o], (len(near), REGISTERS)), self.sketch[near], np.full(len(near), float(self.size[o])), self.size[near].astype(float), self.percent)


def _cross_open(percent: int):
    """Of rows sorted by (bucket, ob, mb), with registers alone, those that have a part in an open pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _meetings(batches):
            m, part = _Meeting(t, percent), np.zeros(t.num_rows, bool)
            for o, near in m.near():
                near = near[~part[near]] if part[o] else near  # of two rows that stay anyway nothing need be known
                if len(near):
                    ok = m.open(o, near)
                    part[near[ok]] = True
                    part[o] |= bool(ok.any())
            yield from t.filter(pa.array(part)).to_batches()

    return run


def _cross_links(percent: int):
    """Of rows sorted by (bucket, ob, mb): links of outsiders to members of other components, as many as join these.

    Open pairs are counted on their full sets, unless links found before have joined their components already.
    """
    seen: set[tuple[int, int]] = set()  # pairs that this task has counted in another bucket

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        meeting = _Meeting(t, percent)
        label, node, n = (t[c].to_numpy().tolist() for c in ("label", "node", "n"))
        lists = t["shingles"].chunk(0)
        flat, cut = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def pair(o: int, m: int) -> tuple[int, int]:
            return min(node[o], node[m]), max(node[o], node[m])

        if len(seen) > 1_000_000:
            seen.clear()
        a, b = [], []
        for o, near in meeting.near():
            for at in range(0, len(near), 128):
                some = [m for m in near[at : at + 128].tolist() if find(label[o]) != find(label[m]) and pair(o, m) not in seen]
                if not some:
                    continue
                for m, is_open in zip(some, meeting.open(o, np.array(some)).tolist(), strict=True):
                    x, y = find(label[o]), find(label[m])
                    if not is_open or x == y:
                        continue
                    seen.add(pair(o, m))
                    both = np.concatenate((flat[cut[o] : cut[o + 1]], flat[cut[m] : cut[m + 1]]))
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * same >= percent * (n[o] + n[m] - same):
                        root[max(x, y)] = min(x, y)
                        a.append(pair(o, m)[0])
                        b.append(pair(o, m)[1])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _meetings(batches):
            if out := meet(t):
                yield out

    return run


# ---------------------------------------------------------------------------------------------- the job


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sketched = written(docs.mapInArrow(_sketch, "doc_id long, text_hash long, n_shingles long, key binary, sketch binary"), "sketches")
    full = sketched.filter("key is not null")
    # a node's row: the one with the smallest doc_id, a null one only where there is no other
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n_shingles", "sketch"))
    nodes = full.groupBy("key").agg(one.alias("one"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select("key", "copies", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("text_hash"), F.col("one.n_shingles").alias("n"), F.col("one.sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    count, rows = bands(percent)
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sketch", k * rows + 1, rows))
    members = nodes.select("node", F.explode(F.array(*[band(k) for k in range(count)])).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter("size > 1")
    members = written(members.join(shared, "bucket"), "members")

    suspects = members.select("node").distinct().join(nodes, "node").select("node", "key", "rep", "text_hash", "n", "sketch")
    suspects = written(suspects, "suspects")
    named = suspects.select("node", "rep", "key", F.col("text_hash").alias("rep_hash"))
    texts = docs.join(named, docs["doc_id"].eqNullSafe(F.col("rep")) & (docs["text_hash"] == F.col("rep_hash"))).select("node", "key", "text")
    sets = texts.mapInArrow(_full_sets, "node long, shingles array<long>")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    small = suspects.select("node", "n", "sketch")
    tested = None
    labels = small.select("node", F.col("node").alias("label"))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.toDF("a", "xa"), sets.toDF("b", "xb")
        both = pairs.join(a, "a").join(b, "b").withColumn("same", F.size(F.array_intersect("xa", "xb")))
        return both.filter(100 * F.col("same") >= percent * (F.size("xa") + F.size("xb") - F.col("same"))).select("a", "b")

    def merged(links: DataFrame) -> DataFrame:
        """Labels after links between nodes."""
        la, lb = labels.toDF("a", "a2"), labels.toDF("b", "b2")
        high = links.join(la, "a").join(lb, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        found = components(high).toDF("label", "new")
        return written(labels.join(found, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")

    def estimated(pairs: DataFrame) -> DataFrame:
        a, b = small.toDF("a", "na", "sa"), small.toDF("b", "nb", "sb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimate(percent), "a long, b long")

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    for turn in range(2):
        if turn == 0:
            pairs = ordered(members.select(F.col("hub").alias("a"), F.col("node").alias("b")))
        else:
            here = members.select("bucket", "node").join(labels, "node")
            hubs = here.groupBy("bucket").agg(F.count_distinct("label").alias("labels"), F.min_by(F.struct("node", "label"), F.xxhash64("node")).alias("h")).filter("labels > 1").select("bucket", F.col("h.node").alias("hub"), F.col("h.label").alias("hub_label"))
            pairs = ordered(here.join(hubs, "bucket").filter("label <> hub_label").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        pairs = written(untested(pairs), "pairs")
        labels = merged(verified(estimated(pairs)))
        tested = pairs if tested is None else tested.union(pairs)

    # the only pair of a bucket of two has been compared with its hub already
    here = written(members.filter("size > 2").select("bucket", "node").join(labels, "node"), "open")
    # of buckets that hold the same nodes one is enough
    names = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in range(2)]
    one_each = here.groupBy("bucket").agg(F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n"), *names).filter("labels > 1")
    here = written(here.join(one_each.groupBy("n", "s0", "s1").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket"), "crossed")
    sums = here.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    sums = sums.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    open_ = here.join(sums, "bucket").join(small, "node")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    rest = F.col("size") - F.col("top.k")
    one = ["bucket", "node", "label", "n", "sketch"]
    ins = open_.select(*one, F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), blocks(rest) - 1)).alias("ob"), spot(F.col("size")).alias("mb"))
    outs = open_.filter(F.col("label") != F.col("top.label")).select(*one, F.lit(True).alias("outside"), spot(rest).alias("ob"), F.explode(F.sequence(F.lit(0), blocks(F.col("size")) - 1)).alias("mb"))
    by = ["bucket", "ob", "mb"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = ins.union(outs)
    met = written(met.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(_cross_open(percent), met.schema), "meetings")
    crossing = met.join(sets, "node").repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(_cross_links(percent), "a long, b long")
    labels = merged(crossing.distinct())

    grouped = suspects.select("key", "node", "rep").join(labels, "node")
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = grouped.join(least, "label").select("key", "component_id")
    told = nodes.select("key", "copies", "rep").join(groups, "key", "left").select("key", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    told = written(told, "groups")
    rows = sketched.select("doc_id", "text_hash", "n_shingles", "key")
    # fewer than ten thousand sets hold over a ten-thousandth of all rows each
    large = F.broadcast(told.filter(F.col("copies") > max(64, sketched.count() // 10_000)).drop("copies"))
    some = rows.filter("key is not null")
    parts = rows.filter("key is null").withColumn("component_id", F.lit(None).cast("long"))
    parts = parts.unionByName(some.join(large, "key")).unionByName(some.join(large.select("key"), "key", "left_anti").join(told.drop("copies"), "key", "left"))
    component = F.coalesce("component_id", "doc_id")
    return parts.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
