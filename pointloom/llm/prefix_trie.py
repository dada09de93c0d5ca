"""Prefix trie of conversations: ROLLUP over positional turn-id columns aggregates all prefixes together.

A conversation is rebuilt from the first turns of its group's leading conversation and its own later turns. Its turns are cut
into blocks of `BLOCK` columns; a row holds a block's turn ids, and the key of the node where the block before it ends. One ROLLUP over
these columns, per key, gives all nodes at all depths: the level (`grouping_id`) says how many turns of the block count. The
key of a node is the exclusive or of a 128-bit hash of each turn and its position, so that a long conversation's blocks get their keys
by running sums and need no round per block. Turn ids are 128-bit hashes of role and text with the text's length.

A node is named by its smallest member and its depth. Sums over subtrees are sums over members: the texts that conversation m shares
with a smaller one are its first o turns, and the saved tokens of a node at depth d are the sum of m's shared texts from turn d on,
over its members but the smallest. With Q the code points of m's first o turns this is sum(Q) - Q of the smallest -
(members - 1) * code points above the node; a childless node counts for its smallest member. A second ROLLUP adds both up.

Ids that end at a node are hashed in order: ends are sorted by node and id over ranges; a run that lies within a range is hashed
there, others are handed on in pieces. SHA-256 takes its bytes in order, so a node where very many end is hashed by one task, which
reads a stream of pieces and holds one of them.

Cases: rows without conv_id take no part; a null role or text is an empty one; a null turn comes first; rows of one turn go by
role, then by the text's hash, and rows that repeat are turns of their own; a conversation without turns ends at the root; an empty table
has no root and gives an empty one; other columns are ignored. Turns are numbered over ranges of (conv_id, turn), so a conversation
that holds a third of all rows is no one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import written

#: Turn columns of a block.
BLOCK = 8
#: Ids that wait for their node's end, and that a piece holds.
PIECE = 1 << 16

_xor = Column.bitwiseXOR


def _before(rows: DataFrame, key: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds for each name in values the sum ('sum') or exclusive or ('bit_xor') of that column over the rows of the same key that come
    before; within ranges of (key, order) first, then over the ranges that a key spans."""
    dealt = written(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranges")
    of = lambda n, kind: getattr(F, kind)(n)
    own = W.partitionBy("part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "part").agg(*(of(n, k).alias(n) for n, k in values.items()))
    totals = totals.select(key, "part", *(of(n, k).over(parts).alias(f"{n}_parts") for n, k in values.items())).filter(F.col(f"{next(iter(values))}_parts").isNotNull())
    out = dealt.withColumns({f"{n}_own": of(n, k).over(own) for n, k in values.items()}).join(totals, [key, "part"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = lambda n, k: zero(f"{n}_own") + zero(f"{n}_parts") if k == "sum" else _xor(zero(f"{n}_own"), zero(f"{n}_parts"))
    return out.withColumns({f"{n}_before": both(n, k) for n, k in values.items()}).drop("part", *(f"{n}_{x}" for n in values for x in ("own", "parts")))


def _lane(k: int, pos: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(k), pos, turn["lo"], turn["hi"])


def rebuilt(conversations: DataFrame, *, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, turn: lo, hi, chars) of the rebuilt conversations, and all conv_ids.

    Conversation c keeps the first h turns of conversation c - c % group, h = crc32(c) % heads, and its own turns after its first h.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.xxhash64(role, text).alias("lo"), F.xxhash64(F.lit(1), text, role).alias("hi"), F.length(text).cast("long").alias("chars"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("by"), turn.alias("turn"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "n": F.lit(1)})
    own = written(_before(rows, "conv_id", ["at", "by", "turn", "row"], {"n": "sum"}).select("conv_id", (F.col("n_before") + 1).alias("pos"), "turn"), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = own.select("conv_id").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    first = [F.max(F.when(F.col("pos") == k, F.col("turn"))).alias(f"t{k}") for k in range(1, heads)]
    lead = own.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array(*first).alias("lead"))
    taken = F.filter(F.slice(F.coalesce("lead", F.array()), 1, F.greatest("h", F.lit(1))), lambda t: t.isNotNull())
    convs = convs.join(lead, "base", "left").select("conv_id", "h", F.when(F.col("h") > 0, taken).otherwise(F.filter("lead", lambda t: F.lit(False))).alias("lead"))
    convs = written(convs.withColumn("shift", F.greatest(F.coalesce(F.size("lead"), F.lit(0)), F.lit(0)) - F.col("h")), "convs")
    head = convs.select("conv_id", F.posexplode("lead").alias("pos", "turn")).select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), "turn")
    tail = own.filter(F.col("pos") > h).join(convs.select("conv_id", "shift"), "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn")
    return head.union(tail), convs.select("conv_id")


def _columns(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (conv_id, block, p0, p1: key of the node before it, above: code points before it, t1, ..), and of each conversation
    (conv_id, depth, x0, x1: its last node, chars)."""
    pos, turn = F.col("pos"), F.col("turn")
    place = [F.max(F.when((pos - 1) % BLOCK == k, turn)).alias(f"t{k + 1}") for k in range(BLOCK)]
    blocks = turns.groupBy("conv_id", F.floor((pos - 1) / BLOCK).cast("long").alias("block")).agg(
        *place, F.bit_xor(_lane(0, pos, turn)).alias("x0"), F.bit_xor(_lane(1, pos, turn)).alias("x1"), F.sum(turn["chars"]).alias("chars"), F.max(pos).alias("depth")
    )
    blocks = written(_before(blocks, "conv_id", ["block"], {"x0": "bit_xor", "x1": "bit_xor", "chars": "sum"}), "turn-blocks")
    last = blocks.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.sum("chars").alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = convs.join(last, "conv_id", "left").select("conv_id", *(zero(c) for c in ("depth", "x0", "x1", "chars")))
    whole = written(whole, "whole")
    rows = blocks.select("conv_id", "block", F.col("x0_before").alias("p0"), F.col("x1_before").alias("p1"), F.col("chars_before").alias("above"), *(f"t{k + 1}" for k in range(BLOCK)))
    kind = blocks.schema["t1"].dataType
    nothing = F.lit(0).cast("long")
    turnless = whole.filter("depth = 0").select("conv_id", *(nothing.alias(c) for c in ("block", "p0", "p1", "above")), *(F.lit(None).cast(kind).alias(f"t{k + 1}") for k in range(BLOCK)))
    return rows.union(turnless), whole


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """All nodes of the trie: depth, x0 and x1 (its key), y0 and y1 (its parent's), chars (code points of its text), above (of the texts
    before it) and the aggregates over its members."""
    columns = ", ".join(f"t{k + 1}" for k in range(BLOCK))
    nodes = rows.sparkSession.sql(
        f"SELECT block, p0, p1, max(above) AS above, {BLOCK} - bit_count(grouping_id()) AS level, array({columns}) AS t, {aggregates} FROM {{rows}} GROUP BY block, p0, p1, ROLLUP({columns})", rows=rows
    )
    level, t = F.col("level"), F.col("t")
    nodes = nodes.filter(F.when(level == 0, F.col("block") == 0).otherwise(F.get(t, level - 1).isNotNull()))
    turn = lambda k: F.get(t, F.lit(k))
    lane = lambda k, upto: reduce(_xor, [F.when(upto > j, _lane(k, F.col("block") * BLOCK + j + 1, turn(j))).otherwise(F.lit(0).cast("long")) for j in range(BLOCK)], F.col(f"p{k}"))
    above = reduce(lambda a, b: a + b, [F.when(level - 1 > j, turn(j)["chars"]).otherwise(F.lit(0)) for j in range(BLOCK)], F.col("above"))
    names = [c for c in nodes.columns if c not in ("block", "p0", "p1", "above", "level", "t")]
    return nodes.select(
        (F.col("block") * BLOCK + level).cast("long").alias("depth"),
        lane(0, level).alias("x0"), lane(1, level).alias("x1"), lane(0, level - 1).alias("y0"), lane(1, level - 1).alias("y1"),
        F.when(level > 0, F.get(t, level - 1)["chars"]).otherwise(F.lit(0)).alias("chars"), above.alias("above"), *names,
    )


# ---------------------------------------------------------------------------------------------- ids that end at a node

_DIGEST = "conv_id long, depth long, sha256 string, first long, piece binary"


def _row(node: tuple[int, int], sha: str | None, first: int | None = None, piece: bytes | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*node, sha, first, piece), kinds, strict=True)], ["conv_id", "depth", "sha256", "first", "piece"])


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv_id, depth, member) in order: a digest of each node's members, or pieces of them where its members may go on in another range."""
    node, held, border, done = None, [], True, []

    def text() -> bytes:
        return ",".join(map(str, np.concatenate(held).tolist())).encode()

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield _row(node, None, int(held[0][0]), text())

    def flush() -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done]), pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.binary())], ["conv_id", "depth", "sha256", "first", "piece"])
            done.clear()

    for b in batches:
        c, d, m = (b[k].to_numpy() for k in range(3))
        if not len(c):
            continue
        cut = np.flatnonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(c)], strict=True):
            here = int(c[lo]), int(d[lo])
            if here != node:
                if node is not None and border:
                    yield from rest()
                elif node is not None:
                    done.append((*node, hashlib.sha256(text()).hexdigest()))
                border = node is None  # a range's first node may have begun before it
                node, held = here, []
            held.append(m[lo:hi])
            if sum(map(len, held)) >= PIECE:
                yield from rest()
                held, border = [], True
        yield from flush()
    yield from rest()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv_id, depth, first, piece) in order: the digest of each node's pieces, joined by commas."""
    node, sha = None, None
    for b in batches:
        for c, d, piece in zip(b["conv_id"].to_pylist(), b["depth"].to_pylist(), b["piece"], strict=True):
            if (c, d) != node:
                if node is not None:
                    yield _row(node, sha.hexdigest())
                node, sha = (c, d), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.as_buffer())
    if node is not None:
        yield _row(node, sha.hexdigest())


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where some member (conv_id, depth, member) ends."""
    order = ["conv_id", "depth", "member"]
    runs = written(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_hash_runs, _DIGEST), "ends")
    pieces = runs.filter("piece is not null").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    joined = pieces.mapInArrow(_hash_pieces, _DIGEST)
    return runs.filter("sha256 is not null").union(joined).select("conv_id", "depth", F.col("sha256").alias("ends_sha256"))


# ---------------------------------------------------------------------------------------------- the trie


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, whole = _columns(*rebuilt(conversations))
    key, own = ["depth", "x0", "x1"], ["conv_id", "depth"]
    nodes = written(_rollup(rows, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("y0").alias("x0"), F.col("y1").alias("x1"))
    children = up.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.select(*key, "y0", "y1", "conv_id", "above").join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    linked = written(linked.join(parents, ["depth", "y0", "y1"], "left").select(*key, "conv_id", "above", "n_children", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")), "linked")
    # of each conversation the code points that it shares with a smaller one, and whether a childless node is its own
    first = linked.groupBy("conv_id").agg(F.min(F.when(F.col("depth") > 0, F.col("above"))).alias("q"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shared = whole.join(first, "conv_id", "left").select("conv_id", F.coalesce("q", "chars").alias("q"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    sums = _rollup(rows.join(shared, "conv_id"), "sum(q) AS q, sum(leaf) AS n_leaves, min(struct(conv_id, q)) AS least, count(*) AS n_convs")
    saved = F.col("q") - F.col("least.q") - (F.col("n_convs") - 1) * F.col("above")
    sums = sums.select(*key, "n_convs", "n_leaves", saved.alias("saved_tokens"))
    ends = whole.select(F.col("conv_id").alias("member"), *key).join(linked.select(*key, "conv_id"), key)
    out = linked.drop("above").join(sums, key).join(_digests(ends), own, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
