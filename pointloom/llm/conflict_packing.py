"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Rows are dealt by a hash into groups of about `group_rows` and packed group by group, by falling size. A group keeps its open
bins ordered by what room they have left; a bin carries a bitmap of the sources and one of the duplicate clusters that it
holds. A row goes to the tightest bin that has room and holds neither its source nor its cluster: the search starts at the
bin of the least sufficient room and goes on to its successors until one is compatible, and opens a new bin if none is.

Hot sources, large clusters and rows that repeat are spread over all groups by the hash, so no task holds more than its share. A document
larger than the capacity is cut into pieces of the full capacity and a rest; all bytes of all documents are packed.

Cases: a null or empty text has size 1, as every size counts one byte for the document's end; a null source or cluster
conflicts with nothing; pieces of one document share its source, so they come to different bins; repeated rows are rows of
one cluster; equal sizes go by doc_id, piece, cluster and source; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written


def best_fit(sizes: list[int], sources: list[str | None], clusters: list[int | None], capacity: int) -> list[int]:
    """The bin of each row, rows taken in the given order."""
    source_bit: dict[str, int] = {}
    seen, twice = set(), set()
    for c in clusters:
        (twice if c in seen else seen).add(c)
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(x for x in twice if x is not None))}  # a lone row conflicts with none
    room: list[tuple[int, int]] = []  # (left, bin), ascending
    held: list[list[int]] = []  # a bin's bitmaps of sources and clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.get(cluster, 0)
        for k in range(bisect_left(room, (size, -1)), len(room)):
            left, b = room[k]
            bits = held[b]
            if not (bits[0] & s or bits[1] & c):
                del room[k]
                break
        else:
            left, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        if left > size:
            insort(room, (left - size, b))
        out.append(b)
    return out


_OUT = "doc_id long, piece int, size long, bin_id long, bin_offset long, bin_used long"


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sizes = t["size"].to_pylist()
        bins = best_fit(sizes, t["source"].to_pylist(), t["cluster"].to_pylist(), capacity)
        used: dict[int, int] = {}
        at = []
        for s, b in zip(sizes, bins, strict=True):
            at.append(used.get(b, 0))
            used[b] = at[-1] + s
        base = t["grp"][0].as_py() << 32
        return pa.table(
            {"doc_id": t["doc_id"], "piece": t["piece"], "size": t["size"], "bin_id": pa.array([base + b for b in bins], pa.int64()), "bin_offset": pa.array(at, pa.int64()), "bin_used": pa.array([used[b] for b in bins], pa.int64())}
        )

    return run


def pack(docs: DataFrame, *, capacity: int = 8192, cluster: Column | None = None, group_rows: int = 4096) -> DataFrame:
    """doc_id, piece, size, bin_id, bin_offset and bin_used of every document's pieces; equal texts are a cluster by default."""
    cluster = F.xxhash64("text") if cluster is None else cluster
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), cluster).alias("cluster"), size.alias("whole"))
    # numbered once, so that rows that repeat in all columns spread over the groups as well
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    pieces = F.expr(f"(whole + {capacity - 1}) div {capacity}")
    total = rows.agg(F.sum(pieces)).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    rows = rows.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity)).withColumn("piece", F.col("piece").cast("int"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row"), F.lit(groups)).cast("long")).drop("whole", "row")
    return rows.groupBy("grp").applyInArrow(_pack(capacity), _OUT)
