"""Graphs of any size by joins: components with a parity, and lists ranked by pointer jumping.

Both loop on the driver over written tables, a round each, in about as many rounds as the logarithm of the longest path; what the driver
holds is whether something still changed. No group holds a shape, a component or a list: joins and minima are by single nodes, with
map-side combine, so a hub's links are one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import written


def signed_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """shape_id, node, label (the smallest node of its component) and turned: whether an odd number of flips leads from the label here.

    nodes: shape_id, node long; links: shape_id, a long, b long, flip boolean, one row for either direction or both. Where flips
    contradict each other around a circle, `turned` follows some of them.
    """
    both = links.select("shape_id", "a", "b", "flip").union(links.select("shape_id", F.col("b"), F.col("a"), "flip"))
    both = written(both.filter("a <> b").groupBy("shape_id", "a", "b").agg(F.min("flip").alias("flip")), "links")
    labels = nodes.select("shape_id", F.col("node").cast("long").alias("node")).distinct().withColumns({"label": F.col("node"), "turned": F.lit(False)})
    labels = written(labels, "labels")
    other = lambda x, y: F.col(x) != F.col(y)  # noqa: E731  exclusive or
    while True:
        near = both.join(labels.toDF("shape_id", "b", "to", "t"), ["shape_id", "b"]).select("shape_id", F.col("a").alias("node"), "to", other("t", "flip").alias("t"))
        near = near.groupBy("shape_id", "node").agg(F.min(F.struct("to", "t")).alias("m")).select("shape_id", "node", "m.to", "m.t")
        met = labels.join(near, ["shape_id", "node"])
        # a node takes its neighbours' least label, and hands it to the node that it has been labelled with
        own = met.select("shape_id", "node", "to", "t")
        handed = met.select("shape_id", F.col("label").alias("node"), "to", other("t", "turned").alias("t"))
        least = labels.select("shape_id", "node", F.col("label").alias("to"), F.col("turned").alias("t")).union(own).union(handed).groupBy("shape_id", "node").agg(F.min(F.struct("to", "t")).alias("m"))
        hooked = written(least.select("shape_id", "node", "m.to", "m.t"), "hooked")
        up = hooked.toDF("shape_id", "to", "up", "s")
        after = hooked.join(up, ["shape_id", "to"], "left").select("shape_id", "node", F.coalesce("up", "to").alias("label"), F.when(F.col("s").isNull(), F.col("t")).otherwise(other("t", "s")).alias("turned"))
        after = written(after, "labels")
        moved = after.join(labels.select("shape_id", "node", F.col("label").alias("was")), ["shape_id", "node"]).filter("label <> was")
        labels = after
        if moved.isEmpty():
            return labels


def _doubled(state: DataFrame, low: str) -> DataFrame:
    """state (shape_id, id, next, ..) a jump further: next's next; `low` is the lesser of both."""
    ahead = state.select("shape_id", F.col("id").alias("next"), F.col("next").alias("far"), F.col(low).alias("low_ahead"))
    return state.join(ahead, ["shape_id", "next"], "left").select("shape_id", "id", F.col("far").alias("next"), F.least(low, "low_ahead").alias(low))


def ranked_lists(arcs: DataFrame) -> DataFrame:
    """shape_id, id, head, place, length: the lists that arcs (shape_id, id long, next long or null) make. A closed list is cut before its
    smallest id; head is a list's first id, place counts from 0.

    Every id has at most one arc that leads to it.
    """
    arcs = written(arcs.select("shape_id", "id", "next"), "arcs")
    # the least id ahead, over twice as far each round: open lists run out one after the other, in closed ones nothing falls any more
    state, was = written(arcs.withColumn("low", F.col("id")), "lows"), None
    while True:
        now = tuple(state.agg(F.count("next"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if now == was:
            break
        state, was = written(_doubled(state, "low"), "lows"), now
    closed = state.filter("next is not null").select("shape_id", "id", "low")
    cut = arcs.join(closed, ["shape_id", "id"], "left").select("shape_id", "id", F.when(F.col("next") == F.col("low"), None).otherwise(F.col("next")).alias("next"))
    state = cut.withColumns({"tail": F.col("id"), "left": F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")})
    while True:
        state = written(state, "ranks")
        if state.filter("next is not null").isEmpty():
            break
        ahead = state.select("shape_id", F.col("id").alias("next"), F.col("next").alias("far"), F.col("tail").alias("end"), F.col("left").alias("more"))
        state = state.join(ahead, ["shape_id", "next"], "left").select(
            "shape_id", "id", F.col("far").alias("next"), F.when(F.col("next").isNull(), F.col("tail")).otherwise(F.col("end")).alias("tail"), (F.col("left") + F.coalesce("more", F.lit(0).cast("long"))).alias("left")
        )
    heads = state.groupBy("shape_id", "tail").agg(F.max(F.struct("left", "id")).alias("h"))
    heads = heads.select("shape_id", "tail", F.col("h.id").alias("head"), F.col("h.left").alias("last"))
    return state.join(heads, ["shape_id", "tail"]).select("shape_id", "id", "head", (F.col("last") - F.col("left")).alias("place"), (F.col("last") + 1).alias("length"))


def independent_set(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """shape_id, node, kept: the nodes that are kept if they are asked in the order of (priority, node) and each is kept that has no link to
    one kept before.

    nodes: shape_id, node, priority; links: shape_id, a, b, in one direction or both. In each round every open node that comes before all
    its open neighbours is kept, and its neighbours are not: what is decided so is what the order would decide. Priorities that do not
    follow the links, such as hashes, take about as many rounds as the logarithm of the nodes; ones that rise along a path take one a link.
    """
    rank = written(nodes.select("shape_id", "node", F.struct("priority", "node").alias("rank")), "ranks")
    both = links.select("shape_id", "a", "b").union(links.select("shape_id", F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = both.join(rank.toDF("shape_id", "b", "r"), ["shape_id", "b"])  # the neighbour's rank comes along
    open_links = written(both.join(rank.toDF("shape_id", "a", "own"), ["shape_id", "a"]), "open-links")
    alone = rank.join(open_links.select("shape_id", F.col("a").alias("node")).distinct(), ["shape_id", "node"], "left_anti")
    kept = [alone.select("shape_id", "node")]
    while not open_links.isEmpty():
        first = open_links.groupBy("shape_id", "a").agg(F.min("r").alias("r"), F.first("own").alias("own")).filter("own < r")
        first = written(first.select("shape_id", F.col("a").alias("node")), "kept")
        kept.append(first)
        gone = open_links.join(first.withColumnRenamed("node", "b"), ["shape_id", "b"], "left_semi").select("shape_id", F.col("a").alias("node")).distinct()
        decided = written(gone.union(first), "decided")
        rest = open_links
        for end in "ab":
            rest = rest.join(decided.withColumnRenamed("node", end), ["shape_id", end], "left_anti")
        rest = written(rest, "open-links")
        # whose neighbours all are decided, and which is not, has none that was kept
        ended = open_links.select("shape_id", F.col("a").alias("node")).distinct().join(decided, ["shape_id", "node"], "left_anti")
        kept.append(ended.join(rest.select("shape_id", F.col("a").alias("node")).distinct(), ["shape_id", "node"], "left_anti"))
        open_links = rest
    found = kept[0]
    for part in kept[1:]:
        found = found.union(part)
    return nodes.select("shape_id", "node").join(found.withColumn("kept", F.lit(True)), ["shape_id", "node"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
