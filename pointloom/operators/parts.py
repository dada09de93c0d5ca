"""Parts of shapes: components of equally labelled points, and new labels for the members of symmetry groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G
from .graph import K, components, knn_edges

KEY = ["shape_id", "label"]
SMALL, FEW, LARGE = 10, 3, 20
MODES = {"no_less": 1, "force_match": 2, "no_more": 3}


def checked(points: DataFrame, labels: int) -> DataFrame:
    """points; a label that is neither null nor in 0 to labels - 1 is an error."""
    ok = F.assert_true(F.col("label").isNull() | F.col("label").between(0, labels - 1), F.concat(F.lit("label out of range: "), F.col("label").cast("string")))
    return points.withColumn("label", F.coalesce(ok.cast("int"), F.col("label")))


def part_components(points: DataFrame, least: int) -> DataFrame:
    """shape_id, label, point_idx, component of the parts (points with one label) of at least `least` points."""
    n = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*KEY)
    kept = points.join(n, KEY, "left_semi")
    return components(kept, knn_edges(kept, K, key=KEY), key=KEY)


def count_parts(points: DataFrame, labels: int, *, larger_than: int = LARGE) -> DataFrame:
    """label, parts: the most components of more than `larger_than` points that a shape has; 0 for labels that occur nowhere."""
    sizes = part_components(points, FEW).groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n"))
    per_shape = sizes.groupBy(*KEY).agg(F.sum((F.col("n") > larger_than).cast("int")).alias("k"))
    most = per_shape.groupBy("label").agg(F.max("k").alias("k"))
    every = points.sparkSession.range(labels).select(F.col("id").cast("int").alias("label"))
    return every.join(most, "label", "left").select("label", F.coalesce("k", F.lit(0)).cast("int").alias("parts"))


def cluster_centroids(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """shape_id, label, component, size and the mean x, y, z of each cluster."""
    met = clusters.join(points.select("shape_id", "point_idx", "x", "y", "z"), ["shape_id", "point_idx"])
    return met.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("size"), *(F.avg(c).alias(c) for c in "xyz"))


def keep_largest(centroids: DataFrame, groups: DataFrame, *, compat: bool = False) -> DataFrame:
    """The largest clusters of each part, as many as its group has members; ties go to the smaller component. `compat`: all."""
    known = centroids.join(F.broadcast(groups.select(F.col("group_idx").alias("label"), F.size("members").alias("expected"))), "label")
    if compat:
        return known
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("size").desc(), "component"))
    return known.withColumn("r", rank).filter(F.col("r") <= F.col("expected")).drop("r")


def order_on_line(centroids: DataFrame, direction: Sequence[float], *, compat: bool = False) -> DataFrame:
    """Adds rank (from 0) along a direction; `compat`: by component."""
    n = sum(float(d) ** 2 for d in direction) ** 0.5
    along = sum((F.col(a) * (float(d) / n) for a, d in zip("xyz", direction, strict=True)), F.lit(0.0))
    order = [F.col("component")] if compat else [along, F.col("component")]
    return centroids.withColumn("rank", (F.row_number().over(W.partitionBy(*KEY).orderBy(*order)) - 1).cast("int"))


def order_by_angle(centroids: DataFrame, first: Sequence[float], second: Sequence[float]) -> DataFrame:
    """Adds angle (around the centroids' centre, from `first` towards `second`) and rank (from 0) by it."""
    part = W.partitionBy(*KEY)
    off = tuple(F.col(a) - F.avg(a).over(part) for a in "xyz")
    lit = lambda d: tuple(F.lit(float(x) / sum(float(y) ** 2 for y in d) ** 0.5) for x in d)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(G.dot(off, lit(first)), G.norm(off)), F.lit(1.0))))
    turned = F.when(G.dot(off, lit(second)) < 0, 2 * G.PI - F.acos(cosine)).otherwise(F.acos(cosine))
    out = centroids.withColumn("angle", turned)
    return out.withColumn("rank", (F.row_number().over(part.orderBy("angle", "component")) - 1).cast("int"))


def group_offsets(groups: DataFrame) -> DataFrame:
    """group_idx, members, first: the label at which each group's members start."""
    before = W.orderBy("group_idx").rowsBetween(W.unboundedPreceding, -1)  # a handful of rows
    return groups.withColumn("first", F.coalesce(F.sum(F.size("members")).over(before), F.lit(0)).cast("int"))


def wrong_shapes(points: DataFrame, clusters: DataFrame, groups: DataFrame, mode: str) -> DataFrame:
    """shape_id of shapes where a group of several members has a wrong number of clusters (`no_less`: fewer, `force_match`:
    another number, `no_more`: more), or, but for `no_more`, a part of too few points."""
    several = groups.select(F.col("group_idx").alias("label"), F.size("members").alias("expected")).filter("expected > 1")
    sizes = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(several), "label")
    found = clusters.groupBy(*KEY).agg(F.count_distinct("component").alias("k"))
    met = sizes.join(found, KEY, "left")
    test = {"no_less": F.col("k") < F.col("expected"), "force_match": F.col("k") != F.col("expected"), "no_more": F.col("k") > F.col("expected")}[mode]
    small = F.col("n") < SMALL if mode != "no_more" else F.lit(False)
    return met.filter(small | F.when(F.col("n") >= SMALL, test).otherwise(False)).select("shape_id").distinct()


def split_parts(points: DataFrame, groups: DataFrame, directions: Sequence[Sequence[float]], *, compat: bool = False) -> DataFrame:
    """shape_id, point_idx, new_label. Points carry their group's number as label. A group of one member takes that member's
    label; the clusters of a larger one are ordered (one direction: along it; two: by angle) and take its labels in turn.
    Points of small parts, of dropped clusters and of no group get null (`compat`: 0)."""
    offsets = group_offsets(groups)
    several = points.join(F.broadcast(offsets.filter(F.size("members") > 1).select(F.col("group_idx").alias("label"))), "label", "left_semi")
    clusters = part_components(several, SMALL)
    kept = keep_largest(cluster_centroids(clusters, points), groups, compat=compat)
    ranked = order_on_line(kept, directions[0], compat=compat) if len(directions) == 1 else order_by_angle(kept, *directions)
    own = clusters.join(ranked.select(*KEY, "component", "rank"), [*KEY, "component"]).select("shape_id", "point_idx", "rank")
    met = points.join(own, ["shape_id", "point_idx"], "left").join(F.broadcast(offsets.withColumnRenamed("group_idx", "label")), "label", "left")
    new = F.when(F.size("members") == 1, F.col("first")).otherwise(F.col("first") + F.col("rank"))
    return met.select("shape_id", "point_idx", (F.coalesce(new, F.lit(0)) if compat else new).cast("int").alias("new_label"))
