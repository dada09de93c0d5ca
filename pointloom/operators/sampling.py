"""Area-weighted sampling of mesh surfaces. Draws come from a hash of (shape, draw, seed), so they do not depend on partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from . import linking
from .graph import radius_pairs


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates ax, ay, az, bx, ..., cz of their corners."""
    out = faces
    for p, v in zip("abc", ("v0", "v1", "v2"), strict=True):
        out = out.join(vertices.select("shape_id", F.col("v_idx").alias(v), *(F.col(c).alias(p + c) for c in "xyz")), ["shape_id", v])
    return out


def face_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds area (by edges and angle) and cross_area (by the cross product); both agree up to rounding."""
    a, b, c = (G.cols(p) for p in "abc")
    return corners(faces, vertices).withColumns({"area": G.triangle_area(a, b, c), "cross_area": G.cross_area(a, b, c)})


def face_centroids(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, f_idx and the mean x, y, z of each face's corners."""
    a, b, c = (G.cols(p) for p in "abc")
    mean = G.scale(G.add(a, b, c), 1 / 3)
    return corners(faces, vertices).select("shape_id", "f_idx", *(m.alias(n) for m, n in zip(mean, "xyz", strict=True)))


def face_cdf(areas: DataFrame) -> DataFrame:
    """shape_id, f_idx, area, cdf_lo and cdf: running share of the shape's area, small faces first; ties by f_idx."""
    order = W.partitionBy("shape_id").orderBy("area", "f_idx")
    upto, whole = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("area").over(whole)
    share = lambda c: F.when(total == 0, c).otherwise(F.try_divide(c, total))
    running = F.sum("area").over(upto)
    return areas.select("shape_id", "f_idx", "area", share(running - F.col("area")).alias("cdf_lo"), share(running).alias("cdf"))


def shape_key(df: DataFrame) -> Column:
    """A number for each shape_id: itself if it is one, a hash of any other."""
    whole = df.schema["shape_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.pmod(F.col("shape_id").cast("long") if whole else F.xxhash64("shape_id"), F.lit(1 << 31))


def uniform(shape: Column, draw: Column, stream: int, seed: int) -> Column:
    """A number in [0, 1) that shape, draw, stream and seed decide: one step of a 31-bit linear congruence over a mixed key."""
    key = (shape.cast("long") * 1_000_003 + draw.cast("long") * 7_919 + stream * 104_729 + seed) % (1 << 31)
    once = (key * 1_103_515_245 + 12_345) % (1 << 31)
    return ((once * 1_103_515_245 + 12_345) % (1 << 31)).cast("double") / float(1 << 31)


def draw_faces(cdf: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """shape_id, point_idx, face_idx: n faces a shape, each drawn by its area.

    Draws and faces are merged by one sort per shape: a draw takes the nearest face whose cdf lies above it.
    """
    shapes = cdf.select("shape_id").distinct()
    draws = shapes.select("shape_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point_idx")).withColumn("at", uniform(shape_key(cdf), F.col("point_idx"), 0, seed))
    both = draws.select("shape_id", "at", "point_idx", F.lit(None).cast("int").alias("face")).unionByName(
        cdf.select("shape_id", F.col("cdf").alias("at"), F.lit(None).cast("int").alias("point_idx"), F.col("f_idx").cast("int").alias("face"))
    )
    down = W.partitionBy("shape_id").orderBy(F.col("at").desc(), F.col("point_idx").isNull(), F.col("face").desc())
    last = F.first("face", ignorenulls=True).over(W.partitionBy("shape_id").orderBy(F.col("at").desc_nulls_last(), F.col("point_idx").isNull(), F.col("face").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = F.last("face", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("face_idx", F.coalesce(found, last)).filter(F.col("point_idx").isNotNull()).select("shape_id", "point_idx", "face_idx")


def sample_points(faces: DataFrame, vertices: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """n points on each shape's surface: shape_id, point_idx, x, y, z, face_idx and bx, by, bz (the face's centroid)."""
    areas = face_areas(faces, vertices)
    drawn = draw_faces(face_cdf(areas.select("shape_id", "f_idx", "area")), n, seed=seed)
    on = drawn.join(areas.drop("area", "cross_area"), (drawn["shape_id"] == areas["shape_id"]) & (drawn["face_idx"] == areas["f_idx"])).drop(areas["shape_id"])
    key = shape_key(drawn)
    r1, r2 = F.sqrt(uniform(key, F.col("point_idx"), 1, seed)), uniform(key, F.col("point_idx"), 2, seed)
    a, b, c = (G.cols(p) for p in "abc")
    at = G.add(G.scale(a, 1 - r1), G.scale(b, r1 * (1 - r2)), G.scale(c, r1 * r2))
    center = G.scale(G.add(a, b, c), 1 / 3)
    return on.select("shape_id", "point_idx", *(p.alias(k) for p, k in zip(at, "xyz", strict=True)), "face_idx", *(p.alias(k) for p, k in zip(center, ("bx", "by", "bz"), strict=True)))


def dense_sample(samples: DataFrame, faces: DataFrame, vertices: DataFrame, n: int, n_dense: int, *, seed: int = 1) -> DataFrame | None:
    """The samples again if the numbers agree, fresh draws if not, nothing for 0."""
    if n_dense == 0:
        return None
    return samples if n == n_dense else sample_points(faces, vertices, n_dense, seed=seed)


def transfer_labels(samples: DataFrame, face_labels: DataFrame) -> DataFrame:
    """Each sample with the label of its face; null where the face has none."""
    return samples.join(face_labels.select("shape_id", F.col("elem_idx").alias("face_idx"), "label"), ["shape_id", "face_idx"], "left")


def blue_noise(points: DataFrame, radius: float, *, seed: int = 0) -> DataFrame:
    """The points that are left if they are asked in an order that a hash of each and seed decide, and each stays that no other kept
    one is closer to than radius: no two are closer, and no point can be added.

    points: shape_id, point_idx, x, y, z, such as many draws of a surface. Only points in neighbouring cells meet.
    """
    order = uniform(shape_key(points), F.col("point_idx"), 7, seed)
    near = radius_pairs(points, radius).filter("i < j").select("shape_id", F.col("i").alias("a"), F.col("j").alias("b"))
    kept = linking.independent_set(points.select("shape_id", F.col("point_idx").alias("node"), order.alias("priority")), near).filter("kept")
    return points.join(kept.select("shape_id", F.col("node").alias("point_idx")), ["shape_id", "point_idx"], "left_semi")


def merge_near(points: DataFrame, eps: float) -> DataFrame:
    """shape_id, point_idx, kept: in index order, each point goes to the first kept one closer than eps, else it is kept.

    Close pairs come from a join of cells; the order of the indices is a sequence, so a shape's pairs are gone through by one task.
    """
    kind = points.schema["point_idx"].dataType.simpleString()
    near = radius_pairs(points, eps).filter("i < j").select("shape_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"].to_numpy(), t["j"].to_numpy()
        order = np.lexsort((i, j))
        to: dict[int, int] = {}
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if b not in to and a not in to:
                to[b] = a
        return pa.table({"shape_id": pa.array([t["shape_id"][0].as_py()] * len(to), t["shape_id"].type), "point_idx": pa.array(list(to), pa.int64()), "to": pa.array(list(to.values()), pa.int64())})

    shape = points.schema["shape_id"].dataType.simpleString()
    gone = near.groupBy("shape_id").applyInArrow(run, f"shape_id {shape}, point_idx long, to long")
    out = points.select("shape_id", "point_idx").join(gone.withColumn("point_idx", F.col("point_idx").cast(kind)), ["shape_id", "point_idx"], "left")
    return out.select("shape_id", "point_idx", F.coalesce(F.col("to").cast(kind), "point_idx").alias("kept"))
