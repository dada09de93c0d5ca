"""Enclosing balls, the one per-shape Arrow kernel here, farthest-point groups and alignment from aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..shared import written


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _coordinates(t: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in columns], 1).astype(float)


def ball(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the smallest ball around points of any dimension.

    The centre walks towards the point of its support's flat that is equally far from all support points, until a new point
    touches the ball; a support point whose share in that flat is negative leaves. A ball is the smallest one if its centre is a mean of
    points on it with shares that are not negative; where rounding leaves no such shares, that is an error.
    """
    center = p[0].copy()
    far = int(((p - center) ** 2).sum(1).argmax())
    support = [far]
    radius2 = ((p[far] - center) ** 2).sum()
    for _ in range(100 * (len(p) + p.shape[1])):
        if len(support) > p.shape[1] + 1:
            support.pop(0)
        base = p[support[0]]
        span = (p[support[1:]] - base).T
        q = np.linalg.qr(span)[0] if len(support) > 1 else np.zeros((p.shape[1], 0))
        target = base + q @ (q.T @ (center - base))  # the flat's point nearest to the centre: as far from all of the support
        step = target - center
        if np.linalg.norm(step) <= 1e-12 * max(1.0, np.sqrt(radius2)):
            shares = np.linalg.lstsq(span, center - base, rcond=None)[0] if len(support) > 1 else np.zeros(0)
            weights = np.r_[1 - shares.sum(), shares]
            if weights.min() >= -1e-10 or len(support) == 1:
                break
            support.pop(int(weights.argmin()))
            continue
        # how far the centre may go until a point outside the support is as far away as the support
        gap = ((p - center) ** 2).sum(1)
        slope = 2 * (p - base) @ step
        room = radius2 - gap
        limit = np.divide(room, -slope, out=np.full(len(p), np.inf), where=slope < -1e-14)
        limit[support] = np.inf
        k = int(limit.argmin())
        t = min(1.0, max(0.0, float(limit[k])))
        center = center + t * step
        radius2 = ((base - center) ** 2).sum()
        if t < 1.0:
            support.append(k)
    else:
        raise ValueError("no smallest ball was found within rounding")
    return center, float(np.sqrt(((p - center) ** 2).sum(1).max()))


def enclosing_balls(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """shape_id, center, radius of the smallest ball around each shape's points."""

    def run(t: pa.Table) -> pa.Table:
        c, r = ball(_coordinates(t, columns))
        return pa.table({"shape_id": t["shape_id"][:1], "center": pa.array([c.tolist()], pa.list_(pa.float64())), "radius": pa.array([r])})

    return points.select("shape_id", *columns).groupBy("shape_id").applyInArrow(run, f"shape_id {_kind(points, 'shape_id')}, center array<double>, radius double")


def farthest_groups(points: DataFrame, k: int) -> DataFrame:
    """shape_id, point_idx, seed, d2: k seeds, each the point farthest from those before it (the first: the first point; ties go to the
    smaller index), and the nearest seed of each point. A round for each seed: an aggregate finds it, a join of one row a shape tells all."""
    state = points.select("shape_id", "point_idx", "x", "y", "z").withColumns({"seed": F.lit(0), "d2": F.lit(float("inf"))})
    for g in range(k):
        state = written(state, "groups")
        best = F.max_by(F.struct("x", "y", "z"), F.struct("d2", -F.col("point_idx"))).alias("s")
        left = F.max(F.when(F.lit(g > 0) & (F.col("d2") <= 0), F.lit(0)).otherwise(F.lit(1))).alias("left")  # no point is apart from all seeds
        seed = state.groupBy("shape_id").agg(best, left)
        d2 = G.squared_distance(G.cols(), tuple(F.col("s")[c] for c in "xyz"))
        met = state.join(seed, "shape_id").withColumn("n", d2)
        closer = (F.col("n") < F.col("d2")) & (F.col("left") > 0)
        state = met.select("shape_id", "point_idx", "x", "y", "z", F.when(closer, F.lit(g)).otherwise(F.col("seed")).alias("seed"), F.when(closer, F.col("n")).otherwise(F.col("d2")).alias("d2"))
    return state.select("shape_id", "point_idx", "seed", "d2")


def align(pairs: DataFrame, *, scaling: bool = True) -> DataFrame:
    """shape_id, scale, rotation (by rows), shift: the similarity that takes points (x, y, z) closest to their partners (u, v, w).

    Means and products are aggregates; the turn comes from the singular vectors of one 3 x 3 matrix a shape.
    """
    names = [(p, q) for p in "uvw" for q in "xyz"]
    sums = pairs.groupBy("shape_id").agg(
        *(F.avg(c).alias(c) for c in "xyzuvw"),
        F.array(*(F.covar_pop(p, q) for p, q in names)).alias("m"),
        (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("size"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            a, to = _coordinates(t, ("x", "y", "z")), _coordinates(t, ("u", "v", "w"))
            m, size = np.array(t["m"].to_pylist(), float).reshape(-1, 3, 3), t["size"].to_numpy()
            left, s, right = np.linalg.svd(m)
            flip = np.ones((len(m), 3))
            flip[:, 2] = np.where(np.linalg.det(left @ right) < 0, -1.0, 1.0)
            turn = (left * flip[:, None]) @ right
            scale = np.where(scaling & (size > 0), (s * flip).sum(1) / np.where(size > 0, size, 1.0), 1.0)
            shift = to - scale[:, None] * (turn @ a[:, :, None])[:, :, 0]
            rows = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b["shape_id"], pa.array(scale), pa.array(turn.reshape(-1, 9).tolist(), rows), pa.array(shift.tolist(), rows)], ["shape_id", "scale", "rotation", "shift"])

    return sums.mapInArrow(run, f"shape_id {_kind(pairs, 'shape_id')}, scale double, rotation array<double>, shift array<double>")
