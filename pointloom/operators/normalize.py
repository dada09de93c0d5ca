"""Moving and scaling whole shapes: each is one grouped aggregate joined back on shape_id, or row expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G

AXES = "xyz"


def bounding_box(points: DataFrame, *, compat: bool = False) -> DataFrame:
    """shape_id, lo_* and hi_* of each axis. `compat`: no upper bound below the smallest positive double."""
    hi = lambda a: F.greatest(F.max(a), F.lit(G.SMALLEST)) if compat else F.max(a)
    return points.groupBy("shape_id").agg(*(F.min(a).alias(f"lo_{a}") for a in AXES), *(hi(a).alias(f"hi_{a}") for a in AXES))


def _box(points: DataFrame, compat: bool) -> tuple[DataFrame, dict[str, Column], Column]:
    """Points with their box, its centre and diagonal."""
    joined = points.join(bounding_box(points, compat=compat), "shape_id")
    size = tuple(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES)
    return joined, {a: (F.col(f"hi_{a}") + F.col(f"lo_{a}")) / 2 for a in AXES}, G.norm(size)


def _moved(joined: DataFrame, points: DataFrame, xyz: dict[str, Column]) -> DataFrame:
    return joined.select(*(xyz[c].alias(c) if c in xyz else F.col(c) for c in points.columns))


def normalize_points(points: DataFrame, *, compat: bool = False, skip_normal: bool = True) -> DataFrame:
    """Diagonal 1, centred in x and y, standing on z = 0. A shape that is so already stays as it is if `skip_normal`.

    A shape without extent gets null coordinates.
    """
    joined, center, d = _box(points, compat)
    base = center | {"z": center["z"] - (F.col("hi_z") - F.col("lo_z")) / 2}
    done = (F.abs(d - 1) < 1e-5) & (G.norm(tuple(base.values())) < 1e-5) if skip_normal else F.lit(False)
    return _moved(joined, points, {a: F.when(done, F.col(a)).otherwise(F.try_divide(F.col(a) - base[a], d)) for a in AXES})


def normalize_lifted(points: DataFrame, *, compat: bool = False) -> DataFrame:
    """Centred and scaled by the diagonal, then lifted by the scaled distance from the centre to the lowest point."""
    joined, center, d = _box(points, compat)
    lift = F.try_divide(F.col("lo_z") - center["z"], d)
    xyz = {a: F.try_divide(F.col(a) - center[a], d) for a in AXES}
    return _moved(joined, points, xyz | {"z": xyz["z"] - lift})


def normalize_mesh(points: DataFrame) -> DataFrame:
    """Scaled by twice the largest distance from the box centre, centred in x and y, standing on z = 0."""
    joined, center, _ = _box(points, False)
    far = joined.groupBy("shape_id").agg((2 * F.max(G.norm(tuple(F.col(a) - center[a] for a in AXES)))).alias("span"))
    joined = joined.join(far, "shape_id")
    lift = {"x": F.lit(0.0), "y": F.lit(0.0), "z": (F.col("hi_z") - F.col("lo_z")) / 2}
    return _moved(joined, points, {a: F.try_divide(F.col(a) - center[a] + lift[a], F.col("span")) for a in AXES})


def rotate(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    return points.withColumns(dict(zip(AXES, G.apply(matrix, G.cols()), strict=True)))


def rotate_axis_angle(points: DataFrame, *, axis: Sequence[float], degrees: float) -> DataFrame:
    return rotate(points, G.rotation(axis, degrees))


#: The fixed turn of preprocessing: a quarter about x after a quarter back about y.
UPRIGHT = G.matmul(G.rotation((1, 0, 0), 90), G.rotation((0, 1, 0), -90))


def rotate_fixed(points: DataFrame) -> DataFrame:
    return rotate(points, UPRIGHT)


def translate(points: DataFrame, by: Sequence[float]) -> DataFrame:
    return points.withColumns({a: F.col(a) + float(d) for a, d in zip(AXES, by, strict=True)})


def rescale(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumns({a: F.col(a) * float(factor) for a in AXES})


def moved(points: DataFrame, steps: Sequence[tuple[Sequence[float], float]]) -> DataFrame:
    """Translates and rescales in turn: each step shifts by a vector, then multiplies by a factor."""
    for by, factor in steps:
        points = rescale(translate(points, by), factor)
    return points


def restored(points: DataFrame, steps: Sequence[tuple[Sequence[float], float]]) -> DataFrame:
    """Undoes `moved` with the same steps; no factor may be 0."""
    for by, factor in reversed(steps):
        points = translate(rescale(points, 1 / factor), [-float(d) for d in by])
    return points


def heights(points: DataFrame) -> DataFrame:
    """Adds height: z above the shape's lowest point."""
    low = points.groupBy("shape_id").agg(F.min("z").alias("low"))
    return points.join(low, "shape_id").withColumn("height", F.col("z") - F.col("low")).drop("low")
