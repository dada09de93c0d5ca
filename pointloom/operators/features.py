"""The 36 features of a point: neighbourhood shape at five geodesic radii, height, curvature and a geodesic histogram.

One bounded search per point gives all distances up to 1.3. The pairs get the coordinates of both ends once, and everything
that a point gathers from its neighbours is one conditional aggregate over them; only the smoothed curvature needs the pairs
again, and takes them from the same exchange.

An axis is defined only where its eigenvalue stands apart from the next one by more than `APART` of the largest: else its tilt is
0 and the point has no normal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from .graph import geodesics, knn_edges, radius_pairs
from .normalize import heights

RADII = (0.1, 0.2, 0.3, 0.4, 0.5)
NORMAL_RADIUS, MEAN_RADIUS, CUTOFF, BINS = 0.05, 0.3, 1.3, 8
APART = 1e-3
_MOMENTS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def with_neighbour(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (shape_id, src, dst, d) with the coordinates x, y, z of dst."""
    return pairs.join(points.select("shape_id", F.col("point_idx").alias("dst"), "x", "y", "z"), ["shape_id", "dst"])


def with_ends(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (shape_id, src, dst, d) with the coordinates x, y, z of dst and px, py, pz of src."""
    own = points.select("shape_id", F.col("point_idx").alias("src"), *(F.col(c).alias("p" + c) for c in "xyz"))
    return with_neighbour(pairs, points).join(own, ["shape_id", "src"])


def _moments(radii: tuple[float, ...]) -> list[Column]:
    """For each radius the mean products of the neighbours' coordinates and the variance of z."""
    out = []
    for k, r in enumerate(radii):
        of = lambda c: F.when(F.col("d") < r, c)  # noqa: B023, E731
        out += [F.avg(of(F.col(a) * F.col(b))).alias(f"m{k}_{a}{b}") for a, b in _MOMENTS] + [F.var_pop(of(F.col("z"))).alias(f"zv_{k}")]
    return out


def _shapes(sums: DataFrame, radii: tuple[float, ...], more: list[str]) -> DataFrame:
    """shape_id, point_idx, e2_k, e3_k, g1_k, g3_k, zv_k from the moments in sums, and its columns `more`.

    A row for each radius, so that the axes' long expressions stand in the plan once; the rows of a point stay together.
    """
    names = [a + b for a, b in _MOMENTS] + ["zv"]
    one = lambda k: F.struct(*[F.col(f"m{k}_{m}").alias(m) for m in names[:-1]], F.col(f"zv_{k}").alias("zv"))
    rows = sums.select("shape_id", "point_idx", *more, F.posexplode(F.array(*[one(k) for k in range(len(radii))])).alias("k", "m"))
    rows = rows.select("shape_id", "point_idx", *more, "k", "m.*")
    m = names[:-1]
    rows = G.with_eigenvalues(rows, m, "l")
    rows = G.with_eigenvector(G.with_eigenvector(rows, m, "l1", "u"), m, "l3", "w")
    some = F.col(m[0]).isNotNull()
    l1, l2, l3 = (F.col(f"l{n}") for n in (1, 2, 3))
    ratio = lambda c: F.when(some, F.coalesce(F.try_divide(c, l1), F.lit(0.0)))
    tilt = lambda n, gap: F.when(some, F.when(gap > APART * l1, F.abs(F.col(f"{n}y"))).otherwise(0.0))
    rows = rows.select("shape_id", "point_idx", *more, "k", ratio(l2).alias("e2"), ratio(l3).alias("e3"), tilt("u", l1 - l2).alias("g1"), tilt("w", l2 - l3).alias("g3"), "zv")
    wide = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in range(len(radii)) for c in ("e2", "e3", "g1", "g3", "zv")]
    return rows.groupBy("shape_id", "point_idx").agg(*wide, *(F.max(c).alias(c) for c in more))


def neighbourhoods(pairs: DataFrame, points: DataFrame, radii: tuple[float, ...] = RADII) -> DataFrame:
    """shape_id, point_idx and for the k-th radius e2_k, e3_k, g1_k, g3_k, zv_k: from the second moments of the neighbours
    (about the origin), the tilt of their first and last axis, and the variance of z. No neighbour: null."""
    sums = with_neighbour(pairs, points).groupBy("shape_id", F.col("src").alias("point_idx")).agg(*_moments(radii))
    return _shapes(sums, radii, [])


def normals(points: DataFrame, radius: float = NORMAL_RADIUS) -> DataFrame:
    """shape_id, point_idx, nx, ny, nz: the last axis of the points within radius (itself included), turned to the origin;
    null where fewer than three are near or their last axis is not defined."""
    near = radius_pairs(points, radius).select("shape_id", F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    own = points.select("shape_id", F.col("point_idx").alias("src"), F.col("point_idx").alias("dst"), F.lit(0.0).alias("d"))
    met = with_neighbour(near.union(own), points).groupBy("shape_id", F.col("src").alias("point_idx"))
    m = [a + b for a, b in _MOMENTS]
    moments = met.agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(a + b) for a, b in _MOMENTS))
    moments = G.with_eigenvector(G.with_eigenvalues(moments, m, "l"), m, "l3", "v")
    v = G.cols("v")
    both = moments.join(points.select("shape_id", "point_idx", *(F.col(c).alias("p" + c) for c in "xyz")), ["shape_id", "point_idx"])
    away = G.dot(v, G.cols("p")) > 0
    return both.select("shape_id", "point_idx", *(F.when((F.col("n") >= 3) & (F.col("l2") - F.col("l3") > APART * F.col("l1")), F.when(away, -c).otherwise(c)).alias("n" + a) for c, a in zip(v, "xyz", strict=True)))


def _bend(radius: float) -> list[Column]:
    """Sums of the unit vectors from a point to its neighbours within radius, and their number."""
    near = F.col("d") < radius
    to = G.unit(G.sub(G.cols(), G.cols("p")))
    return [F.sum(F.when(near, c)).alias("s" + a) for c, a in zip(to, "xyz", strict=True)] + [F.count(F.when(near, 1)).alias("n")]


def _curvature() -> Column:
    """From the sums of `_bend` and a normal; 0 where either is missing."""
    return F.coalesce(F.nanvl(F.try_divide(F.abs(G.dot(G.cols("s"), G.cols("n"))), F.col("n")), F.lit(0.0)), F.lit(0.0))


def curvature(pairs: DataFrame, points: DataFrame, normal: DataFrame, radius: float = NORMAL_RADIUS) -> DataFrame:
    """shape_id, point_idx, curvature: |sum of unit vectors to the neighbours within radius . normal| / their number; 0 for none."""
    sums = with_ends(pairs, points).groupBy("shape_id", F.col("src").alias("point_idx")).agg(*_bend(radius))
    return normal.join(sums, ["shape_id", "point_idx"], "left").select("shape_id", "point_idx", _curvature().alias("curvature"))


def mean_curvature(pairs: DataFrame, own: DataFrame, radius: float = MEAN_RADIUS) -> DataFrame:
    """shape_id, point_idx, mean_curvature: mean over the point and its neighbours within radius."""
    # the condition stands in the aggregate, not in a filter, so that the pairs' exchange can be shared
    # merged, as Spark takes pairs for as few as the edges they come from, and would broadcast them
    met = pairs.hint("merge").join(own.select("shape_id", F.col("point_idx").alias("dst"), F.col("curvature").alias("c")), ["shape_id", "dst"])
    near = F.col("d") < radius
    sums = met.groupBy("shape_id", F.col("src").alias("point_idx")).agg(F.sum(F.when(near, F.col("c"))).alias("s"), F.count(F.when(near, 1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(sums, ["shape_id", "point_idx"], "left").select("shape_id", "point_idx", ((F.col("curvature") + zero("s")) / (zero("n") + 1)).alias("mean_curvature"))


def _bins(cutoff: float, bins: int) -> list[Column]:
    """The numbers of kept distances in each bin."""
    b = F.floor(bins * F.col("d") / cutoff + 0.5)
    return [F.count(F.when((F.col("d") <= cutoff) & (b == k), 1)).alias(f"b{k}") for k in range(bins)]


def _shares(bins: int) -> Column:
    kept = sum((F.col(f"b{k}") for k in range(bins)), F.lit(0))
    return F.array(*[F.try_divide(F.col(f"b{k}"), kept) for k in range(bins)])


def histogram(pairs: DataFrame, *, cutoff: float = CUTOFF, bins: int = BINS) -> DataFrame:
    """shape_id, point_idx, h: share of the kept distances in each bin. Bins are rounded, so the first is half as wide and the
    distances beyond the last rounding point are left out."""
    rows = pairs.groupBy("shape_id", F.col("src").alias("point_idx")).agg(*_bins(cutoff, bins))
    return rows.select("shape_id", "point_idx", _shares(bins).alias("h"))


def features36(points: DataFrame) -> DataFrame:
    """shape_id, point_idx, f: four shape features for each of five radii, five z variances, height, curvature, mean curvature
    and eight histogram bins. Missing values are 0."""
    key = ["shape_id", "point_idx"]
    pairs = geodesics(knn_edges(points), CUTOFF).repartition("shape_id", "dst")  # one exchange for both uses
    sums = with_ends(pairs, points).groupBy("shape_id", F.col("src").alias("point_idx")).agg(*_moments(RADII), *_bend(NORMAL_RADIUS), *_bins(CUTOFF, BINS))
    gathered = _shapes(sums, RADII, ["sx", "sy", "sz", "n", *(f"b{k}" for k in range(BINS))]).withColumn("h", _shares(BINS))
    own = normals(points).join(gathered, key, "left").withColumn("curvature", _curvature())
    smooth = mean_curvature(pairs, own.select(*key, "curvature"))
    out = own.join(smooth, key).join(heights(points).select(*key, "height"), key)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = [zero(F.col(f"{n}_{k}")) for k in range(len(RADII)) for n in ("e2", "e3", "g1", "g3")] + [zero(F.col(f"zv_{k}")) for k in range(len(RADII))]
    columns += [zero(F.col(c)) for c in ("height", "curvature", "mean_curvature")] + [zero(F.get("h", F.lit(k))) for k in range(BINS)]
    return out.select(*key, F.array(*columns).alias("f"))
