"""Tetrahedral meshes: tets(shape_id, t_idx, v0, v1, v2, v3) on vertices(shape_id, v_idx, x, y, z).

Corners are joined once; what tets share is found by grouping their facets. A tet with an unknown corner has no volume and no angles
but its facets count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G

CORNERS = ("v0", "v1", "v2", "v3")
#: The order of a tet's edges.
EDGES = ((3, 0), (3, 1), (3, 2), (1, 2), (2, 0), (0, 1))
#: The facet across each corner, seen from outside a tet of positive volume.
FACETS = ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))


def with_corners(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """tets with the coordinates p0x, p0y, .. p3z of their corners."""
    for k, v in enumerate(CORNERS):
        tets = tets.join(vertices.select("shape_id", F.col("v_idx").alias(v), *(F.col(c).alias(f"p{k}{c}") for c in "xyz")), ["shape_id", v])
    return tets


def _p(k: int) -> G.Vec:
    return G.cols(f"p{k}")


def volumes(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, t_idx, volume: positive where corners 1, 2, 3 turn left for one who looks from corner 0's far side."""
    a, b, c = (G.sub(_p(k), _p(0)) for k in (1, 2, 3))
    return with_corners(tets, vertices).select("shape_id", "t_idx", (G.dot(a, G.cross(b, c)) / 6).alias("volume"))


def facets(tets: DataFrame) -> DataFrame:
    """shape_id, t_idx, k, a, b, c: the facet across corner k, turned outward in tets of positive volume."""
    each = F.posexplode(F.array(*[F.struct(*(F.col(CORNERS[i]).alias(n) for n, i in zip("abc", f, strict=True))) for f in FACETS])).alias("k", "f")
    return tets.select("shape_id", "t_idx", each).select("shape_id", "t_idx", "k", "f.*")


def _same(f: DataFrame) -> list[Column]:
    """Keys of facets with the same corners."""
    s = F.array_sort(F.array("a", "b", "c"))
    return [F.get(s, F.lit(i)).alias(n) for i, n in enumerate(("p", "q", "r"))]


def boundary(tets: DataFrame) -> DataFrame:
    """shape_id, t_idx, k, a, b, c: facets that one tet alone has."""
    f = facets(tets)
    alone = f.groupBy("shape_id", *_same(f)).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t_idx", "k", "a", "b", "c")).alias("f")).filter("n = 1")
    return alone.select("shape_id", "f.*")


def on_boundary(tets: DataFrame) -> DataFrame:
    """shape_id, t_idx, on_boundary, c0 .. c3: whether the facet across each corner belongs to no other tet, and whether any does."""
    alone = boundary(tets).groupBy("shape_id", "t_idx").agg(*(F.max(F.when(F.col("k") == k, True)).alias(f"c{k}") for k in range(4)))
    out = tets.select("shape_id", "t_idx").join(alone, ["shape_id", "t_idx"], "left")
    c = [F.coalesce(F.col(f"c{k}"), F.lit(False)) for k in range(4)]
    return out.select("shape_id", "t_idx", (c[0] | c[1] | c[2] | c[3]).alias("on_boundary"), *(x.alias(f"c{k}") for k, x in enumerate(c)))


def dihedral_angles(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, t_idx, k, theta: the inner angle between the two facets at the k-th edge, in radians."""

    def angle(i: int, j: int) -> Column:
        r, s = (k for k in range(4) if k not in (i, j))
        e = G.sub(_p(j), _p(i))
        u, w = G.cross(e, G.sub(_p(r), _p(i))), G.cross(e, G.sub(_p(s), _p(i)))  # across the edge, either facet's
        return F.atan2(G.norm(G.cross(u, w)), G.dot(u, w))

    met = with_corners(tets, vertices)
    return met.select("shape_id", "t_idx", F.posexplode(F.array(*[angle(i, j) for i, j in EDGES])).alias("k", "theta"))
