"""A tree of cells over a mesh's triangles, and searches that go down it: nearest triangle, rays, winding numbers.

Each shape's bounding cube is cut into cells by four per axis and level, the smallest about as wide as its faces are long. A face is
in the smallest cell that holds its centre. A cell, and each cell above it, lists the box around the faces in it and one of their
corners.

A search goes down level by level, a join of what is still open with the listed children of its cells. Nearest triangle: a child stays
if its box is not farther than the least distance known of the query, to a corner that some cell lists (branch and bound;
equally near ones all stay). Rays: a child stays if the ray passes its box. Winding numbers: a child that is far enough counts by
its moments, others stay. What stays meets the faces of its cells. Rows grow
with the queries and the cells near each answer, never with faces times queries, and no group holds a shape: joins are on shape
and cell, minima on shape and query. Each level is a written table.

Cases: faces with a null or unknown corner are no faces; queries with a null coordinate have no row, nor have those of shapes
without faces; faces of no area count as the segment or point that they are; equally near faces give the first; a face that is far
longer than others widens the boxes above it alone; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from ..shared import written
from .sampling import corners

#: Cells per axis of a cell, and the most levels below a shape's cube.
BRANCH, LEVELS = 4, 10
#: Width of the smallest cells as a multiple of the faces' mean length.
ROOM = 1.25
#: Width of the smallest cells as a multiple of the faces' mean length.
ROOM = 1.25

_AT = ("ix", "iy", "iz")
_UP = ("ux", "uy", "uz")
_BOX = [c + e for e in "01" for c in "xyz"]


@dataclass
class FaceTree:
    """roots: shape_id, level; cells: shape_id, level, ux.. (the cell above), ix.., x0.. to z1 (the box around its faces), rx.. (a corner of one);
    faces: shape_id, ix.., f_idx and the corners ax .. cz of its triangle."""

    roots: DataFrame
    cells: DataFrame
    faces: DataFrame
    depth: int


def face_tree(faces: DataFrame, vertices: DataFrame) -> FaceTree:
    """The tree over faces (shape_id, f_idx, v0, v1, v2)."""
    names = [p + c for p in "abc" for c in "xyz"]
    tri = corners(faces, vertices).select("shape_id", "f_idx", *names).dropna()
    low = {c: F.least(*(F.col(p + c) for p in "abc")) for c in "xyz"}
    high = {c: F.greatest(*(F.col(p + c) for p in "abc")) for c in "xyz"}
    size = F.greatest(*(high[c] - low[c] for c in "xyz"))
    frame = tri.groupBy("shape_id").agg(*(F.min(low[c]).alias("l" + c) for c in "xyz"), *(F.max(high[c]).alias("h" + c) for c in "xyz"), F.avg(size).alias("mean"))
    side = F.greatest(*(F.col("h" + c) - F.col("l" + c) for c in "xyz"))
    least = F.greatest(ROOM * F.col("mean"), side / float(BRANCH) ** LEVELS)
    frame = frame.select("shape_id", *("l" + c for c in "xyz"), side.alias("side"), F.when(least > 0, least).otherwise(1.0).alias("w"))
    top = F.ceil(F.log(float(BRANCH), F.greatest(F.col("side") / F.col("w"), F.lit(1.0))))
    frame = written(frame.withColumn("top", F.greatest(F.lit(1), top).cast("int")), "frames")
    cell = lambda c: F.floor(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3 - F.col("l" + c)) / F.col("w"))
    placed = tri.join(frame, "shape_id")
    held = written(placed.select("shape_id", *(F.greatest(F.lit(0).cast("long"), cell(c)).alias("i" + c) for c in "xyz"), "f_idx", *names, "top"), "tree-faces")
    rows = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top") - 1)))
    into = F.pow(F.lit(float(BRANCH)), "level").cast("long")
    rows = rows.withColumns({c: F.floor(F.col(c) / into) for c in _AT})
    box = [F.min(low[c]).alias(c + "0") for c in "xyz"] + [F.max(high[c]).alias(c + "1") for c in "xyz"]
    cells = rows.groupBy("shape_id", "level", *_AT).agg(*box, F.min(F.struct("ax", "ay", "az")).alias("r"), F.max("top").alias("top"))
    # all cells below the top level hang under the root, which is not listed
    up = [F.when(F.col("level") == F.col("top") - 1, 0).otherwise(F.floor(F.col(c) / BRANCH)).cast("long").alias(u) for c, u in zip(_AT, _UP, strict=True)]
    cells = cells.select("shape_id", "level", *up, *_AT, *_BOX, *(F.col("r")["a" + c].alias("r" + c) for c in "xyz"))
    depth = frame.agg(F.max("top")).first()[0]
    return FaceTree(frame.select("shape_id", F.col("top").alias("level")), written(cells, "tree-cells"), held.drop("top"), depth or 0)


def _descend(open_: DataFrame | None, start: DataFrame, tree: FaceTree, level: int) -> DataFrame:
    """What is open at a level's cells, and what starts there, with the listed cells one level below (which become ix..)."""
    begin = start.filter(F.col("level") == level).drop("level")
    rows = begin if open_ is None else open_.unionByName(begin)
    below = tree.cells.filter(F.col("level") == level - 1).drop("level")
    return rows.withColumnsRenamed(dict(zip(_AT, _UP, strict=True))).join(below, ["shape_id", *_UP]).drop(*_UP)


def _start(queries: DataFrame, tree: FaceTree) -> DataFrame:
    """queries with the level and the cell of their shape's root."""
    return queries.join(tree.roots, "shape_id").withColumns({c: F.lit(0).cast("long") for c in _AT})


def box_distance2(p: G.Vec, low: G.Vec, high: G.Vec) -> Column:
    """Squared distance from p to a box, 0 inside."""
    gaps = tuple(F.greatest(F.lit(0.0), lo - x, x - hi) for x, lo, hi in zip(p, low, high, strict=True))
    return G.dot(gaps, gaps)


def ray_meets_box(o: G.Vec, d: G.Vec, low: G.Vec, high: G.Vec) -> Column:
    """Whether a ray from o along d meets a box (slabs; a ray within a side's plane meets it), the box widened against rounding."""
    near, far, beside = [], [], []
    for p, v, lo, hi in zip(o, d, low, high, strict=True):
        room = 1e-12 * (F.abs(p) + F.abs(lo) + F.abs(hi))
        lo, hi = lo - room, hi + room
        a, b = F.try_divide(lo - p, v), F.try_divide(hi - p, v)
        near.append(F.least(a, b))
        far.append(F.greatest(a, b))
        beside.append((v != 0) | ((lo <= p) & (p <= hi)))
    enter = F.greatest(F.lit(0.0), *near)  # nulls, of directions without this axis, do not count
    leave = F.least(F.lit(float("inf")), *far)
    return reduce(lambda x, y: x & y, beside, enter <= leave)


def nearest_on_triangle(p: G.Vec) -> Column:
    """Squared distance from p to the triangle of columns a, b, c: to its plane if the foot lies inside, else to the nearest side."""
    a, b, c = (G.cols(n) for n in "abc")

    def to_side(u: G.Vec, v: G.Vec) -> Column:
        e, w = G.sub(v, u), G.sub(p, u)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(G.dot(w, e), G.dot(e, e)), F.lit(0.0))))
        d = G.sub(w, G.scale(e, t))
        return G.dot(d, d)

    n = G.cross(G.sub(b, a), G.sub(c, a))
    inside = [G.dot(G.cross(G.sub(v, u), G.sub(p, u)), n) >= 0 for u, v in ((a, b), (b, c), (c, a))]
    height = G.dot(G.sub(p, a), n)
    return F.when(inside[0] & inside[1] & inside[2] & (G.dot(n, n) > 0), F.try_divide(height * height, G.dot(n, n))).otherwise(F.least(to_side(a, b), to_side(b, c), to_side(c, a)))


def nearest_faces(points: DataFrame, tree: FaceTree) -> DataFrame:
    """shape_id, q_idx, d2, f_idx: the squared distance of points (shape_id, q_idx, x, y, z) to their shape's mesh, and the first
    face at it."""
    points = points.select("shape_id", "q_idx", *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna()
    key, keep = ["shape_id", "q_idx"], ["shape_id", "q_idx", "x", "y", "z", *_AT, "best"]
    low, high = (tuple(F.col(c + e) for c in "xyz") for e in "01")
    start, open_ = _start(points, tree).withColumn("best", F.lit(float("inf"))), None
    for level in range(tree.depth, 0, -1):
        down = _descend(open_, start, tree, level).withColumns({"low2": box_distance2(G.cols(), low, high), "high2": G.squared_distance(G.cols(), G.cols("r"))})
        down = down.filter(F.col("low2") <= F.col("best"))
        known = F.least("best", F.min("high2").over(W.partitionBy(*key)) * (1 + 1e-9))  # what rounding may take from a bound
        open_ = written(down.withColumn("best", known).filter(F.col("low2") <= F.col("best")).select(*keep), f"nearest-{level}")
    if open_ is None:
        open_ = start.drop("level")  # no shape has faces
    met = open_.join(tree.faces, ["shape_id", *_AT]).select(*key, F.struct(nearest_on_triangle(G.cols()).alias("d2"), "f_idx").alias("at"))
    return met.groupBy(*key).agg(F.min("at").alias("at")).select(*key, "at.d2", "at.f_idx")


def ray_hits(rays: DataFrame, tree: FaceTree) -> DataFrame:
    """shape_id, q_idx, f_idx, t, u, v: where rays (shape_id, q_idx, x, y, z, dx, dy, dz) meet the faces of their shape, on either
    side and ahead of their start: at t times the direction, with weights u and v of the second and third corner."""
    keep = ["shape_id", "q_idx", "x", "y", "z", "dx", "dy", "dz"]
    rays = rays.select("shape_id", "q_idx", *(F.col(c).cast("double").alias(c) for c in keep[2:])).dropna()
    o, d = G.cols(), G.cols("d")
    low, high = (tuple(F.col(c + e) for c in "xyz") for e in "01")
    start, open_ = _start(rays, tree), None
    for level in range(tree.depth, 0, -1):
        down = _descend(open_, start, tree, level).filter(ray_meets_box(o, d, low, high))
        open_ = written(down.select(*keep, *_AT), f"rays-{level}")
    met = (open_ if open_ is not None else start).join(tree.faces, ["shape_id", *_AT])
    a, b, c = (G.cols(n) for n in "abc")
    first, second = G.sub(b, a), G.sub(c, a)
    met = met.withColumns({f"_p{k}": x for k, x in zip("xyz", G.cross(d, second), strict=True)})
    from_corner = G.sub(o, a)
    met = met.withColumns({"_det": G.dot(first, G.cols("_p")), **{f"_q{k}": x for k, x in zip("xyz", G.cross(from_corner, first), strict=True)}})
    share = lambda x: F.try_divide(x, F.col("_det"))
    hit = met.select("shape_id", "q_idx", "f_idx", share(G.dot(second, G.cols("_q"))).alias("t"), share(G.dot(from_corner, G.cols("_p"))).alias("u"), share(G.dot(d, G.cols("_q"))).alias("v"))
    return hit.filter("t > 0 and u >= 0 and v >= 0 and u + v <= 1")


def solid_angle(a: G.Vec, b: G.Vec, c: G.Vec) -> Column:
    """Of a triangle seen from the origin: positive where its corners turn left for one who looks at its outer side."""
    la, lb, lc = (G.norm(v) for v in (a, b, c))
    return 2 * F.atan2(G.dot(a, G.cross(b, c)), la * lb * lc + G.dot(a, b) * lc + G.dot(b, c) * la + G.dot(c, a) * lb)


def _moments(tree: FaceTree) -> FaceTree:
    """The tree whose cells hold, beside their boxes, sums over their faces: area, nx.. (areas times normals), m00 .. m22 (these times the
    faces' centres)."""
    a, b, c = (G.cols(n) for n in "abc")
    normal = G.scale(G.cross(G.sub(b, a), G.sub(c, a)), 0.5)
    centre = G.scale(G.add(a, b, c), 1 / 3)
    f = tree.faces.join(tree.roots.withColumnRenamed("level", "top"), "shape_id")
    f = f.withColumns({"n" + k: v for k, v in zip("xyz", normal, strict=True)} | {"g" + k: v for k, v in zip("xyz", centre, strict=True)})
    f = f.withColumn("area", G.norm(G.cols("n"))).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top") - 1)))
    into = F.pow(F.lit(float(BRANCH)), "level").cast("long")
    f = f.withColumns({k: F.floor(F.col(k) / into) for k in _AT})
    outer = [F.sum(F.col("n" + p) * F.col("g" + q)).alias(f"m{i}{j}") for i, p in enumerate("xyz") for j, q in enumerate("xyz")]
    sums = f.groupBy("shape_id", "level", *_AT).agg(F.sum("area").alias("area"), *(F.sum("n" + k).alias("n" + k) for k in "xyz"), *outer)
    return FaceTree(tree.roots, written(tree.cells.join(sums, ["shape_id", "level", *_AT]), "tree-moments"), tree.faces, tree.depth)


def winding_numbers(points: DataFrame, tree: FaceTree, *, error: float = 1e-4) -> DataFrame:
    """shape_id, q_idx, w: the solid angle of all faces seen from each of points (shape_id, q_idx, x, y, z), over 4 pi, within `error`.

    A cell of radius r whose centre lies at distance R counts by the first two terms of its expansion where 3 r^2 / (4 pi (R - r)^4) times
    the shape's whole area is at most `error`. The next term is bounded by that with the cell's own area: a third derivative of 1/x is
    at most 6/x^4, and a face of area A within r adds half of it times A r^2. So all cells together add at most `error`.
    """
    tree = _moments(tree)
    points = points.select("shape_id", "q_idx", *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna()
    whole = tree.cells.join(tree.roots, "shape_id").filter(tree.cells["level"] == tree.roots["level"] - 1).groupBy("shape_id").agg(F.sum("area").alias("whole"))
    key, keep = ["shape_id", "q_idx"], ["shape_id", "q_idx", "x", "y", "z", "whole"]
    start, open_, told = _start(points.join(whole, "shape_id"), tree), None, []
    low, high = (tuple(F.col(c + e) for c in "xyz") for e in "01")
    for level in range(tree.depth, 0, -1):
        down = _descend(open_, start, tree, level)
        to = [(lo + hi) / 2 - x for lo, hi, x in zip(low, high, G.cols(), strict=True)]
        down = down.withColumns({"d" + k: v for k, v in zip("xyz", to, strict=True)} | {"r2": G.squared_distance(high, low) / 4})
        d = G.cols("d")
        down = down.withColumn("far", G.norm(d)).withColumn("gap", F.col("far") - F.sqrt("r2"))
        far, gap = F.col("far"), F.col("gap")
        counts = (gap > 0) & (3 * F.col("r2") * F.col("whole") <= 4 * math.pi * error * gap * gap * gap * gap)
        n, third = G.cols("n"), far * far * far
        # moments about the cell's centre, against the derivatives of x / |x|^3
        m = [[F.col(f"m{i}{j}") - n[i] * (low[j] + high[j]) / 2 for j in range(3)] for i in range(3)]
        trace = m[0][0] + m[1][1] + m[2][2]
        bent = reduce(lambda x, y: x + y, [m[i][j] * d[i] * d[j] for i in range(3) for j in range(3)])
        w = (G.dot(n, d) + trace - 3 * bent / (far * far)) / third / (4 * math.pi)
        down = down.withColumn("w", F.when(counts, w)).select(*keep, *(F.when(F.col("w").isNull(), F.col(c)).alias(c) for c in _AT), "w")
        # a row for each cell that stays, one for all that count
        met = written(down.groupBy(*keep, *_AT).agg(F.sum("w").alias("w")), f"winding-{level}")
        told.append(met.filter("ix is null").select(*key, "w"))
        open_ = met.filter("ix is not null").drop("w")
    seen = (open_ if open_ is not None else start).join(tree.faces, ["shape_id", *_AT])
    a, b, c = (G.sub(G.cols(k), G.cols()) for k in "abc")
    seen = seen.withColumns({f"{k}{x}_": v for k, vec in zip("abc", (a, b, c), strict=True) for x, v in zip("xyz", vec, strict=True)})
    exact = seen.select(*key, (solid_angle(*(tuple(F.col(f"{k}{x}_") for x in "xyz") for k in "abc")) / (4 * math.pi)).alias("w"))
    return reduce(DataFrame.union, told, exact.groupBy(*key).agg(F.sum("w").alias("w"))).groupBy(*key).agg(F.sum("w").alias("w"))
