"""Mesh operators on vertices(shape_id, v_idx, x, y, z) and faces(shape_id, f_idx, v0, v1, v2)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G
from ..shared import written
from . import linking, surface
from .graph import components, nearest_of
from .relational import before
from .sampling import corners

SIDES = (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))


def directed_edges(faces: DataFrame) -> DataFrame:
    """shape_id, f_idx, k, u, v: the three directed edges of each face; edge k lies across corner k + 2."""
    e = F.posexplode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in SIDES])).alias("k", "e")
    return faces.select("shape_id", "f_idx", e).select("shape_id", "f_idx", "k", "e.u", "e.v")


def edge_counts(faces: DataFrame) -> DataFrame:
    """shape_id, a, b, faces, turns: undirected edges, how many faces hold each, and the sum of their directions."""
    sign = F.when(F.col("u") < F.col("v"), 1).otherwise(-1)
    return directed_edges(faces).groupBy("shape_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("faces"), F.sum(sign).alias("turns"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).filter("faces = 1").select("shape_id", "a", "b")


def boundary_facets(faces: DataFrame) -> DataFrame:
    """Edges whose number of faces is not two."""
    return edge_counts(faces).filter("faces <> 2").select("shape_id", "a", "b", "faces")


def exterior_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).filter("turns <> 0").select("shape_id", "a", "b", "turns")


def edge_manifold(faces: DataFrame) -> DataFrame:
    """shape_id, manifold: no edge with more than two faces."""
    return edge_counts(faces).groupBy("shape_id").agg((F.max("faces") <= 2).alias("manifold"))


def face_neighbours(faces: DataFrame) -> DataFrame:
    """shape_id, f_idx, k, other: the face across each directed edge, -1 on a border; of several the smallest."""
    d = directed_edges(faces).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    o = d.select("shape_id", "a", "b", F.col("f_idx").alias("other"))
    met = d.join(o, ["shape_id", "a", "b"]).groupBy("shape_id", "f_idx", "k")
    return met.agg(F.coalesce(F.min(F.when(F.col("other") != F.col("f_idx"), F.col("other"))), F.lit(-1)).alias("other"))


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, f_idx, l0, l1, l2: the length opposite each corner."""
    a, b, c = (G.cols(p) for p in "abc")
    return corners(faces, vertices).select("shape_id", "f_idx", G.norm(G.sub(b, c)).alias("l0"), G.norm(G.sub(c, a)).alias("l1"), G.norm(G.sub(a, b)).alias("l2"))


def mean_edge_length(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    l = edge_lengths(faces, vertices)  # noqa: E741
    return l.groupBy("shape_id").agg((F.sum(F.col("l0") + F.col("l1") + F.col("l2")) / (3 * F.count(F.lit(1)))).alias("mean_length"))


def internal_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, f_idx, t0, t1, t2: the angle at each corner, by the law of cosines."""
    l = edge_lengths(faces, vertices)  # noqa: E741
    at = lambda o, p, q: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(p) * F.col(p) + F.col(q) * F.col(q) - F.col(o) * F.col(o), 2 * F.col(p) * F.col(q)))))
    return l.select("shape_id", "f_idx", at("l0", "l1", "l2").alias("t0"), at("l1", "l2", "l0").alias("t1"), at("l2", "l0", "l1").alias("t2"))


def cotangents(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, f_idx, c0, c1, c2: half the cotangent at each corner; null for a face without area."""
    a, b, c = (G.cols(p) for p in "abc")
    area2 = 2 * G.cross_area(a, b, c)
    half = lambda p, q: F.try_divide(G.dot(p, q), 2 * area2)
    return corners(faces, vertices).select(
        "shape_id", "f_idx", "v0", "v1", "v2", half(G.sub(b, a), G.sub(c, a)).alias("c0"), half(G.sub(a, b), G.sub(c, b)).alias("c1"), half(G.sub(a, c), G.sub(b, c)).alias("c2")
    )


def laplacian(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, i, j, v: the cotangent matrix, off-diagonal weights summed and rows summing to 0."""
    c = cotangents(faces, vertices)
    sides = (("v1", "v2", "c0"), ("v2", "v0", "c1"), ("v0", "v1", "c2"))
    t = [F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (F.col(w) * s).alias("v")) for a, b, w in sides for p, q, s in ((a, b, 1), (b, a, 1), (a, a, -1), (b, b, -1))]
    e = c.select("shape_id", F.explode(F.array(*t)).alias("e")).select("shape_id", "e.*")
    return e.groupBy("shape_id", "i", "j").agg(F.sum("v").alias("v"))


def mass(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, v_idx, mass: a third of the area of the faces at a vertex."""
    a, b, c = (G.cols(p) for p in "abc")
    f = corners(faces, vertices).withColumn("third", G.cross_area(a, b, c) / 3)
    return f.select("shape_id", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"), "third").groupBy("shape_id", "v_idx").agg(F.sum("third").alias("mass"))


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, f_idx, nx, ny, nz, area2 (twice the area); null for a face without area."""
    a, b, c = (G.cols(p) for p in "abc")
    n = G.cross(G.sub(b, a), G.sub(c, a))
    return corners(faces, vertices).select("shape_id", "f_idx", "v0", "v1", "v2", *(u.alias("n" + k) for u, k in zip(G.unit(n), "xyz", strict=True)), G.norm(n).alias("area2"))


def vertex_normals(faces: DataFrame, vertices: DataFrame, *, weight: str = "area") -> DataFrame:
    """shape_id, v_idx, nx, ny, nz: face normals weighted by area, by the corner's angle, or equally, made unit vectors."""
    n = face_normals(faces, vertices)
    if weight == "angle":
        n = n.join(internal_angles(faces, vertices), ["shape_id", "f_idx"])
        corner = F.array(*[F.struct(F.col(f"v{k}").alias("v_idx"), F.col(f"t{k}").alias("w")) for k in range(3)])
    else:
        w = F.col("area2") if weight == "area" else F.lit(1.0)
        corner = F.array(*[F.struct(F.col(f"v{k}").alias("v_idx"), w.alias("w")) for k in range(3)])
    met = n.select("shape_id", "nx", "ny", "nz", F.explode(corner).alias("c")).groupBy("shape_id", F.col("c.v_idx").alias("v_idx"))
    s = met.agg(*(F.sum(F.col("n" + k) * F.col("c.w")).alias("s" + k) for k in "xyz"))
    return s.select("shape_id", "v_idx", *(u.alias("n" + k) for u, k in zip(G.unit(G.cols("s")), "xyz", strict=True)))


def rings(faces: DataFrame, depth: int) -> DataFrame:
    """shape_id, u, v: all pairs of different vertices at most `depth` edges apart, in both directions."""
    step = edge_counts(faces).select("shape_id", "a", "b")
    step = step.union(step.select("shape_id", F.col("b"), F.col("a"))).toDF("shape_id", "u", "v")
    out = step
    for _ in range(depth - 1):
        out = out.union(out.join(step.toDF("shape_id", "v", "w"), ["shape_id", "v"]).select("shape_id", "u", F.col("w").alias("v"))).filter("u <> v").distinct()
    return out


#: A block has vertices whose numbers are equal but for so many bits; so many of them gather their sums at once.
_BITS, _AT_ONCE = 17, 8192
_CORNERS = ("v0", "v1", "v2")
#: Powers of u and v in a height, and those that occur in its normal equations.
_TERMS = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
_POWERS = sorted({(a + c, b + d) for a, b in _TERMS for c, d in _TERMS})


def _block(v: str | Column) -> Column:
    return F.shiftright(v, _BITS).cast("long")


def _outside(faces: DataFrame) -> DataFrame:
    """shape_id, v, block: corners of the faces of a block that belong to another one."""
    corner = faces.select("shape_id", "block", F.explode(F.array(*_CORNERS)).alias("v"))
    return written(corner.filter(_block("v") != F.col("block")).select("shape_id", "v", "block").distinct(), "outside")


def _blocks(faces: DataFrame, vertices: DataFrame, depth: int) -> DataFrame:
    """shape_id, block, v0, v1, v2, x, y, z: for each block all faces that have a corner at most `depth` - 1 edges from its vertices, and (without
    v1 and v2) their corners' coordinates.

    Only what lies across the blocks' borders is joined: little where near vertices have near numbers; where they have not, all faces.
    """
    own = F.array_distinct(F.array(*(_block(c) for c in _CORNERS)))
    faces = faces.select("shape_id", "f_idx", *_CORNERS)
    near = faces.select("*", F.explode(own).alias("block"))
    across = crossing = near.filter(F.size(own) > 1)
    corner = faces.select("*", F.explode(F.array_distinct(F.array(*_CORNERS))).alias("v"))
    for _ in range(depth - 1):
        more = corner.join(_outside(across), ["shape_id", "v"]).filter(~F.array_contains(own, F.col("block"))).select(near.columns).distinct()
        more = written(more, "halo")
        across = crossing.union(more)
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    none = [F.lit(None).cast(faces.schema[c].dataType).alias(c) for c in _CORNERS[1:]]
    inside = vertices.select("shape_id", _block("v_idx").alias("block"), F.col("v_idx").alias("v0"), *none, *xyz)
    beyond = vertices.withColumnRenamed("v_idx", "v").join(_outside(across), ["shape_id", "v"]).select("shape_id", "block", "v", *none, *xyz)
    flat = lambda x: x.select("shape_id", "block", *_CORNERS, *(F.lit(None).cast("double").alias(c) for c in "xyz"))
    out = flat(near).union(inside).union(beyond)
    return out.union(flat(more)) if depth > 1 else out


def _spread(first: np.ndarray, to: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all neighbours of each of v: its place in v, and the neighbour."""
    n = first[v + 1] - first[v]
    at = np.repeat(np.arange(len(v)), n)
    return at, to[np.repeat(first[v] - (np.cumsum(n) - n), n) + np.arange(len(at))]


def _gather(depth: int, kind: pa.DataType, bits: int):
    def run(t: pa.Table) -> pa.Table:
        face = t["v1"].is_valid()
        f = np.stack([t[c].filter(face).to_numpy() for c in _CORNERS], 1)
        t_v = t.filter(pa.compute.invert(face))
        ids, xyz = t_v["v0"].to_numpy(), np.stack([t_v[c].to_numpy() for c in "xyz"], 1)
        names = np.unique(np.r_[ids, f.ravel()])
        size, p, there = len(names), np.full((len(names), 3), np.nan), np.zeros(len(names), bool)
        at, f = np.searchsorted(names, ids), np.searchsorted(names, f)
        p[at], there[at] = xyz, True
        # normals: sums of the faces' cross products; s is across the normal and the unit vector that it has least of
        whole = f[there[f].all(1)]
        faced = np.zeros(size, bool)
        faced[whole] = True
        cross = np.cross(p[whole[:, 1]] - p[whole[:, 0]], p[whole[:, 2]] - p[whole[:, 0]])
        cross[np.isnan(cross).any(1)] = 0
        n = np.stack([np.bincount(whole.ravel(), np.repeat(cross[:, k], 3), size) for k in range(3)], 1).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            n /= np.sqrt((n * n).sum(1))[:, None]
            least = np.zeros((size, 3))
            least[np.arange(size), np.abs(n).argmin(1)] = 1
            s = np.cross(n, least)
            s /= np.sqrt((s * s).sum(1))[:, None]
        axes = (s, np.cross(n, s), n)
        u, v = (np.r_[tuple(f[:, k] for k in ks)] for ks in ((0, 1, 1, 2, 2, 0), (1, 0, 2, 1, 0, 2)))
        code = np.unique(u[u != v] * size + v[u != v])
        first, to = np.searchsorted(code, np.arange(size + 1) * size), code % size
        own = np.flatnonzero((names >> bits == t["block"][0].as_py()) & there & faced)
        out = [[] for _ in range(len(_POWERS) + len(_TERMS) + 2)]
        for part in range(0, len(own), _AT_ONCE):
            o = own[part : part + _AT_ONCE]
            src, dst = ring = _spread(first, to, o)
            for _ in range(depth - 1):
                at, dst = _spread(first, to, ring[1])
                pair = np.unique(np.r_[ring[0] * size + ring[1], ring[0][at] * size + dst])
                ring = src, dst = pair // size, pair % size
            near = (o[src] != dst) & there[dst]
            src, dst = src[near], dst[near]
            if not len(src):
                continue
            i, start = o[src], np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            d = p[dst] - p[i]
            u, v, h = ((d * a[i]).sum(1) for a in axes)
            lost = np.isnan(u) | np.isnan(v) | np.isnan(h)  # they count, but add nothing
            u[lost] = v[lost] = h[lost] = 0
            us, vs = ([np.ones(len(x)), x, x * x, x * x * x, x * x * x * x] for x in (u, v))
            power = {(a, b): us[a] * vs[b] for a, b in _POWERS + _TERMS}
            none = np.add.reduceat(~lost, start, dtype=np.int64) == 0
            sums = [np.add.reduceat(x, start) for x in [*(power[k] for k in _POWERS), *(power[k] * h for k in _TERMS)]]
            for to_, x in zip(out, [names[i[start]], np.diff(np.r_[start, len(src)]), *(np.where(none, np.nan, x) for x in sums)], strict=True):
                to_.append(x)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        key = pa.array([t["shape_id"][0].as_py()] * len(flat[0]), t["shape_id"].type)
        return pa.table([key, pa.array(flat[0].astype(np.int64)).cast(kind), pa.array(flat[1].astype(np.int64)), *(pa.array(x, pa.float64(), from_pandas=True) for x in flat[2:])], names=["shape_id", "v_idx", "n", *_SUMS])

    return run


_SUMS = [f"m{i}{j}" for i, j in _POWERS] + [f"h{i}{j}" for i, j in _TERMS]


def _ring_sums(faces: DataFrame, vertices: DataFrame, depth: int) -> DataFrame:
    """shape_id, v_idx, n, m.. and h..: how many vertices are at most `depth` edges away, and the sums of their monomials in u and v, and of
    these times h, in a frame of the vertex: u and v across its normal, h along it."""
    shape, v = (vertices.schema[c].dataType.simpleString() for c in ("shape_id", "v_idx"))
    kind = {"int": pa.int32(), "bigint": pa.int64()}[v]
    return _blocks(faces, vertices, depth).groupBy("shape_id", "block").applyInArrow(_gather(depth, kind, _BITS), f"shape_id {shape}, v_idx {v}, n bigint, " + ", ".join(f"{c} double" for c in _SUMS))


def principal_curvatures(faces: DataFrame, vertices: DataFrame, *, depth: int = 2) -> DataFrame:
    """shape_id, v_idx, k1, k2: the larger and the smaller curvature of a vertex, positive where the surface bends away from its normal.

    A height a u^2 + b u v + c v^2 + d u + e v over the plane across the vertex normal is fitted to the vertices at most `depth` edges
    away: sums of their monomials give the normal equations. No row where fewer than five are near; null where they do not fix a height.
    The sums are gathered by blocks of vertices, so that pairs of near vertices never leave a task.
    """
    met = _ring_sums(faces, vertices, depth)
    terms = _TERMS
    met = G.with_solution(met.filter("n >= 5"), [[f"m{a + c}{b + d}" for c, d in terms] for a, b in terms], [f"h{i}{j}" for i, j in terms], "q")
    a, b, c, d, e = (F.col(f"q{k}") for k in range(5))
    met = met.withColumn("g", 1 + d * d + e * e)
    g = F.col("g")
    met = met.withColumns({"k": (4 * a * c - b * b) / (g * g), "m": -(a * (1 + e * e) - b * d * e + c * (1 + d * d)) / (g * F.sqrt(g))})
    root = F.sqrt(F.greatest(F.col("m") * F.col("m") - F.col("k"), F.lit(0.0)))
    return met.select("shape_id", "v_idx", (F.col("m") + root).alias("k1"), (F.col("m") - root).alias("k2"))


def gaussian_curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, v_idx, k: 2 pi minus the sum of the angles at a vertex."""
    t = internal_angles(faces, vertices).join(faces, ["shape_id", "f_idx"])
    corner = F.array(*[F.struct(F.col(f"v{k}").alias("v_idx"), F.col(f"t{k}").alias("t")) for k in range(3)])
    return t.select("shape_id", F.explode(corner).alias("c")).groupBy("shape_id", F.col("c.v_idx").alias("v_idx")).agg((F.lit(2 * math.pi) - F.sum("c.t")).alias("k"))


def closed_centroid(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, volume and cx, cy, cz: sums of the tetrahedra that faces make with the origin."""
    a, b, c = (G.cols(p) for p in "abc")
    six = G.dot(a, G.cross(b, c))
    s = corners(faces, vertices).groupBy("shape_id").agg((F.sum(six) / 6).alias("volume"), *(F.sum(six * m / 24).alias("m" + k) for m, k in zip(G.add(a, b, c), "xyz", strict=True)))
    return s.select("shape_id", "volume", *(F.try_divide(F.col("m" + k), F.col("volume")).alias("c" + k) for k in "xyz"))


def onto_faces(faces: DataFrame, values: DataFrame) -> DataFrame:
    """shape_id, f_idx, value: mean of its corners' values (shape_id, v_idx, value)."""
    c = faces.select("shape_id", "f_idx", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"))
    return c.join(values, ["shape_id", "v_idx"]).groupBy("shape_id", "f_idx").agg(F.avg("value").alias("value"))


def onto_vertices(faces: DataFrame, values: DataFrame) -> DataFrame:
    """shape_id, v_idx, value: mean of its faces' values (shape_id, f_idx, value)."""
    c = faces.select("shape_id", "f_idx", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"))
    return c.join(values, ["shape_id", "f_idx"]).groupBy("shape_id", "v_idx").agg(F.avg("value").alias("value"))


def smooth(faces: DataFrame, values: DataFrame) -> DataFrame:
    """shape_id, v_idx, value: mean of a vertex's neighbours."""
    d = directed_edges(faces)
    n = d.select("shape_id", "u", "v").union(d.select("shape_id", F.col("v"), F.col("u"))).distinct()
    return n.join(values.withColumnRenamed("v_idx", "v"), ["shape_id", "v"]).groupBy("shape_id", F.col("u").alias("v_idx")).agg(F.avg("value").alias("value"))


def remove_unreferenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that a face holds, with new_idx from 0 in the old order."""
    used = faces.select("shape_id", F.explode(F.array("v0", "v1", "v2")).alias("v_idx")).distinct()
    kept = vertices.join(used, ["shape_id", "v_idx"], "left_semi")
    return kept.withColumn("new_idx", F.row_number().over(W.partitionBy("shape_id").orderBy("v_idx")) - 1)


def limit_faces(faces: DataFrame, vertices: DataFrame, *, exclusive: bool) -> DataFrame:
    """Faces of which all corners (`exclusive`), or any, are among the given vertices."""
    c = faces.select("shape_id", "f_idx", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"))
    n = c.join(vertices.select("shape_id", "v_idx").distinct(), ["shape_id", "v_idx"], "left_semi").groupBy("shape_id", "f_idx").agg(F.count(F.lit(1)).alias("n"))
    return faces.join(n.filter(f"n >= {3 if exclusive else 1}"), ["shape_id", "f_idx"], "left_semi")


def unique_simplices(faces: DataFrame) -> DataFrame:
    """shape_id, corners (sorted), first face and times of faces that differ not only in the order of corners."""
    return faces.groupBy("shape_id", F.array_sort(F.array("v0", "v1", "v2")).alias("corners")).agg(F.min("f_idx").alias("first"), F.count(F.lit(1)).alias("times"))


def merge_vertices(vertices: DataFrame, eps: float) -> DataFrame:
    """shape_id, v_idx, kept: the smallest vertex in the same cell of 10 eps; exact coordinates if eps is 0."""
    cell = [F.col(a) if eps == 0 else F.round(F.col(a) / (10 * eps)).cast("long") for a in "xyz"]
    named = vertices.withColumns({f"q{a}": c for a, c in zip("xyz", cell, strict=True)})
    least = named.groupBy("shape_id", "qx", "qy", "qz").agg(F.min("v_idx").alias("kept"))
    return named.join(least, ["shape_id", "qx", "qy", "qz"]).select("shape_id", "v_idx", "kept")


def vertex_faces(faces: DataFrame) -> DataFrame:
    """shape_id, v_idx, faces and corners: where a vertex occurs, in face order."""
    c = faces.select("shape_id", "f_idx", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "v_idx"))
    lists = c.groupBy("shape_id", "v_idx").agg(F.sort_array(F.collect_list(F.struct("f_idx", "k"))).alias("a"))
    return lists.select("shape_id", "v_idx", F.col("a.f_idx").alias("faces"), F.col("a.k").alias("corners"))


def upsample(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, a, b, x, y, z: the new vertex on each edge of a four-to-one subdivision."""
    e = edge_counts(faces).select("shape_id", "a", "b")
    p = vertices.select("shape_id", F.col("v_idx").alias("a"), *(F.col(c).alias("p" + c) for c in "xyz"))
    q = vertices.select("shape_id", F.col("v_idx").alias("b"), *(F.col(c).alias("q" + c) for c in "xyz"))
    m = e.join(p, ["shape_id", "a"]).join(q, ["shape_id", "b"])
    return m.select("shape_id", "a", "b", *(((F.col("p" + c) + F.col("q" + c)) / 2).alias(c) for c in "xyz"))


def fit_plane(points: DataFrame) -> DataFrame:
    """shape_id, cx, cy, cz, nx, ny, nz: centre and the axis of least spread; the sign makes the largest component positive."""
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    s = points.groupBy("shape_id").agg(*(F.avg(a).alias("c" + a) for a in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))
    m = [a + b for a, b in pairs]
    s = G.with_eigenvector(G.with_eigenvalues(s, m, "l"), m, "l3", "v")
    v = G.cols("v")
    top = F.greatest(*[F.abs(c) for c in v])
    sign = F.signum(F.when(F.abs(v[0]) >= top, v[0]).when(F.abs(v[1]) >= top, v[1]).otherwise(v[2]))
    return s.select("shape_id", "cx", "cy", "cz", *((c * sign).alias("n" + a) for c, a in zip(v, "xyz", strict=True)))


def hausdorff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, d: the largest distance from a point of either set to the other set, both (key, idx, x, y, z)."""
    far = lambda p, q: nearest_of(p, q, key).groupBy(key).agg(F.max("d2").alias("d2"))
    return far(a, b).union(far(b, a)).groupBy(key).agg(F.sqrt(F.max("d2")).alias("d"))


def snap(points: DataFrame, onto: DataFrame, key: str) -> DataFrame:
    """key, i, j, d2: for each of points the nearest of `onto`, both (key, idx, x, y, z); ties go to the smaller j."""
    return nearest_of(points, onto, key)


def winding_numbers(queries: DataFrame, faces: DataFrame, vertices: DataFrame, *, error: float = 1e-4) -> DataFrame:
    """shape_id, q_idx, w: the solid angle of all faces seen from each query (shape_id, q_idx, x, y, z), over 4 pi, within `error`."""
    return surface.winding_numbers(queries, surface.face_tree(faces, vertices), error=error)


def border_vertices(faces: DataFrame) -> DataFrame:
    """shape_id, v_idx of vertices on an edge of one face."""
    return boundary_edges(faces).select("shape_id", F.explode(F.array("a", "b")).alias("v_idx")).distinct()


def irregular_vertices(faces: DataFrame, valence: int = 6) -> DataFrame:
    """shape_id, v_idx, edges of inner vertices whose number of edges is not `valence`."""
    ends = edge_counts(faces).select("shape_id", F.explode(F.array("a", "b")).alias("v_idx"))
    n = ends.groupBy("shape_id", "v_idx").agg(F.count(F.lit(1)).alias("edges")).filter(F.col("edges") != valence)
    return n.join(border_vertices(faces), ["shape_id", "v_idx"], "left_anti")


def false_subdivision(faces: DataFrame) -> DataFrame:
    """shape_id, f_idx, v0, v1, center: three faces around the centre (named by the old face) of each."""
    e = directed_edges(faces)
    return e.select("shape_id", (3 * F.col("f_idx") + F.col("k")).alias("f_idx"), F.col("u").alias("v0"), F.col("v").alias("v1"), F.col("f_idx").alias("center"))


def edge_samples(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """shape_id, a, b, place, x, y, z: k inner points, evenly spaced, on each edge."""
    p = vertices.select("shape_id", F.col("v_idx").alias("a"), *(F.col(c).alias("p" + c) for c in "xyz"))
    q = vertices.select("shape_id", F.col("v_idx").alias("b"), *(F.col(c).alias("q" + c) for c in "xyz"))
    m = edges.select("shape_id", "a", "b").join(p, ["shape_id", "a"]).join(q, ["shape_id", "b"]).withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k))))
    t = F.col("place") / (k + 1)
    return m.select("shape_id", "a", "b", "place", *((F.col("p" + c) * (1 - t) + F.col("q" + c) * t).alias(c) for c in "xyz"))


def in_polygon(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Adds inside: even-odd test of x, y; the lower ends of sides count. Fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return points.withColumn("inside", F.lit(False))
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            at = F.lit(float(x1)) + (F.col("y") - y1) * ((x2 - x1) / (y2 - y1))
            crossed = crossed + F.when(((F.col("y") >= min(y1, y2)) & (F.col("y") < max(y1, y2))) & (F.col("x") < at), 1).otherwise(0)
    return points.withColumn("inside", crossed % 2 == 1)


def corner_normals(faces: DataFrame, vertices: DataFrame, degrees: float) -> DataFrame:
    """shape_id, f_idx, k, nx, ny, nz: at each corner the normal of all faces of its vertex that are within `degrees` of the
    corner's own face, weighted by area."""
    n = face_normals(faces, vertices).select("shape_id", "f_idx", "nx", "ny", "nz", F.col("area2").alias("area"))
    corner = faces.select("shape_id", "f_idx", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "v_idx")).join(n, ["shape_id", "f_idx"])
    other = corner.select("shape_id", "v_idx", *(F.col(c).alias("o" + c) for c in ("nx", "ny", "nz", "area")))
    met = corner.join(other, ["shape_id", "v_idx"])
    near = G.dot(G.cols("n"), G.cols("on")) > math.cos(math.radians(degrees))
    sums = met.filter(near).groupBy("shape_id", "f_idx", "k").agg(*(F.sum(F.col("on" + c) * F.col("oarea")).alias(c) for c in "xyz"))
    return sums.select("shape_id", "f_idx", "k", *(c.alias("n" + a) for c, a in zip(G.unit(G.cols()), "xyz", strict=True)))


def gradients(faces: DataFrame, vertices: DataFrame, values: DataFrame) -> DataFrame:
    """shape_id, f_idx, gx, gy, gz: the gradient of values (shape_id, v_idx, value) that are linear on each face; null on a face without area."""
    tri = corners(faces, vertices)
    for k, v in enumerate(("v0", "v1", "v2")):
        tri = tri.join(values.select("shape_id", F.col("v_idx").alias(v), F.col("value").alias(f"h{k}")), ["shape_id", v])
    a, b, c = (G.cols(p) for p in "abc")
    n = G.cross(G.sub(b, a), G.sub(c, a))
    tri = tri.withColumns({f"_n{k}": x for k, x in zip("xyz", n, strict=True)})
    n = G.cols("_n")
    turned = lambda e: G.cross(n, e)
    parts = [G.scale(turned(e), F.col(f"h{k}")) for k, e in enumerate((G.sub(c, b), G.sub(a, c), G.sub(b, a)))]
    g = G.add(*parts)
    return tri.select("shape_id", "f_idx", *(F.try_divide(x, G.dot(n, n)).alias("g" + k) for k, x in zip("xyz", g, strict=True)))


def barycentric(points: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """points (shape_id, q_idx, f_idx, x, y, z) with l0, l1, l2: their coordinates in the plane of face f_idx; null without area."""
    met = corners(faces, vertices).join(points, ["shape_id", "f_idx"])
    a, b, c = (G.cols(p) for p in "abc")
    e0, e1, e2 = G.sub(b, a), G.sub(c, a), G.sub(G.cols(), a)
    dots = {"_d00": G.dot(e0, e0), "_d01": G.dot(e0, e1), "_d11": G.dot(e1, e1), "_d20": G.dot(e2, e0), "_d21": G.dot(e2, e1)}
    met = met.withColumns(dots)
    d00, d01, d11, d20, d21 = (F.col(n) for n in dots)
    det = d00 * d11 - d01 * d01
    met = met.withColumns({"l1": F.try_divide(d11 * d20 - d01 * d21, det), "l2": F.try_divide(d00 * d21 - d01 * d20, det)})
    return met.select("shape_id", "q_idx", "f_idx", (1 - F.col("l1") - F.col("l2")).alias("l0"), "l1", "l2")


def edge_topology(faces: DataFrame) -> DataFrame:
    """shape_id, a, b, f0, f1: the edges, and the first and the last face of each; f1 is -1 on the border."""
    e = directed_edges(faces).groupBy("shape_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    both = e.agg(F.min("f_idx").alias("f0"), F.max("f_idx").alias("f1"))
    return both.withColumn("f1", F.when(F.col("f1") == F.col("f0"), F.lit(-1)).otherwise(F.col("f1")))


def _face_links(faces: DataFrame, *, only_pairs: bool = False) -> DataFrame:
    """shape_id, a, b, flip: each face of an edge but the first (b) with that one (a), and whether both run along the edge the same
    way; `only_pairs`: of edges with two faces alone."""
    e = directed_edges(faces).select("shape_id", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"), F.struct(F.col("f_idx").cast("long").alias("f"), (F.col("u") < F.col("v")).alias("up")).alias("face"))
    first = e.groupBy("shape_id", "p", "q").agg(F.min("face").alias("first"), F.count(F.lit(1)).alias("n"))
    if only_pairs:
        first = first.filter("n = 2")
    met = e.join(first, ["shape_id", "p", "q"]).filter("face.f <> first.f")
    return met.select("shape_id", F.col("first.f").alias("a"), F.col("face.f").alias("b"), (F.col("face.up") == F.col("first.up")).alias("flip"))


def signed_faces(faces: DataFrame, *, only_pairs: bool = False) -> DataFrame:
    """Components of faces over common edges, with the parity of turns from their first faces: `linking.signed_components`."""
    return linking.signed_components(faces.select("shape_id", F.col("f_idx").alias("node")), _face_links(faces, only_pairs=only_pairs))


def numbered(faces: DataFrame, found: DataFrame, *, rank: Column | None = None) -> DataFrame:
    """shape_id, f_idx, component: numbers of the components that `signed_faces` found, in the order of their first faces (`label`), or of
    `rank`, a column made of these; components of equal rank share a number."""
    found = found.withColumn("rank", F.col("label") if rank is None else rank)
    names = before(found.select("shape_id", "rank").distinct(), ["shape_id", "rank"], F.lit(1), "place")
    first = names.groupBy("shape_id").agg(F.min("place").alias("first"))
    names = names.join(first, "shape_id").select("shape_id", "rank", (F.col("place") - F.col("first")).cast("int").alias("component"))
    return found.join(names, ["shape_id", "rank"]).select("shape_id", F.col("node").cast(faces.schema["f_idx"].dataType).alias("f_idx"), "component")


def facet_components(faces: DataFrame) -> DataFrame:
    """shape_id, f_idx, component: faces that share edges, numbered by their first ones."""
    return numbered(faces, signed_faces(faces))


def manifold_patches(faces: DataFrame) -> DataFrame:
    """shape_id, f_idx, component: faces that hang together by edges of two faces, numbered by their first ones; where more meet, patches end."""
    return numbered(faces, signed_faces(faces, only_pairs=True))


def orient_faces(faces: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Faces turned so that neighbours agree on the direction of their common edge, and whether each was turned. In each component the
    smaller of both sides is turned, at a tie the first face's; a lone face stays. `found`: what `signed_faces` gave, if it is known."""
    found = signed_faces(faces) if found is None else found
    sides = found.groupBy("shape_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("turned").cast("int")).alias("k"))
    swap = (F.col("n") > 1) & (2 * F.col("k") >= F.col("n"))
    turned = found.join(sides, ["shape_id", "label"]).select("shape_id", F.col("node").cast(faces.schema["f_idx"].dataType).alias("f_idx"), (F.col("turned") != swap).alias("turned"))
    v1, v2 = (F.when(F.col("turned"), F.col(x)).otherwise(F.col(y)) for x, y in (("v2", "v1"), ("v1", "v2")))
    return faces.join(turned, ["shape_id", "f_idx"]).select("shape_id", "f_idx", "v0", v1.alias("v1"), v2.alias("v2"), "turned")


def _arc(u: str, v: str) -> Column:
    """A number for an arc between two vertices, in the order of (u, v)."""
    return F.shiftleft(F.col(u).cast("long"), 32) + F.col(v).cast("long")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """shape_id, loop, place, v: chains of the border's directed edges, closed ones from their smallest vertex, numbered by their first edges.

    Where several border edges leave a vertex, the first that comes in goes on by the first that leaves, and so on.
    """
    border = boundary_edges(faces).withColumnsRenamed({"a": "p", "b": "q"})
    d = directed_edges(faces).select("shape_id", "u", "v", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).join(border, ["shape_id", "p", "q"]).select("shape_id", "u", "v")
    rank = lambda at, by: F.row_number().over(W.partitionBy("shape_id", at).orderBy(by))
    d = written(d.withColumns({"into": rank("v", "u"), "out": rank("u", "v")}), "border")
    ahead = d.select("shape_id", F.col("u").alias("v"), F.col("out").alias("into"), _arc("u", "v").alias("next"))
    lists = linking.ranked_lists(d.select("shape_id", "v", "into", _arc("u", "v").alias("id")).join(ahead, ["shape_id", "v", "into"], "left"))
    names = before(lists.filter("place = 0").select("shape_id", "head"), ["shape_id", "head"], F.lit(1), "n")
    first = names.groupBy("shape_id").agg(F.min("n").alias("first"))
    names = names.join(first, "shape_id").select("shape_id", "head", (F.col("n") - F.col("first")).cast("int").alias("loop"))
    kind = faces.schema["v0"].dataType
    return lists.join(names, ["shape_id", "head"]).select("shape_id", "loop", F.col("place").cast("int").alias("place"), F.shiftright("id", 32).cast(kind).alias("v"))


def edge_curves(faces: DataFrame) -> DataFrame:
    """shape_id, curve, place, v, closed: the edges where more than two faces meet, as curves between the vertices where not just two of
    them do; a closed curve begins at its smallest vertex, an open one at its smaller end, and names its last vertex too."""
    heavy = edge_counts(faces).filter("faces > 2").select("shape_id", "a", "b")
    arcs = heavy.union(heavy.select("shape_id", F.col("b"), F.col("a"))).toDF("shape_id", "u", "v")
    around = arcs.groupBy("shape_id", "u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    on = around.filter("n = 2").select("shape_id", F.col("u").alias("v"), "lo", "hi")
    ahead = F.when(F.col("u") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    step = arcs.join(on, ["shape_id", "v"], "left").withColumn("w", F.when(F.col("lo").isNotNull(), ahead))
    lists = written(linking.ranked_lists(step.select("shape_id", _arc("u", "v").alias("id"), _arc("v", "w").alias("next"))), "curves")
    lists = lists.withColumns({"u": F.shiftright("id", 32), "v": F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))})
    # either direction is a list of its own; the one whose first edge is the smaller one stays
    ends = lists.groupBy("shape_id", "head").agg(F.max(F.struct("place", "u", "v")).alias("last"), F.min(F.struct("place", "u", "v")).alias("first"))
    back = _arc("last.v", "last.u")
    closed = F.col("last.v") == F.col("first.u")
    ends = ends.select("shape_id", "head", closed.alias("closed"), F.when(closed, F.shiftleft(F.col("first.u"), 32) + F.col("last.u")).otherwise(back).alias("other"))
    kept = ends.filter("head < other").drop("other")
    names = before(kept, ["shape_id", "head"], F.lit(1), "n")
    first = names.groupBy("shape_id").agg(F.min("n").alias("start"))
    names = names.join(first, "shape_id").select("shape_id", "head", "closed", (F.col("n") - F.col("start")).cast("int").alias("curve"))
    rows = lists.join(names, ["shape_id", "head"])
    last = rows.filter((F.col("place") == F.col("length") - 1) & ~F.col("closed")).select("shape_id", "curve", (F.col("place") + 1).alias("place"), "v", "closed")
    out = rows.select("shape_id", "curve", "place", F.col("u").alias("v"), "closed").union(last)
    return out.select("shape_id", "curve", F.col("place").cast("int").alias("place"), F.col("v").cast(faces.schema["v0"].dataType).alias("v"), "closed")


def collapse_small(faces: DataFrame, vertices: DataFrame, eps: float, *, rounds: int | None = None) -> DataFrame:
    """Faces without those of an area below eps times the squared diagonal of their shape's box: their shortest edges are contracted until
    there are none (or for so many rounds), and faces that lose a corner go.

    All vertices that one round's edges join become the smallest of them, which keeps its place, so that chains of small faces
    fold in one round whatever their order. Of equally short edges the one across the first corner counts.
    """
    box = vertices.groupBy("shape_id").agg(*(f(c).alias(n + c) for n, f in (("l", F.min), ("h", F.max)) for c in "xyz"))
    limit = written(box.select("shape_id", (eps * G.squared_distance(G.cols("l"), G.cols("h"))).alias("limit")), "limits")
    kind = faces.schema["v0"].dataType
    now, left = written(faces.select("shape_id", "f_idx", "v0", "v1", "v2"), "faces"), rounds
    while left is None or left > 0:
        tri = corners(now, vertices).join(limit, "shape_id")
        p = [G.cols(n) for n in "abc"]
        length = [G.squared_distance(p[(k + 1) % 3], p[(k + 2) % 3]) for k in range(3)]
        tri = tri.filter(G.cross_area(*p) < F.col("limit")).withColumns({f"e{k}": x for k, x in enumerate(length)})
        least = F.least("e0", "e1", "e2")
        pick = lambda *v: F.when(F.col("e0") <= least, F.col(v[0])).when(F.col("e1") <= least, F.col(v[1])).otherwise(F.col(v[2])).cast("long")  # noqa: B023, E731
        short = written(tri.select("shape_id", pick("v1", "v2", "v0").alias("a"), pick("v2", "v0", "v1").alias("b"), F.lit(False).alias("flip")), "short-edges")
        if short.isEmpty():
            break
        ends = short.select("shape_id", F.explode(F.array("a", "b")).alias("node")).distinct()
        merged = linking.signed_components(ends, short).filter("node <> label").select("shape_id", F.col("node").cast(kind).alias("v"), F.col("label").cast(kind).alias("to"))
        after = now
        for v in ("v0", "v1", "v2"):
            after = after.join(merged.toDF("shape_id", v, f"to_{v}"), ["shape_id", v], "left").withColumn(v, F.coalesce(f"to_{v}", v)).drop(f"to_{v}")
        now = written(after.filter("v0 <> v1 and v1 <> v2 and v2 <> v0").select("shape_id", "f_idx", "v0", "v1", "v2"), "faces")
        left = None if left is None else left - 1
    return now


def vertex_manifold(faces: DataFrame) -> DataFrame:
    """shape_id, v_idx, manifold: whether the faces around a vertex hang together by edges at it."""
    corner = faces.select("shape_id", "f_idx", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"))
    others = faces.select("shape_id", "f_idx", F.posexplode(F.array("v0", "v1", "v2")).alias("c", "v_idx"), "v0", "v1", "v2")
    spoke = others.select("shape_id", "v_idx", "f_idx", F.explode(F.filter(F.array("v0", "v1", "v2"), lambda x: x != F.col("v_idx"))).alias("end"))
    nxt = F.lead("f_idx").over(W.partitionBy("shape_id", "v_idx", "end").orderBy("f_idx"))
    links = spoke.withColumn("j", nxt).filter("j is not null").select("shape_id", "v_idx", F.col("f_idx").alias("i"), "j")
    found = components(corner.withColumnRenamed("f_idx", "point_idx"), links, key=["shape_id", "v_idx"])
    return found.groupBy("shape_id", "v_idx").agg((F.max("component") == 0).alias("manifold"))


def resolve_duplicates(faces: DataFrame) -> DataFrame:
    """Faces with the same corners: as many of one direction more than of the other, one of these (the first) stays, else none."""
    least = F.least("v0", "v1", "v2")
    turned = F.when(F.col("v0") == least, F.array("v0", "v1", "v2")).when(F.col("v1") == least, F.array("v1", "v2", "v0")).otherwise(F.array("v2", "v0", "v1"))
    rows = faces.withColumns({"_set": F.array_sort(F.array("v0", "v1", "v2")), "_up": F.get(turned, F.lit(1)) < F.get(turned, F.lit(2))})
    sums = rows.groupBy("shape_id", "_set").agg(F.sum(F.when(F.col("_up"), 1).otherwise(-1)).alias("_sum"), F.min(F.when(F.col("_up"), F.col("f_idx"))).alias("_first_up"), F.min(F.when(~F.col("_up"), F.col("f_idx"))).alias("_first_down"))
    one = F.when(F.col("_sum") > 0, F.col("_first_up")).when(F.col("_sum") < 0, F.col("_first_down"))
    kept = sums.select("shape_id", one.alias("f_idx")).filter("f_idx is not null")
    return faces.join(kept, ["shape_id", "f_idx"], "left_semi")


def point_mesh_distance(points: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, q_idx, d2, f_idx: the squared distance of points (shape_id, q_idx, x, y, z) to their shape's mesh, and the first
    face at it."""
    return surface.nearest_faces(points, surface.face_tree(faces, vertices))


def signed_distance(points: DataFrame, faces: DataFrame, vertices: DataFrame, *, error: float = 1e-4) -> DataFrame:
    """shape_id, q_idx, s: the distance of points (shape_id, q_idx, x, y, z) to their shape's mesh times 1 - 2 w, w being the winding
    number (within `error`): negative inside a closed mesh whose faces turn outward."""
    tree = surface.face_tree(faces, vertices)
    d = surface.nearest_faces(points, tree).join(surface.winding_numbers(points, tree, error=error), ["shape_id", "q_idx"])
    return d.select("shape_id", "q_idx", (F.sqrt("d2") * (1 - 2 * F.col("w"))).alias("s"))


def ray_hits(rays: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """shape_id, q_idx, f_idx, t, u, v: where rays (shape_id, q_idx, x, y, z, dx, dy, dz) meet the faces of their shape, on either
    side and ahead of their start: at t times the direction, with weights u and v of the second and third corner."""
    return surface.ray_hits(rays, surface.face_tree(faces, vertices))
