"""Searches down the tree of a mesh's triangles, and the skips of the generators, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import random as rnd
from pointloom.operators import surface


def grid(spark, n, height):
    """A wavy square of n x n vertices and 2 (n - 1)^2 faces, made by Spark, and the same in NumPy."""
    i, j = (F.col("id") % n).cast("int"), F.floor(F.col("id") / n).cast("int")
    z = height * F.sin(i / n * 7) * F.cos(j / n * 9)
    vertices = spark.range(n * n).select(F.lit("s").alias("shape_id"), F.col("id").cast("int").alias("v_idx"), (i / n * 2).alias("x"), (j / n * 2).alias("y"), z.alias("z"))
    a = (F.col("id") % (n - 1) + F.floor(F.col("id") / (n - 1)) * n).cast("int")
    two = F.array(*[F.struct((2 * F.col("id") + k).alias("f_idx"), *((a + d).alias(f"v{c}") for c, d in enumerate(ds))) for k, ds in enumerate(((0, 1, n), (1, n + 1, n)))])
    faces = spark.range((n - 1) ** 2).select(F.lit("s").alias("shape_id"), F.explode(two).alias("f")).select("shape_id", "f.*")
    k = np.arange(n * n)
    p = np.stack([k % n / n * 2, k // n / n * 2, height * np.sin(k % n / n * 7) * np.cos(k // n / n * 9)], 1)
    q = np.arange((n - 1) ** 2)
    at = q % (n - 1) + q // (n - 1) * n
    f = np.stack([np.stack([at, at + 1, at + n], 1), np.stack([at + 1, at + n + 1, at + n], 1)], 1).reshape(-1, 3)
    return faces, vertices, p[f]


def closest(tri, p):
    """Squared distances from p to all triangles: projected onto planes and sides, clamped."""
    a, b, c = tri.swapaxes(0, 1)

    def side(u, v):
        e = v - u
        t = np.clip(((p - u) * e).sum(1) / np.maximum((e * e).sum(1), 1e-300), 0, 1)
        return ((p - u - e * t[:, None]) ** 2).sum(1)

    n = np.cross(b - a, c - a)
    n2 = (n * n).sum(1)
    inside = np.all([(np.cross(v - u, p - u) * n).sum(1) >= 0 for u, v in ((a, b), (b, c), (c, a))], 0) & (n2 > 0)
    h = ((p - a) * n).sum(1)
    return np.where(inside, h * h / np.maximum(n2, 1e-300), np.minimum(np.minimum(side(a, b), side(b, c)), side(c, a)))


def angle(tri, p):
    a, b, c = (tri - p).swapaxes(0, 1)
    la, lb, lc = (np.linalg.norm(v, axis=1) for v in (a, b, c))
    dot = lambda x, y: (x * y).sum(1)
    return 2 * np.arctan2(dot(a, np.cross(b, c)), la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb)


def test_a_hundred_thousand_faces_and_points_in_one_shape(spark):
    faces, vertices, tri = grid(spark, 224, 0.3)
    points = spark.range(100_000).select(F.lit("s").alias("shape_id"), F.col("id").alias("q_idx"), *((F.rand(k) * (2.4 if k < 3 else 1.2) - (0.2 if k < 3 else 0.6)).alias(c) for k, c in enumerate("xyz", 1)))
    tree = surface.face_tree(faces, vertices)
    assert tree.faces.count() == len(tri) == 99_458
    found = surface.nearest_faces(points, tree).persist()
    assert found.count() == 100_000
    some = {r.q_idx: (r.x, r.y, r.z) for r in points.filter("q_idx % 997 = 0").collect()}
    got = {r.q_idx: (r.d2, r.f_idx) for r in found.filter("q_idx % 997 = 0").collect()}
    for q, p in some.items():
        d = closest(tri, np.array(p))
        assert got[q][0] == pytest.approx(d.min(), rel=1e-9, abs=1e-15) and d[got[q][1]] == pytest.approx(d.min(), rel=1e-9, abs=1e-15)
    rays = points.withColumns({"dx": F.lit(0.3), "dy": F.lit(-0.2), "dz": F.lit(-1.0)})
    hits = {}
    for r in surface.ray_hits(rays, tree).filter("q_idx % 997 = 0").collect():
        hits.setdefault(r.q_idx, []).append(r.f_idx)
    e, g = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    d = np.array([0.3, -0.2, -1.0])
    for q, p in some.items():
        s = np.array(p) - tri[:, 0]
        across, up = np.cross(d, g), np.cross(s, e)
        det = (e * across).sum(1)
        t, u, v = (g * up).sum(1) / det, (s * across).sum(1) / det, (d * up).sum(1) / det
        assert sorted(hits.get(q, [])) == np.flatnonzero((t > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)).tolist()


@pytest.mark.parametrize("error", (1e-1, 1e-3))
def test_winding_numbers_within_their_error(spark, error):
    faces, vertices, tri = grid(spark, 60, 0.3)
    rng = np.random.default_rng(4)
    points = rng.uniform((-1, -1, -1), (3, 3, 1), (150, 3))
    df = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(points)], "shape_id string, q_idx int, x double, y double, z double")
    got = {r.q_idx: r.w for r in surface.winding_numbers(df, surface.face_tree(faces, vertices), error=error).collect()}
    want = [angle(tri, p).sum() / (4 * math.pi) for p in points]
    off = [abs(got[k] - w) for k, w in enumerate(want)]
    assert max(off) <= error and max(off) > 1e-9  # some cells do count as a whole


def test_trees_of_odd_meshes(spark):
    """A giant face among small ones, faces without area, a mesh of one point, shapes without faces, nulls, extra columns."""
    rng = np.random.default_rng(6)
    tri = rng.uniform(0, 1, (60, 1, 3)) + rng.normal(0, 0.01, (60, 3, 3))
    tri[7] = [[-9, -9, 0.5], [9, -9, 0.5], [0, 9, 0.4]]
    tri[8] = tri[8, 0]
    tri[9, 2] = tri[9, 1]
    rows = [("s", 3 * k + c, *map(float, p)) for k, t in enumerate(tri) for c, p in enumerate(t)] + [("dot", 0, 1.0, 2.0, 3.0), ("s", 500, None, 0.0, 0.0)]
    faces = [("s", k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(60)] + [("dot", 0, 0, 0, 0), ("s", 60, 0, 1, 500), ("s", 61, 0, 1, 999)]
    vertices = spark.createDataFrame(rows, "shape_id string, v_idx int, x double, y double, z double").withColumn("level", F.lit("clash"))
    faces = spark.createDataFrame(faces, "shape_id string, f_idx int, v0 int, v1 int, v2 int").withColumn("ix", F.lit("clash"))
    q = rng.uniform(-2, 3, (40, 3))
    points = [("s", k, *map(float, p)) for k, p in enumerate(q)] + [("dot", 0, 1.0, 2.0, 5.0), ("none", 0, 0.0, 0.0, 0.0), ("s", 99, None, 1.0, 1.0)]
    points = spark.createDataFrame(points, "shape_id string, q_idx int, x double, y double, z double").withColumn("best", F.lit("clash"))
    tree = surface.face_tree(faces, vertices)
    got = {(r.shape_id, r.q_idx): (r.d2, r.f_idx) for r in surface.nearest_faces(points, tree).collect()}
    assert len(got) == 41 and got["dot", 0] == (4.0, 0)
    for k, p in enumerate(q):
        d = closest(tri, p)
        assert got["s", k] == (pytest.approx(d.min()), int(np.flatnonzero(d <= d.min() * (1 + 1e-12))[0]))
    up = points.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(1.0)})
    assert {r.f_idx for r in surface.ray_hits(up, tree).collect()} >= {7}
    w = {r.q_idx: r.w for r in surface.winding_numbers(points.filter("shape_id = 's'"), tree, error=1e-6).collect()}
    assert all(w[k] == pytest.approx(angle(tri, p).sum() / (4 * math.pi), abs=1e-6) for k, p in enumerate(q))
    empty = surface.face_tree(faces.filter("false"), vertices)
    assert surface.nearest_faces(points, empty).count() == surface.ray_hits(up, empty).count() == surface.winding_numbers(points, empty).count() == 0


def test_skips_are_many_steps(spark):
    m, steps = 0xFFFFFFFF, (0, 1, 2, 3, 31, 32, 1000, 4097)
    state = {"c": 123456789, "s": 362436069, "u": 0x12345678, "v": 0x1234567, "w0": 698769067, "w1": 4294967295}

    def shr3(x):
        x ^= x << 13 & m
        x ^= x >> 17
        return x ^ (x << 5 & m)

    def register(z, a, b, keep, c):
        return ((z & keep) << c & m) ^ (((z << a & m) ^ z) >> b)

    zs = [987654321, 555555555, 4000000000, 3141592653]
    df = spark.createDataFrame([(n,) for n in steps], "n long")
    lit = lambda x: F.lit(x).cast("long")
    n = F.col("n")
    w = rnd.skip_mwc64(lit(state["w0"]), lit(state["w1"]), n)
    u, v = rnd.skip_mwc(lit(state["u"]), lit(state["v"]), n)
    out = df.select("n", rnd.skip_cong(lit(state["c"]), n).alias("c"), rnd.skip_shr3(lit(state["s"]), n).alias("s"), u.alias("u"), v.alias("v"), w[0].alias("w0"), w[1].alias("w1"), *(z.alias(f"z{k}") for k, z in enumerate(rnd.skip_lfsr(tuple(map(lit, zs)), n))))
    for r in out.collect():
        c, s, u, v, w, z = state["c"], state["s"], state["u"], state["v"], state["w0"] << 32 | state["w1"], list(zs)
        for _ in range(r.n):
            c, s, u, v, w = (69069 * c + 12345) & m, shr3(s), 36969 * (u & 0xFFFF) + (u >> 16), 18000 * (v & 0xFFFF) + (v >> 16), 698769069 * (w & m) + (w >> 32)
            z = [register(x, *reg) for x, reg in zip(z, rnd.LFSR113)]
        assert (r.c, r.s, r.u, r.v, r.w0 << 32 | r.w1, [r.z0, r.z1, r.z2, r.z3]) == (c, s, u, v, w, z)


def test_skips_add_up_over_their_whole_range(spark):
    """n steps and then m are n + m, up to 2**62; null and negative numbers of steps are none."""
    df = spark.createDataFrame([(1 << 40, 12_345), (3**38, 1 << 61), (2**32 - 1, 2**32), (None, -5)], "a long, b long")
    a, b, both = F.col("a"), F.col("b"), F.coalesce(F.col("a"), F.lit(0)) + F.greatest(F.col("b"), F.lit(0))
    lit = lambda x: F.lit(x).cast("long")
    one = {"shr3": lambda n, s: rnd.skip_shr3(s, n), "cong": lambda n, s: rnd.skip_cong(s, n), "upper": lambda n, s: rnd.skip_mwc(s, s, n)[0], "lfsr": lambda n, s: rnd.skip_lfsr((s,), n, rnd.LFSR113[:1])[0], "wide": lambda n, s: rnd.skip_mwc64(lit(5), s, n)[1] if s is not None else None}
    for name, skip in one.items():
        if name == "wide":
            first = rnd.skip_mwc64(lit(5), lit(77), a)
            twice, once = rnd.skip_mwc64(*first, b)[1], rnd.skip_mwc64(lit(5), lit(77), both)[1]
        else:
            twice, once = skip(b, skip(a, lit(77))), skip(both, lit(77))
        assert all(r[0] == r[1] for r in df.select(twice, once).collect()), name


def test_seeds(spark):
    p = rnd.PRIMES
    df = spark.createDataFrame([(0,), (1,), (p[0],), (p[1] * 3,), (0xFFFFFFFF,)], "x long")
    x = F.col("x")
    rows = df.select("x", *rnd.seed_mwc(x, x), rnd.seed_shr3(x), *rnd.seed_mwc64(x, x), *rnd.seed_lfsr((x,) * 4)).collect()
    for r in rows:
        x, u, v, s, w0, w1, *z = r
        good = lambda k, p: (x % p or (x ^ 0xFFFFFFFF) % p) == k  # noqa: B023, E731
        whole = x << 32 | x
        assert good(u, p[0]) and good(v, p[1]) and s == (x or 0xFFFFFFFF)
        assert w0 << 32 | w1 == (whole % rnd.PRIME64 or (whole ^ (1 << 64) - 1) % rnd.PRIME64)
        assert all(k >= least for k, least in zip(z, (2, 8, 16, 128)))
