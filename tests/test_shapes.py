"""Operators against small hand-made shapes, brute force and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as G, random as rnd
from pointloom.operators import features, graph, kernels, labels, learning, mesh, normalize, parts, relational, sampling


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(3)
    rows = [(s, i, random.gauss(0, 0.2), random.gauss(0, 0.2), random.random() * 0.5) for s in ("a", "b") for i in range(60)]
    return spark.createDataFrame(rows + [("one", 0, 1.0, 2.0, 3.0)], "shape_id string, point_idx int, x double, y double, z double").persist()


def test_normalize_is_idempotent_and_has_diagonal_one(cloud):
    once = normalize.normalize_points(cloud).persist()
    box = normalize.bounding_box(once).filter("shape_id <> 'one'").collect()
    for b in box:
        assert math.dist((b.lo_x, b.lo_y, b.lo_z), (b.hi_x, b.hi_y, b.hi_z)) == pytest.approx(1)
        assert b.lo_z == pytest.approx(0)
    twice = {(r.shape_id, r.point_idx): r for r in normalize.normalize_points(once).collect()}
    for p in once.filter("shape_id <> 'one'").collect():
        assert tuple(p)[2:] == pytest.approx(tuple(twice[p.shape_id, p.point_idx])[2:])
    assert once.filter("shape_id = 'one' and x is null").count() == 1  # no extent


def test_compat_box_has_no_negative_upper_bound(spark):
    p = spark.createDataFrame([("s", 0, -2.0, 1.0, 0.0), ("s", 1, -1.0, 2.0, 1.0)], "shape_id string, point_idx int, x double, y double, z double")
    assert normalize.bounding_box(p).first().hi_x == -1
    assert normalize.bounding_box(p, compat=True).first().hi_x == G.SMALLEST


def test_rotation_keeps_distances_and_turns_right():
    m = G.rotation((0, 0, 1), 90)
    assert [round(sum(a * b for a, b in zip(r, (1, 0, 0))), 9) for r in m] == [0, 1, 0]


def test_knn_geodesics_and_components_against_brute_force(cloud):
    edges = graph.knn_edges(cloud).persist()
    assert edges.filter("i >= j").count() == 0
    rows = edges.filter("shape_id = 'a'").collect()
    inf = float("inf")
    d = [[0 if i == j else inf for j in range(60)] for i in range(60)]
    for e in rows:
        d[e.i][e.j] = d[e.j][e.i] = e.w
    for k in range(60):
        for i in range(60):
            for j in range(60):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    got = {(r.src, r.dst): r.d for r in graph.geodesics(edges, 0.3).filter("shape_id = 'a'").collect()}
    want = {(i, j): d[i][j] for i in range(60) for j in range(60) if i != j and d[i][j] < 0.3}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    comp = {r.point_idx: r.component for r in graph.components(cloud, edges).filter("shape_id = 'a'").collect()}
    assert all((comp[i] == comp[j]) == (d[i][j] < inf) for i in range(60) for j in range(60))
    assert graph.components(cloud, edges).filter("shape_id = 'one'").first().component == 0


def test_features_have_36_values_and_shares_sum_to_one_or_zero(cloud):
    f = features.features36(normalize.normalize_points(cloud.filter("shape_id <> 'one'"))).collect()
    assert len(f) == 120
    for r in f:
        assert len(r.f) == 36 and all(math.isfinite(v) for v in r.f)
        assert sum(r.f[28:]) == pytest.approx(1) or sum(r.f[28:]) == 0
        assert all(-1e-6 <= r.f[4 * k + j] <= 1 + 1e-6 for k in range(5) for j in range(2))


def test_cdf_and_samples(spark):
    v = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 1.0, 0.0, 0.0), ("s", 2, 0.0, 1.0, 0.0), ("s", 3, 0.0, 0.0, 0.0), ("s", 4, 3.0, 0.0, 0.0), ("s", 5, 0.0, 3.0, 0.0)], "shape_id string, v_idx int, x double, y double, z double")
    f = spark.createDataFrame([("s", 0, 0, 1, 2), ("s", 1, 3, 4, 5), ("s", 2, 0, 0, 1)], "shape_id string, f_idx int, v0 int, v1 int, v2 int")
    areas = sampling.face_areas(f, v).orderBy("f_idx").collect()
    assert [a.area for a in areas] == pytest.approx([0.5, 4.5, 0])
    cdf = sampling.face_cdf(sampling.face_areas(f, v).select("shape_id", "f_idx", "area")).collect()
    assert max(c.cdf for c in cdf) == pytest.approx(1)
    drawn = sampling.draw_faces(sampling.face_cdf(sampling.face_areas(f, v).select("shape_id", "f_idx", "area")), 500).groupBy("face_idx").count().collect()
    share = {r.face_idx: r["count"] / 500 for r in drawn}
    assert 2 not in share and share[1] == pytest.approx(0.9, abs=0.06)


def test_orientation_agrees_over_common_edges(spark):
    f = spark.createDataFrame([("s", 0, 0, 1, 2), ("s", 1, 1, 2, 3), ("s", 2, 2, 3, 4), ("s", 3, 9, 8, 7)], "shape_id string, f_idx int, v0 int, v1 int, v2 int")
    out = mesh.orient_faces(f)
    assert mesh.edge_counts(out).filter("faces = 2 and turns <> 0").count() == 0
    assert out.filter("f_idx = 3 and not turned").count() == 1


def test_split_parts_by_hand(spark):
    rows = [("s", i, 1, 0.01 * i, 0.0, 0.0) for i in range(12)] + [("s", 12 + i, 1, 5 + 0.01 * i, 0.0, 0.0) for i in range(14)] + [("s", 26 + i, 0, 9.0 + i, 1.0, 0.0) for i in range(3)]
    p = spark.createDataFrame(rows, "shape_id string, point_idx int, label int, x double, y double, z double")
    groups = spark.createDataFrame([(0, [0]), (1, [1, 2])], "group_idx int, members array<int>")
    got = {r.point_idx: r.new_label for r in parts.split_parts(p, groups, [(1.0, 0.0, 0.0)]).collect()}
    assert [got[i] for i in (0, 11, 12, 25, 26)] == [1, 1, 2, 2, 0]
    back = {r.point_idx: r.new_label for r in parts.split_parts(p, groups, [(-1.0, 0.0, 0.0)]).collect()}
    assert [back[i] for i in (0, 12)] == [2, 1]
    clusters = parts.part_components(p.filter("label = 1"), 10)
    assert parts.wrong_shapes(p, clusters, groups, "force_match").count() == 0
    assert parts.count_parts(p, 3, larger_than=11).orderBy("label").collect()[1].parts == 2


def test_labels_and_probabilities(spark):
    p = spark.createDataFrame([("s", 0, 0, 0.5), ("s", 0, 1, 0.5), ("s", 1, 0, 0.0), ("s", 1, 1, 0.0), ("s", 2, 0, 0.1), ("s", 2, 1, 0.4)], "shape_id string, point_idx int, label int, p double")
    assert {r.point_idx: r.label for r in labels.best_label(p).collect()} == {0: 0, 1: 0, 2: 1}
    t = spark.range(-2, 5).select(F.col("id").cast("int").alias("l"))
    assert [r[0] for r in t.select(labels.null_label(F.col("l"), 3)).collect()] == [3, 3, 0, 1, 2, 3, 3]
    assert [r[0] for r in t.filter("l >= 0").select(labels.symmetric(F.col("l"), F.lit(1), [[0], [1, 2]])).collect()] == [False, True, True, False, False]


def test_forest_learns_a_simple_rule(spark, tmp_path):
    random.seed(1)
    rows = [("s", i, [random.random(), random.random()]) for i in range(300)]
    f = spark.createDataFrame(rows, "shape_id string, point_idx int, f array<double>")
    t = f.select("shape_id", F.col("point_idx").alias("elem_idx"), (F.col("f")[0] > 0.5).cast("int").alias("label"))
    groups = [[0], [1]]
    models = learning.train(learning.training_set(f, t, 2), groups, trees=10, depth=4)
    learning.save(models, groups, str(tmp_path), "x")
    models = learning.load(groups, str(tmp_path), "x")
    probs = learning.predict(f, models, groups, 2)
    assert probs.filter("label = 2 and p <> 0").count() == 0
    assert learning.evaluate(probs, t, 2).first().accuracy > 0.95
    assert learning.mismatched(f, t.filter("elem_idx > 0")).first().labels == 299


def test_generators_against_plain_integers(spark):
    def shr3(s):
        s ^= (s << 13) & 0xFFFFFFFF
        s ^= s >> 17
        return s ^ ((s << 5) & 0xFFFFFFFF)

    r = spark.range(1, 50).select("id", rnd.cong(F.col("id")).alias("c"), rnd.shr3(F.col("id")).alias("s")).collect()
    assert all(x.c == (69069 * x.id + 12345) % 2**32 and x.s == shr3(x.id) for x in r)


def test_histogram_edges(spark):
    t = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 3.5, -1.0)], "v double")
    assert {r.bin: r.n for r in relational.histc(t, "v", [1.0, 2.0, 3.0]).collect()} == {-1: 3, 0: 2, 1: 1, 2: 1}


def test_enclosing_ball_holds_all_and_touches(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 200):
        p = rng.normal(size=(n, 3))
        c, r = kernels.ball(p)
        d = np.sqrt(((p - c) ** 2).sum(1))
        assert d.max() == pytest.approx(r) and (n == 1 or (d > r - 1e-7).sum() >= 2)
    square = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0], [2, 2, 0], [1, 1, 0]], float)
    assert kernels.ball(square)[1] == pytest.approx(2**0.5)
    df = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 0.0, 0.0, 2.0)], "shape_id string, point_idx int, x double, y double, z double")
    assert kernels.enclosing_balls(df).first().radius == pytest.approx(1)
    assert [r.kept for r in sampling.merge_near(df, 3.0).orderBy("point_idx").collect()] == [0, 0]
    assert sorted(r.seed for r in kernels.farthest_groups(df, 2).collect()) == [0, 1]


def test_procrustes_undoes_a_turn(cloud):
    p = cloud.filter("shape_id = 'a'")
    moved = normalize.translate(normalize.rescale(normalize.rotate_axis_angle(p, axis=(0.0, 0.6, 0.8), degrees=40.0), 2.0), (1.0, 2.0, 3.0))
    q = moved.select("shape_id", "point_idx", *(F.col(a).alias(b) for a, b in zip("xyz", "uvw")))
    r = kernels.align(p.join(q, ["shape_id", "point_idx"])).first()
    assert r.scale == pytest.approx(2) and list(r.shift) == pytest.approx([1, 2, 3])
    assert list(r.rotation) == pytest.approx([v for row in G.rotation((0.0, 0.6, 0.8), 40.0) for v in row], abs=1e-9)


def test_nearest_over_the_grid_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    for p in (rng.normal(size=(700, 3)), np.round(rng.random((400, 3)) * 5), np.zeros((30, 3)), np.c_[rng.random((300, 1)) * 100, np.zeros((300, 2))], rng.random((4, 3)), np.r_[rng.random((200, 3)), [[1e4, 0, 0]]]):
        q = np.r_[p, rng.normal(size=(20, 3)) * 3, [[500.0, -500.0, 0.0]]]
        for k in (1, 10):
            at, d2 = graph._Grid(p, k).nearest(q, k)
            d = ((q[:, None] - p[None]) ** 2).sum(2)
            for i in range(len(q)):
                x, y, z = (q[i, c] - p[:, c] for c in range(3))
                want = np.argsort(x * x + y * y + z * z, kind="stable")[: min(k, len(p))]
                assert at[i].tolist() == want.tolist() and d2[i] == pytest.approx(d[i][want])


def test_one_large_shape(spark):
    """A shape of 100,000 points: neighbours, components and bounded paths, its sources spread over tasks."""
    n = 100_000
    p = spark.range(n, numPartitions=4).select(F.lit("big").alias("shape_id"), F.col("id").cast("int").alias("point_idx"), (F.col("id") % 317).cast("double").alias("x"), F.floor(F.col("id") / 317).cast("double").alias("y"), F.lit(0.0).alias("z"))
    edges = graph.knn_edges(p, 5).persist()
    assert edges.count() > 150_000 and edges.filter("w <> 1").count() < 2000
    assert graph.components(p, edges).select("component").distinct().count() == 1
    few = graph.geodesics(edges.filter("i < 3170 and j < 3170"), 2.5)
    assert few.filter("src = 1600").count() == 12


def test_orientation_loops_groups_and_merging_against_brute_force(spark, cloud):
    rows = [r for r in cloud.filter("shape_id = 'a'").orderBy("point_idx").collect()]
    xyz = [(r.x, r.y, r.z) for r in rows]
    kept, to = [], {}
    for i, a in enumerate(xyz):
        near = [k for k in kept if math.dist(xyz[k], a) < 0.15]
        to[i] = near[0] if near else i
        kept += [] if near else [i]
    assert {r.point_idx: r.kept for r in sampling.merge_near(cloud, 0.15).filter("shape_id = 'a'").collect()} == to and 1 < len(kept) < 60
    seeds = [0]
    for _ in range(4):
        seeds.append(max(range(60), key=lambda i: (min(math.dist(xyz[i], xyz[s]) for s in seeds), -i)))
    got = {r.point_idx: r for r in kernels.farthest_groups(cloud, 5).filter("shape_id = 'a'").collect()}
    assert all(got[i].d2 == pytest.approx(min(math.dist(xyz[i], xyz[s]) for s in seeds) ** 2) and got[s].seed == k for i in range(60) for k, s in enumerate(seeds))
    # a cube of twelve faces, some turned, without its lid: one loop of four
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4)]
    random.seed(4)
    faces = [f for a, b, c, d in quads for f in ((a, b, c), (a, c, d))]
    faces = [f if random.random() < 0.5 else f[::-1] for f in faces]
    df = spark.createDataFrame([("c", k, *f) for k, f in enumerate(faces)], "shape_id string, f_idx int, v0 int, v1 int, v2 int")
    out = mesh.orient_faces(df)
    assert mesh.edge_counts(out).filter("faces = 2 and turns <> 0").count() == 0 and 2 * out.filter("turned").count() <= 10
    loop = [r.v for r in mesh.boundary_loops(out).orderBy("loop", "place").collect()]
    assert loop[0] == 1 and set(loop) == {1, 3, 5, 7} and {frozenset(e) for e in zip(loop, loop[1:] + loop[:1])} == {frozenset(e) for e in ((1, 3), (3, 7), (7, 5), (5, 1))}
    assert {r.v_idx for r in mesh.irregular_vertices(df, 5).collect()} <= {0, 2, 4, 6}
    assert {(r.v_idx, r.manifold) for r in mesh.vertex_manifold(spark.createDataFrame([("s", 0, 0, 1, 2), ("s", 1, 0, 2, 3), ("s", 2, 0, 4, 5)], df.schema)).collect()} == {(0, False), (1, True), (2, True), (3, True), (4, True), (5, True)}


def test_labels_out_of_range_are_an_error(spark):
    p = spark.createDataFrame([("s", 0, 0), ("s", 1, None), ("s", 2, 2)], "shape_id string, point_idx int, label int")
    assert [r.label for r in parts.checked(p, 3).orderBy("point_idx").collect()] == [0, None, 2]
    with pytest.raises(Exception, match="label out of range: 2"):
        parts.checked(p, 2).collect()


def test_numbering_over_ranges(spark):
    t = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 13).alias("v"))
    got = {r.k: r.s for r in relational.before(t, ["k"], F.col("v"), "s").collect()}
    total = 0
    for r in sorted(t.collect()):
        assert got[r.k] == total
        total += r.v
    assert [r["rank"] for r in relational.sort_rows(t, [F.col("k").desc()], "v").orderBy(F.col("k").desc()).collect()] == list(range(5000))
    with pytest.raises(ValueError, match="distinct"):
        relational.combinations(t, "k", 2)


def test_wide_generators_against_plain_integers(spark):
    r = spark.range(1, 40).select("id", *(c.alias(f"c{k}") for k, c in enumerate(rnd.kiss2((F.col("id") * 99_999_989 % 2**32, F.col("id") * 77_777_777 % 2**32), F.col("id"), F.col("id") + 5)))).collect()
    for x in r:
        whole = 698769069 * (x.id * 77_777_777 % 2**32) + x.id * 99_999_989 % 2**32
        assert (x.c0, x.c1) == (whole >> 32, whole % 2**32) and x.c4 == (x.c1 + x.c2 + x.c3) % 2**32


def test_moves_are_undone(cloud):
    steps = [((1.0, -2.0, 0.5), 3.0), ((0.0, 4.0, 0.0), 0.25)]
    back = {tuple(r)[:2]: tuple(r)[2:] for r in normalize.restored(normalize.moved(cloud, steps), steps).collect()}
    assert all(back[tuple(r)[:2]] == pytest.approx(tuple(r)[2:]) for r in cloud.collect())


def test_distances_and_rays_of_a_cube(spark):
    corner = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = spark.createDataFrame([("c", 2 * k + j, *f) for k, (a, b, c, d) in enumerate(quads) for j, f in enumerate(((a, b, c), (a, c, d)))], "shape_id string, f_idx int, v0 int, v1 int, v2 int")
    vertices = spark.createDataFrame([("c", i, *p) for i, p in enumerate(corner)], "shape_id string, v_idx int, x double, y double, z double")
    q = spark.createDataFrame([("c", 0, 0.5, 0.4, 0.3), ("c", 1, 2.0, 0.5, 0.5), ("c", 2, 2.0, 2.0, 0.5)], "shape_id string, q_idx int, x double, y double, z double")
    s = {r.q_idx: r.s for r in mesh.signed_distance(q, faces, vertices).collect()}
    assert (s[0], s[1], s[2]) == pytest.approx((-0.3, 1.0, 2**0.5))
    hits = mesh.ray_hits(q.withColumns({"dx": F.lit(-1.0), "dy": F.lit(0.01), "dz": F.lit(0.02)}), faces, vertices).collect()
    assert sorted((r.q_idx, round(r.t, 9)) for r in hits) == [(0, 0.5), (1, 1.0), (1, 2.0)]
