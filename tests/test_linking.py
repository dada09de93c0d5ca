"""Components with parity, ranked lists, loops and curves against plain loops, on orders that are hard for labels."""

import random

from pointloom.operators import linking, mesh

FACES = "shape_id string, f_idx int, v0 int, v1 int, v2 int"


def test_signed_components_against_a_walk(spark):
    rng = random.Random(5)
    links, shapes = [], {"path": list(range(700)), "star": list(range(300)), "wood": list(range(400))}
    for name, nodes in shapes.items():
        rng.shuffle(nodes)
        side = {n: rng.random() < 0.5 for n in nodes}  # flips that do not contradict each other
        pairs = {"path": list(zip(nodes, nodes[1:])), "star": [(nodes[0], n) for n in nodes[1:]], "wood": [(nodes[i], nodes[rng.randrange(max(1, i - 30), i + 1)]) for i in range(2, len(nodes)) if i % 17]}[name]
        links += [(name, a, b, side[a] != side[b]) for a, b in pairs] + [(name, pairs[0][1], pairs[0][0], side[pairs[0][0]] != side[pairs[0][1]])]
    nodes = [(n, i) for n, ids in shapes.items() for i in ids] + [("wood", 999), ("path", 3)]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in linking.signed_components(spark.createDataFrame(nodes, "shape_id string, node long"), spark.createDataFrame(links, "shape_id string, a long, b long, flip boolean")).collect()}
    around = {}
    for s, a, b, f in links:
        around.setdefault((s, a), []).append((b, f))
        around.setdefault((s, b), []).append((a, f))
    want = {}
    for s, n in sorted(set(nodes)):
        if (s, n) in want:
            continue
        want[s, n], line = (n, False), [n]
        for x in line:
            for y, f in around.get((s, x), []):
                if (s, y) not in want:
                    want[s, y] = n, want[s, x][1] != f
                    line.append(y)
    assert got == want and len({v[0] for k, v in got.items() if k[0] == "wood"}) > 5


def test_flips_that_contradict_each_other_end(spark):
    ring = [("s", k, (k + 1) % 5, True) for k in range(5)]
    got = linking.signed_components(spark.createDataFrame([("s", k) for k in range(5)], "shape_id string, node int"), spark.createDataFrame(ring, "shape_id string, a long, b long, flip boolean")).collect()
    assert {r.label for r in got} == {0} and len(got) == 5


def test_ranked_lists(spark):
    rng = random.Random(2)
    arcs, want = [], {}
    for shape, sizes in (("a", (1, 2, 3, 64, 500)), ("b", (1000, 1, 33))):
        ids = list(range(3000))
        rng.shuffle(ids)
        for k, n in enumerate(sizes * 2):
            own, closed = [ids.pop() for _ in range(n)], k < len(sizes)
            if k % 3 == 0 and not closed:
                own.sort()  # ids that rise along an open list
            start = own.index(min(own)) if closed else 0
            own = own[start:] + own[:start]
            arcs += [(shape, x, y) for x, y in zip(own, own[1:])] + [(shape, own[-1], own[0] if closed else None)]
            want |= {(shape, x): (own[0], p, n) for p, x in enumerate(own)}
    rng.shuffle(arcs)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in linking.ranked_lists(spark.createDataFrame(arcs, "shape_id string, id long, next long")).collect()}
    assert got == want
    assert linking.ranked_lists(spark.createDataFrame([], "shape_id string, id long, next long")).count() == 0


def test_components_and_loops_of_a_torn_sheet(spark):
    """A sheet of squares with a hole, faces and vertices in any order, and a lone face: three loops, two components."""
    rng = random.Random(7)
    n = 14
    name = list(range((n + 1) ** 2))
    rng.shuffle(name)
    at = lambda x, y: name[y * (n + 1) + x]
    faces = []
    for x in range(n):
        for y in range(n):
            if not (4 <= x < 7 and 5 <= y < 9):
                a, b, c, d = at(x, y), at(x + 1, y), at(x + 1, y + 1), at(x, y + 1)
                faces += [(a, b, c), (a, c, d)]
    faces = [f if rng.random() < 0.6 else f[::-1] for f in faces] + [(900, 901, 902)]
    rng.shuffle(faces)
    df = spark.createDataFrame([("s", k, *f) for k, f in enumerate(faces)], FACES).repartition(3)
    parts = mesh.facet_components(df).collect()
    lone = faces.index((900, 901, 902))
    assert {r.component for r in parts if r.f_idx != lone} == {0} and {r.component for r in parts if r.f_idx == lone} == {1}
    out = mesh.orient_faces(df)
    assert mesh.edge_counts(out).filter("faces = 2 and turns <> 0").count() == 0 and out.count() == len(faces)
    assert all(set(r[2:5]) == set(faces[r.f_idx]) for r in out.collect())
    loops = {}
    for r in mesh.boundary_loops(out).collect():
        loops.setdefault(r.loop, {})[r.place] = r.v
    loops = sorted(([x[k] for k in range(len(x))] for _, x in sorted(loops.items())), key=len)
    assert [len(x) for x in loops] == [3, 14, 4 * n] and all(x[0] == min(x) for x in loops)
    border = {frozenset((r.a, r.b)) for r in mesh.boundary_edges(df).collect()}
    assert {frozenset(e) for x in loops for e in zip(x, x[1:] + x[:1])} == border


def test_curves_where_three_faces_meet(spark):
    """A closed ring of heavy edges, an open path, and a branch where curves end."""
    heavy = [(k, (k + 1) % 6) for k in range(6)] + [(20, 21), (21, 22), (22, 23)] + [(30, 31), (31, 32), (31, 33)]
    faces = [(a, b, 1000 + 3 * k + j) for k, (a, b) in enumerate(heavy) for j in range(3)]
    df = spark.createDataFrame([("s", k, *f) for k, f in enumerate(faces)] + [("plain", 0, 0, 1, 2)], FACES)
    curves = {}
    for r in mesh.edge_curves(df).collect():
        curves.setdefault((r.curve, r.closed), {})[r.place] = r.v
    got = sorted((closed, [x[k] for k in range(len(x))]) for (_, closed), x in curves.items())
    assert got == [(False, [20, 21, 22, 23]), (False, [30, 31]), (False, [31, 32]), (False, [31, 33]), (True, [0, 1, 2, 3, 4, 5])]
    patches = mesh.manifold_patches(df).filter("shape_id = 's'").collect()
    assert len({r.component for r in patches}) == len(faces)


def test_curvatures_of_a_sphere_and_a_cylinder(spark):
    """Random patches of known radius; flat ones have none."""
    import math

    rng = random.Random(3)
    n, rows, faces = 12, [], []
    shapes = {"ball": 2.0, "tube": 0.5, "flat": 1.0}
    for s, r in shapes.items():
        for k in range(n * n):
            a, b = (k % n - n / 2 + rng.uniform(-0.2, 0.2)) * 0.04, (k // n - n / 2 + rng.uniform(-0.2, 0.2)) * 0.04
            x, y = a * r, b * r
            z = {"ball": math.sqrt(r * r - x * x - y * y), "tube": math.sqrt(r * r - x * x), "flat": 0.3 * x - 0.1 * y}[s]
            rows.append((s, k, x, y, z))
        for k in range(n * n):
            if k % n < n - 1 and k // n < n - 1:
                faces += [(s, 2 * k, k, k + 1, k + n), (s, 2 * k + 1, k + 1, k + n + 1, k + n)]
    got = mesh.principal_curvatures(spark.createDataFrame(faces, FACES), spark.createDataFrame(rows, "shape_id string, v_idx int, x double, y double, z double")).collect()
    inner = [r for r in got if 2 <= r.v_idx % n < n - 2 and 2 <= r.v_idx // n < n - 2]
    assert len(inner) == 3 * (n - 4) ** 2
    want = {"ball": (0.5, 0.5), "tube": (2.0, 0.0), "flat": (0.0, 0.0)}
    for r in inner:
        assert abs(r.k1 - want[r.shape_id][0]) < 0.03 * (1 + want[r.shape_id][0]) and abs(r.k2 - want[r.shape_id][1]) < 0.05, r


def test_paths_by_rounds_are_those_of_the_kernel(spark):
    import math

    from pointloom.operators import graph

    rng = random.Random(11)
    rows = [(s, k, rng.random() * w, rng.random(), rng.random() * 0.2) for s, w in (("a", 1.0), ("b", 6.0)) for k in range(150)]
    edges = graph.knn_edges(spark.createDataFrame(rows, "shape_id string, point_idx int, x double, y double, z double"), 6).persist()
    for radius in (0.25, 0.8, math.inf):
        want = {tuple(r)[:3]: r.d for r in graph.geodesics(edges, radius).collect()}
        got = {tuple(r)[:3]: r.d for r in graph.geodesics_by_rounds(edges, radius).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - d) < 1e-9 for k, d in want.items())
        if radius == 0.8:
            break


def test_independent_sets_are_those_of_the_order(spark):
    rng = random.Random(8)
    nodes, links = [], []
    for s, n in (("thin", 200), ("thick", 60), ("line", 150)):
        ids = list(range(n))
        nodes += [(s, k, rng.randrange(5) if s != "line" else rng.randrange(1000)) for k in ids]
        links += [(s, *rng.sample(ids, 2)) for _ in range(4 * n if s == "thick" else n)] if s != "line" else [(s, k, k + 1) for k in ids[:-1]]
    links += links[:9] + [("thin", 3, 3)] + [("thin", b, a) for _, a, b in links[:5]]
    df = spark.createDataFrame(nodes, "shape_id string, node int, priority int")
    got = {(r.shape_id, r.node) for r in linking.independent_set(df, spark.createDataFrame(links, "shape_id string, a int, b int")).filter("kept").collect()}
    want = set()
    for s, k, _ in sorted(nodes, key=lambda x: (x[2], x[1])):
        if not any((s, b if a == k else a) in want for t, a, b in links if t == s and k in (a, b) and a != b):
            want.add((s, k))
    assert got == want
    assert linking.independent_set(df, spark.createDataFrame([], "shape_id string, a int, b int")).filter("kept").count() == len(nodes)


def test_blue_noise_of_many_draws(spark):
    import math

    from pointloom.operators import sampling

    rng = random.Random(9)
    rows = [(s, k, rng.random(), rng.random(), 0.0) for s in ("a", "b") for k in range(400)] + [("one", 0, 1.0, 1.0, 1.0), ("same", 0, 0.0, 0.0, 0.0), ("same", 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "shape_id string, point_idx int, x double, y double, z double")
    kept = {(r.shape_id, r.point_idx): (r.x, r.y, r.z) for r in sampling.blue_noise(df, 0.12, seed=5).collect()}
    for s, k, *p in rows:
        near = [o for o, q in kept.items() if o[0] == s and o[1] != k and math.dist(p, q) < 0.12]
        assert bool(near) != ((s, k) in kept)
    assert len(kept) < 200 and ("one", 0) in kept and len([k for k in kept if k[0] == "same"]) == 1


def test_smallest_balls_of_degenerate_supports():
    import numpy as np

    from pointloom.operators import kernels

    rng = np.random.default_rng(1)
    cube = np.array([(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)])
    for p in (cube, np.repeat(cube, 3, 0), np.r_[cube, rng.uniform(-1, 1, (500, 3))]):
        c, r = kernels.ball(p)
        assert np.allclose(c, 0, atol=1e-9) and abs(r - 3**0.5) < 1e-9
    for _ in range(40):
        u = rng.normal(size=(60, 3))
        u /= np.linalg.norm(u, axis=1, keepdims=True)  # all on one sphere
        c, r = kernels.ball(u * 2 + 5)
        assert r <= 2 + 1e-9 and (np.linalg.norm(u * 2 + 5 - c, axis=1) <= r * (1 + 1e-9)).all()
        line = np.outer(rng.normal(size=30), (1.0, 2.0, 3.0))
        assert abs(kernels.ball(line)[1] - np.linalg.norm(line.max(0) - line.min(0)) / 2) < 1e-9
    assert kernels.ball(np.ones((4, 3)))[1] == 0


def test_small_faces_collapse_until_none_is_left(spark):
    """A sheet with a row of slivers, a fan of tiny faces and a big face of its own."""
    n = 6
    rows = [("s", y * n + x, x * 1.0 if x < 3 else x - 0.999, float(y), 0.0) for y in range(n) for x in range(n)]  # columns 2 and 3 nearly meet
    faces = [f for y in range(n - 1) for x in range(n - 1) for a in (y * n + x,) for f in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    rows += [("s", 100 + k, 20 + 1e-5 * k, 1e-5 * k * k, 0.0) for k in range(5)] + [("s", 200, 30.0, 3.0, 0.0), ("s", 201, 31.0, 0.0, 0.0), ("s", 202, 30.0, 5.0, 0.0)]
    faces += [(100, 101 + k, 102 + k) for k in range(3)] + [(104, 200, 201), (200, 201, 202)]
    df = spark.createDataFrame([("s", k, *f) for k, f in enumerate(faces)], FACES)
    vertices = spark.createDataFrame(rows, "shape_id string, v_idx int, x double, y double, z double")
    left = {r.f_idx: (r.v0, r.v1, r.v2) for r in mesh.collapse_small(df, vertices, 1e-6).collect()}
    at = {r[1]: r[2:] for r in rows}
    area = lambda f: abs((at[f[1]][0] - at[f[0]][0]) * (at[f[2]][1] - at[f[0]][1]) - (at[f[1]][1] - at[f[0]][1]) * (at[f[2]][0] - at[f[0]][0])) / 2
    limit = 1e-6 * (31.0**2 + 5.0**2)
    slivers = {k for k, f in enumerate(faces) if area(f) < limit}
    assert len(slivers) == 13 and set(left) == set(range(len(faces))) - slivers
    assert all(area(f) >= limit and len(set(f)) == 3 for f in left.values())
    assert left[len(faces) - 1] == faces[-1] and left[len(faces) - 2] == (103, 200, 201)
    assert mesh.collapse_small(df, vertices, 0.0).count() == len(faces)
