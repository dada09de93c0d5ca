"""What only shows on large tables, made small."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pointloom.operators import graph, mesh
from pointloom.plans import mesh_queries, registry

from .conftest import DATA


def test_faces_of_different_strips_share_numbers(spark, tmp_path, monkeypatch):
    """As with more than 1,000,003 orders, by 1,009 numbers for 4,000: components of equal least numbers share theirs, no face is lost or doubled."""
    monkeypatch.setattr(mesh_queries, "_NUMBERS", 1009)
    orders = spark.range(4000, numPartitions=3).select(F.col("id").alias("o_orderkey"), (F.xxhash64("id") % 1000 + 1000).alias("o_custkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    df = registry.QUERIES["large_shape_orientation"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL['large_shape_orientation'].replace('1000003', '1009')})").fetchall()
    assert len(want) == 4 * 998 and len({r[0:2] for r in want}) < len(want)
    assert sorted(map(tuple, df.collect())) == sorted(want)


def _broadcast(df) -> list[str]:
    """Of each broadcast table of the plan, the first operator below projections and filters."""
    lines = [re.sub(r"^[\s:+\-|]*(\*\(\d+\) )?", "", x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x.strip()]
    at = [k for k, x in enumerate(lines) if x.startswith("BroadcastExchange")]
    return [next(x.split()[0] for x in lines[k + 1 :] if not x.startswith(("Project", "Filter"))) for k in at]


@pytest.mark.parametrize("name", ["path_distance", "mean_curvature"])
def test_rows_that_spark_cannot_foresee_are_not_broadcast(spark, name):
    """A point's pairs and the 27 cells around it are many times what Spark takes them for; the driver ran out of memory."""
    assert not {"FlatMapGroupsInArrow", "Generate"} & set(_broadcast(registry.QUERIES[name](spark, DATA)))


def test_curvatures_by_blocks_of_vertices(spark, monkeypatch):
    """Scrambled numbers and blocks of four, so that rings reach over several blocks: the sums of pairs of near vertices, which are no longer exchanged."""
    rng = random.Random(5)
    n, rows, faces = 9, [], []
    for s in "ab":
        name = rng.sample(range(-20, 100), n * n)
        rows += [(s, name[k], k % n + rng.uniform(-0.2, 0.2), k // n + rng.uniform(-0.2, 0.2), rng.random()) for k in range(n * n)]
        squares = [k for k in range(n * n) if k % n < n - 1 and k // n < n - 1]
        faces += [(s, 2 * k + j, *(name[k + d] for d in ds)) for k in squares for j, ds in enumerate(((0, 1, n), (1, n + 1, n)))]
        faces.append((s, -1, name[0], name[0], 500))  # degenerate, and one vertex is missing
    f, v = spark.createDataFrame(faces, "shape_id string, f_idx int, v0 int, v1 int, v2 int"), spark.createDataFrame(rows, "shape_id string, v_idx int, x double, y double, z double")
    key, at = ["shape_id", "v_idx"], {r[:2]: r[2:] for r in rows}
    for depth in (1, 2, 3):
        monkeypatch.setattr(mesh, "_BITS", 17)
        whole = {r[:2]: r[2:] for r in mesh._ring_sums(f, v, depth).collect()}
        near = {r[:2]: r[2] for r in mesh.rings(f, depth).filter("u <> v").join(v.withColumnRenamed("v_idx", "v"), ["shape_id", "v"]).groupBy("shape_id", F.col("u").alias("v_idx")).agg(F.count("*")).collect()}
        assert {k: x[0] for k, x in whole.items()} == {k: near[k] for k in at}
        curved = {r[:2]: r[2:] for r in mesh.principal_curvatures(f, v, depth=depth).collect()}
        monkeypatch.setattr(mesh, "_BITS", 2)
        parts = {r[:2]: r[2:] for r in mesh._ring_sums(f, v, depth).collect()}
        assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], rel=1e-9, abs=1e-9) for k in whole)
        again = {r[:2]: r[2:] for r in mesh.principal_curvatures(f, v, depth=depth).collect()}
        assert again.keys() == curved.keys() and all(again[k] == pytest.approx(curved[k], rel=1e-6, abs=1e-6) for k in curved)
    plan = mesh.principal_curvatures(f, v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, "faces and vertices once, no pairs"


def test_paths_by_cells_are_those_of_the_kernel(spark, monkeypatch):
    """Two shapes of many cells, with isolated and coincident points; the pairs are not written or exchanged on their way."""
    monkeypatch.setattr(graph, "_BLOCK", 16)
    rng = random.Random(12)
    rows = [(s, k, rng.random() * w - 1, rng.random(), rng.random() * 0.2) for s, w in (("a", 1.0), ("b", 6.0)) for k in range(200)]
    rows += [("b", 200, *rows[-1][2:]), ("b", 201, 50.0, 0.0, 0.0), ("c", 7, 0.0, 0.0, 0.0), ("c", 8, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "shape_id string, point_idx int, x double, y double, z double")
    edges = graph.knn_edges(points, 6).persist()
    for radius in (0.25, 0.8):
        near = graph.geodesics_near(points, edges, radius)
        got, want = ({tuple(r)[:3]: r.d for r in df.collect()} for df in (near, graph.geodesics(edges, radius)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and near.count() == len(want) > 100
    out = registry.QUERIES["large_shape_geodesic"](spark, DATA)
    lines = [re.sub(r"^[\s:+\-|]*(\*\(\d+\) )?", "", x) for x in out._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert [x.split()[0] for x in lines if x.strip()][:3] == ["AdaptiveSparkPlan", "Project", "FlatMapGroupsInArrow"]
