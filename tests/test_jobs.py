"""From mesh files to probabilities: read, normalise, sample, label, features, forests, write."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.plans import jobs
from pointloom.sources import text


@pytest.fixture(scope="module")
def meshes(tmp_path_factory):
    """Boxes with a flat lid: faces of the lid have label 1, all others 0."""
    path = tmp_path_factory.mktemp("meshes")
    random.seed(2)
    for k in range(3):
        h = 1.5 + k / 4
        v = [(x, y, z * h) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
        quads = [(0, 2, 6, 4), (1, 3, 7, 5), (0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6)]
        faces = [f for a, b, c, d in quads for f in ((a, b, c), (a, c, d))]
        body = [f"{x} {y} {z}" for x, y, z in v] + ["3 " + " ".join(map(str, f)) for f in faces]
        (path / f"box_{k}.off").write_text("\n".join(["OFF", f"{len(v)} {len(faces)} 0", *body]) + "\n")
        (path / f"box_{k}.seg").write_text("\n".join("1" if f in (2, 3) else "0" for f in range(len(faces))) + "\n")
    return path


def test_from_files_to_probabilities(spark, meshes, tmp_path):
    points = jobs.sample_meshes(spark, f"{meshes}/*.off", f"{tmp_path}/s", 150, n_dense=40, labels=f"{meshes}/*.seg").persist()
    rows = points.collect()
    assert len(rows) == 450 and {r.shape_id for r in rows} == {"box_0", "box_1", "box_2"}
    top = {r.shape_id: max(p.z for p in rows if p.shape_id == r.shape_id) for r in rows}
    assert all((r.label == 1) == math.isclose(r.z, top[r.shape_id]) for r in rows)
    assert all(-1e-9 <= r.z <= 1 for r in rows)
    # what was written reads back
    back = text.read_points(spark, f"{tmp_path}/s/pts/*/*.txt")
    assert back.count() == 450 and text.read_points(spark, f"{tmp_path}/s/dense/*/*.txt").count() == 120
    assert text.read_labels(spark, f"{tmp_path}/s/seg/*/*.txt").groupBy("label").count().count() == 2
    assert text.read_off_vertices(spark, f"{tmp_path}/s/off/*/*.txt").count() == 24
    groups = [[0], [1]]
    models = jobs.train_forests(points.filter("shape_id <> 'box_2'"), groups, 2, trees=12, depth=6)
    best = jobs.classify(points.filter("shape_id = 'box_2'"), models, groups, 2, f"{tmp_path}/c")
    met = best.withColumnRenamed("label", "found").join(points, ["shape_id", "point_idx"])
    assert met.filter("found = label").count() >= 0.85 * 150
    probs = spark.read.parquet(f"{tmp_path}/c/probabilities")
    assert probs.groupBy("shape_id", "label").count().count() == 3 and probs.filter(~F.col("p").between(0, 1)).count() == 0
    assert text.read_labels(spark, f"{tmp_path}/c/labels/*/*.txt").count() == 150


def test_the_same_draws_for_names_and_other_seeds_differ(spark, meshes):
    vertices, faces = jobs.load_mesh(spark, f"{meshes}/box_0.off")
    from pointloom.operators import sampling

    a, b, c = (sorted(map(tuple, sampling.sample_points(faces, vertices, 50, seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c


def test_split_job(spark, tmp_path):
    rows = [("s", i, 1, 0.01 * i, 0.0, 0.0) for i in range(12)] + [("s", 12 + i, 1, 5 + 0.01 * i, 0.0, 0.0) for i in range(14)] + [("s", 26 + i, 0, 9.0 + i, 1.0, 0.0) for i in range(3)] + [("w", i, 1, 0.01 * i, 0.0, 0.0) for i in range(12)]
    p = spark.createDataFrame(rows, "shape_id string, point_idx int, label int, x double, y double, z double")
    groups = spark.createDataFrame([(0, [0]), (1, [1, 2])], "group_idx int, members array<int>")
    split, wrong = jobs.split_shapes(p, groups, [(1.0, 0.0, 0.0)], str(tmp_path))
    assert {r.new_label for r in split.filter("shape_id = 's'").collect()} == {0, 1, 2}
    assert [r.shape_id for r in wrong.collect()] == ["w"]
    assert text.read_labels(spark, f"{tmp_path}/seg/*/*.txt").count() == 41
    with pytest.raises(Exception, match="label out of range"):
        jobs.split_shapes(p.withColumn("label", F.lit(7)), groups, [(1.0, 0.0, 0.0)], f"{tmp_path}/x")
