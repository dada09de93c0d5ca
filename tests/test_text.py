"""Text sources and sinks: round trips and the forms that files come in."""

import pytest
from pyspark.sql import functions as F

from pointloom.sources import sinks, text


def put(folder, name, body):
    (folder / name).write_text(body)
    return str(folder / name)


def test_points_with_three_and_seven_columns(spark, tmp_path):
    put(tmp_path, "a.pts", "0.1  0.2 0.3\n\n1 2 3\n")
    put(tmp_path, "b.pts", "4 0.1 0.2 0.3 7 8 9\n")
    rows = {(r.shape_id, r.point_idx): r for r in text.read_points(spark, str(tmp_path)).collect()}
    assert rows["a", 1].x == 1 and rows["a", 0].y == pytest.approx(0.2) and rows["a", 0].face_idx is None
    assert rows["b", 0].face_idx == 4 and rows["b", 0].z == 9 and rows["b", 0].bx == pytest.approx(0.1)


def test_off_round_trip_comments_and_fans(spark, tmp_path):
    path = put(tmp_path, "m.off", "OFF # shape\n4 2 0\n0 0 0\n1 0 0 # corner\n1 1 0\n0 1 0\n3 0 1 2\n4 0 1 2 3\n")
    v, f = text.read_off_vertices(spark, path), text.read_off_polygons(spark, path)
    assert v.count() == 4 and [list(r.corners) for r in f.orderBy("f_idx").collect()] == [[0, 1, 2], [0, 1, 2, 3]]
    fan = text.fan(f).persist()
    assert sorted(tuple(r)[1:] for r in fan.collect()) == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 3)]
    with pytest.raises(Exception, match="no triangle"):
        text.triangles(f).collect()
    sinks.write_texts(sinks.off_text(v, fan), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out"), wholetext=True).first().value
    back = put(tmp_path, "back.off", again)
    assert text.read_off_vertices(spark, back).select("x", "y", "z").collect() == v.select("x", "y", "z").collect()
    assert text.read_off_polygons(spark, back).count() == 3


def test_obj_corner_forms_and_negative_indices(spark, tmp_path):
    path = put(tmp_path, "m.obj", "# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nvn 0 0 1\nf 1/1/1 2/1/1 3/1/1\nf 1//1 2//1 3//1\nf -3 -2 -1\n")
    v, f = text.read_obj(spark, path)
    assert v.count() == 3
    rows = f.orderBy("f_idx").collect()
    assert all(list(r.corners) == [0, 1, 2] for r in rows)
    assert list(rows[0].textures) == [0, 0, 0] and list(rows[1].normals) == [0, 0, 0] and list(rows[2].textures) == [None] * 3


def test_labels_regions_and_symmetry(spark, tmp_path):
    assert [r.label for r in text.read_labels(spark, put(tmp_path, "a.seg", "3\n-1\n120\n")).orderBy("elem_idx").collect()] == [3, -1, 120]
    regions = text.read_regions(spark, put(tmp_path, "regions.txt", "seat pnts 1\nleg_a pnts 1\nleg_b pnts 1\n\nrest pnts 1\n"))
    assert {r.name: r.label for r in regions.collect()} == {"seat": 0, "leg_a": 1, "leg_b": 2}
    groups = text.read_symmetry(spark, put(tmp_path, "symmetry.txt", "seat\nleg_a leg_b\nwing\n"), regions).orderBy("group_idx").collect()
    assert [list(g.members) for g in groups] == [[0], [1, 2], [3]]
    with pytest.raises(Exception, match="region line"):
        text.read_regions(spark, put(tmp_path, "bad.txt", "seat 1\n")).collect()


def test_small_files(spark, tmp_path):
    v = text.read_feature_vertices(spark, put(tmp_path, "v.txt", "12, 0.5\n-1, no\n3, x y\n")).collect()
    assert [(r.v_idx, r.note) for r in v] == [(12, "0.5"), (3, "x y")]
    g = text.read_grouped_face_labels(spark, put(tmp_path, "g.txt", "7\n1 3\n8\n2\n")).collect()
    assert sorted((r.elem_idx, r.label) for r in g) == [(0, 7), (1, 8), (2, 7)]
    m = text.read_dmat(spark, put(tmp_path, "m.dmat", "2 3\n1\n2\n3\n4\n5\n6\n")).collect()
    assert {(r.i, r.j): r.v for r in m} == {(0, 0): 1, (1, 0): 2, (2, 0): 3, (0, 1): 4, (1, 1): 5, (2, 1): 6}
    v, e = text.read_graph(spark, put(tmp_path, "g.tgf", "1 0 0 0\n2 1 1 1\n#\n1 2\n"))
    assert v.count() == 2 and tuple(e.first())[1:] == (0, 1)
    f = text.read_features(spark, put(tmp_path, "f.csv", "0.5,1\n2,3\n"))
    assert [list(r.f) for r in f.orderBy("point_idx").collect()] == [[0.5, 1.0], [2.0, 3.0]]


def test_sinks(spark):
    p = spark.createDataFrame([("s", 0, 1.0, 2.0, 3.0)], "shape_id string, point_idx int, x double, y double, z double")
    assert sinks.pts_text(p).first().text == "0 0.333 0.333 0.333 1.0 2.0 3.0"
    assert sinks.off_text(p, index="point_idx").first().text == "OFF\n1 0 0\n1.0 2.0 3.0"
    assert "element vertex 1" in sinks.ply_text(p).first().text
    labels = spark.createDataFrame([("s", 0, 4), ("s", 1, None)], "shape_id string, elem_idx int, label int")
    assert sinks.labels_text(labels).first().text == "4\n-1"
    assert sinks.grouped_labels_text(labels.filter("label = 4")).first().text == "4\n1"


def test_paths(spark):
    t = spark.createDataFrame([("/d/mesh/a.b.off",)], "p string")
    r = t.select(text.path_parts(F.col("p")).alias("q"), text.label_path(F.col("p")).alias("l")).first()
    assert (r.q.dir, r.q.base, r.q.ext, r.q.name, r.l) == ("/d/mesh", "a.b.off", "off", "a.b", "/d/gt/a.b.seg")


def test_listings(spark, tmp_path):
    put(tmp_path, "list.txt", "a/b.off\n\n  c.off  \n")
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    put(tmp_path / "sub", "x.off", "12345")
    put(tmp_path / "sub" / "deep", "y.off", "1")
    assert [r.path for r in text.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a/b.off", "c.off"]
    assert text.list_files(spark, str(tmp_path)).count() == 1
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.name: (r.is_folder, r.files, r.bytes) for r in text.list_entries(spark, folder).collect()}
        assert got == {"list.txt": (False, 1, 19), "sub": (True, 2, 6)}
