"""Binary sources against the text sources of the same meshes, and tetrahedral meshes."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import tets
from pointloom.sources import binary, text

POINTS = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.25, -2.0)]
FACES = [(0, 1, 2), (0, 3, 1), (2, 1, 4)]


def test_binary_stl(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE", 2)
    records = b"".join(struct.pack("<12fH", 0, 0, 1, *(c for v in f for c in POINTS[v]), 0) for f in FACES)
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.stl").write_bytes(b"solid? no".ljust(80, b" ") + struct.pack("<I", 3) + records)
    (tmp_path / "bin" / "none.stl").write_bytes(bytes(80) + struct.pack("<I", 0))
    body = "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in (POINTS[v] for v in f)) + "endloop\nendfacet\n" for f in FACES)
    (tmp_path / "a.stl").write_text(f"solid a\n{body}endsolid a\n")
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(binary.read_stl(spark, str(tmp_path / "bin"))) == same(text.read_stl(spark, str(tmp_path / "a.stl")))
    (tmp_path / "short.stl").write_bytes(bytes(80) + struct.pack("<I", 9) + records)
    with pytest.raises(Exception, match="ends early"):
        binary.read_stl(spark, str(tmp_path / "short.stl")).collect()


@pytest.mark.parametrize("order", ("<", ">"))
@pytest.mark.parametrize("polygons", (FACES, [*FACES, (0, 1, 2, 3), (4, 3)]))
def test_binary_ply(spark, tmp_path, order, polygons):
    name = {"<": "binary_little_endian", ">": "binary_big_endian"}[order]
    head = lambda kind: f"ply\nformat {kind} 1.0\ncomment x\nelement vertex 5\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nelement face {len(polygons)}\nproperty list uchar int vertex_indices\nproperty float area\nend_header\n"
    body = b"".join(struct.pack(order + "3dB", *p, 7) for p in POINTS) + b"".join(struct.pack(f"{order}B{len(f)}if", len(f), *f, 0.5) for f in polygons)
    (tmp_path / "m.ply").write_bytes(head(name).encode() + body)
    (tmp_path / "t").mkdir()
    lines = [" ".join(map(str, (*p, 7))) for p in POINTS] + [" ".join(map(str, (len(f), *f, 0.5))) for f in polygons]
    (tmp_path / "t" / "m.ply").write_text(head("ascii") + "\n".join(lines) + "\n")
    for got, want in zip(binary.read_ply(spark, str(tmp_path / "m.ply")), text.read_ply(spark, str(tmp_path / "t"))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_binary_dmat(spark, tmp_path):
    m = np.arange(12.0).reshape(3, 4) / 7
    (tmp_path / "m.dmat").write_bytes(b"0 0\n4 3\n" + m.T.tobytes())
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "m.dmat").write_text("4 3\n" + "\n".join(repr(float(x)) for x in m.T.ravel()))
    assert sorted(map(tuple, binary.read_dmat(spark, str(tmp_path / "m.dmat")).collect())) == sorted(map(tuple, text.read_dmat(spark, str(tmp_path / "t")).collect()))


def test_tets_from_a_file(spark, tmp_path):
    (tmp_path / "c.mesh").write_text("MeshVersionFormatted 1\nDimension 3\nVertices\n5\n0 0 0 1\n1 0 0 1\n0 1 0 1\n0 0 1 1\n1 1 1 1\nTriangles\n1\n1 2 3 9\nTetrahedra\n2\n1 2 3 4 0\n2 3 4 5 0\nEnd\n")
    v, f, t = text.read_tets(spark, str(tmp_path))
    assert v.count() == 5 and [tuple(r)[1:] for r in f.collect()] == [(0, 0, 1, 2)] and sorted(tuple(r)[1:] for r in t.collect()) == [(0, 0, 1, 2, 3), (1, 1, 2, 3, 4)]
    assert [r.volume for r in tets.volumes(t, v).orderBy("t_idx").collect()] == pytest.approx([1 / 6, 1 / 3])
    assert [tuple(r)[1:] for r in tets.on_boundary(t).orderBy("t_idx").collect()] == [(0, True, False, True, True, True), (1, True, True, True, True, False)]
    border = [(r.a, r.b, r.c) for r in tets.boundary(t).collect()]
    assert len(border) == 6 and all(sum((a, b) in ((x, y), (y, z), (z, x)) for x, y, z in border) == 1 for x, y, z in border for a, b in ((x, y), (y, z), (z, x)))
    angles = {(r.t_idx, r.k): r.theta for r in tets.dihedral_angles(t, v).collect()}
    assert len(angles) == 12
    right = [k for k, (i, j) in enumerate(tets.EDGES) if 0 in (i, j)]
    assert all(angles[0, k] == pytest.approx(math.pi / 2 if k in right else math.acos(1 / math.sqrt(3))) for k in range(6))
    assert tets.volumes(t.withColumn("v3", F.lit(99)), v).count() == 0
