"""Binary sources of meshes and matrices: what the text sources give, from the binary forms of the same formats.

A file is read as bytes by Spark, so any store that Spark reads will do. Files of equal records are cut into ranges of records
before they reach Python, where NumPy decodes a range at once; files with records of their own length are decoded one by one. A
file that ends early is an error. As every binary column, a file holds less than 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import stem

#: Records that are decoded at once.
RANGE = 1 << 16
#: The names of number types in headers, as NumPy's.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("shape_id"), "content", "length")


def _mapped(rows: DataFrame, decode, schema: str) -> DataFrame:
    """decode(row) gives a table of the columns of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from decode({c: b[c][k].as_py() for c in b.schema.names}).to_batches()

    return rows.mapInArrow(run, schema)


def _table(shape: str, **columns: tuple[np.ndarray, pa.DataType]) -> pa.Table:
    n = len(next(iter(columns.values()))[0])
    return pa.table({"shape_id": pa.array([shape] * n, pa.string()), **{c: pa.array(v, t) for c, (v, t) in columns.items()}})


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, f_idx, corner, x, y, z of binary .stl files: 80 bytes, the number of faces, and 50 bytes for each."""
    byte = lambda k: F.conv(F.hex(F.substring("content", 81 + k, 1)), 16, 10).cast("long") * (1 << 8 * k)
    rows = _files(spark, path).withColumn("n", byte(0) + byte(1) + byte(2) + byte(3))
    whole = F.assert_true(F.col("length") >= 84 + 50 * F.col("n"), F.lit("a binary .stl file ends early")).isNull()
    rows = rows.filter(whole).filter("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))))
    part = F.expr(f"substring(content, cast(85 + 50 * first as int), cast(50 * least({RANGE}, n - first) as int))")
    kind = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])

    def decode(r: dict) -> pa.Table:
        p = np.frombuffer(r["part"], kind)["p"].reshape(-1, 3)
        at = np.arange(len(p))
        return _table(r["shape_id"], f_idx=((r["first"] + at // 3).astype(np.int32), pa.int32()), corner=((at % 3).astype(np.int32), pa.int32()), **{c: (p[:, k].astype(float), pa.float64()) for k, c in enumerate("xyz")})

    return _mapped(rows.select("shape_id", "first", part.alias("part")), decode, "shape_id string, f_idx int, corner int, x double, y double, z double")


def read_dmat(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, i, j, v of binary .dmat files: an empty matrix's header, the columns and rows, and doubles by columns."""

    def decode(r: dict) -> pa.Table:
        first, second, body = r["content"].split(b"\n", 2)
        columns, rows = map(int, second.split())
        if [int(x) for x in first.split()] != [0, 0] or len(body) < 8 * rows * columns:
            raise ValueError("not a binary .dmat file, or it ends early")
        v = np.frombuffer(body, "<f8", rows * columns)
        at = np.arange(len(v))
        return _table(r["shape_id"], i=((at % max(1, rows)).astype(np.int32), pa.int32()), j=((at // max(1, rows)).astype(np.int32), pa.int32()), v=(v, pa.float64()))

    return _mapped(_files(spark, path).drop("length"), decode, "shape_id string, i int, j int, v double")


def _header(content: bytes) -> tuple[str, list[tuple[str, int, list[list[str]]]], int]:
    """Byte order, the elements (name, number, properties as words) and the length of a .ply header."""
    end = content.index(b"end_header")
    size = content.index(b"\n", end) + 1
    order, elements = "", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}[words[1]]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    return order, elements, size


def _elements(content: bytes) -> dict[str, np.ndarray | list[list[int]]]:
    """Of each element its records, or, where it has a list, its records' lists (the last one's, if it has several)."""
    order, elements, at = _header(content)
    out: dict[str, np.ndarray | list[list[int]]] = {}
    for name, n, properties in elements:
        plain = lambda w: order + TYPES[w]  # noqa: B023, E731
        if not any(p[0] == "list" for p in properties):
            kind = np.dtype([(p[1], plain(p[0])) for p in properties])
            out[name] = np.frombuffer(content, kind, n, at)
            at += n * kind.itemsize
            continue
        # records of triangles alone are equal records
        kind = np.dtype([x for p in properties for x in ([(p[3] + "#", plain(p[1])), (p[3], plain(p[2]), 3)] if p[0] == "list" else [(p[1], plain(p[0]))])])
        if at + n * kind.itemsize <= len(content):
            records = np.frombuffer(content, kind, n, at)
            if all((records[p[3] + "#"] == 3).all() for p in properties if p[0] == "list"):
                out[name] = records[[p[3] for p in properties if p[0] == "list"][-1]].tolist()
                at += n * kind.itemsize
                continue
        lists = []
        for _ in range(n):
            for p in properties:
                if p[0] == "list":
                    count = int(np.frombuffer(content, plain(p[1]), 1, at)[0])
                    at += np.dtype(plain(p[1])).itemsize
                    own = np.frombuffer(content, plain(p[2]), count, at).tolist()
                    at += count * np.dtype(plain(p[2])).itemsize
                else:
                    at += np.dtype(plain(p[0])).itemsize
            lists.append(own)
        out[name] = lists
    return out


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and polygons of binary .ply files of either byte order, other elements and properties skipped."""

    def vertices(r: dict) -> pa.Table:
        v = _elements(r["content"]).get("vertex", np.zeros(0, [(c, "f8") for c in "xyz"]))
        return _table(r["shape_id"], v_idx=(np.arange(len(v), dtype=np.int32), pa.int32()), **{c: (v[c].astype(float), pa.float64()) for c in "xyz"})

    def polygons(r: dict) -> pa.Table:
        f = _elements(r["content"]).get("face", [])
        return _table(r["shape_id"], f_idx=(np.arange(len(f), dtype=np.int32), pa.int32()), corners=(f, pa.list_(pa.int32())))

    rows = _files(spark, path).drop("length")
    return _mapped(rows, vertices, "shape_id string, v_idx int, x double, y double, z double"), _mapped(rows, polygons, "shape_id string, f_idx int, corners array<int>")
