"""Text sinks: one row of whole text per shape, written below shape_id=... by Spark's own writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _joined(rows: DataFrame, index: str, line: Column) -> DataFrame:
    """shape_id, n, body: the lines of each shape in index order."""
    g = rows.select("shape_id", F.struct(F.col(index).alias("k"), line.alias("s")).alias("r")).groupBy("shape_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return g.select("shape_id", F.size("r").alias("n"), F.array_join(F.col("r.s"), "\n").alias("body"))


def _numbers(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def off_text(vertices: DataFrame, faces: DataFrame | None = None, *, index: str = "v_idx") -> DataFrame:
    """shape_id, text: .off of points only, or of a mesh."""
    v = _joined(vertices, index, _numbers("x", "y", "z"))
    if faces is None:
        return v.select("shape_id", F.concat(F.lit("OFF\n"), F.col("n"), F.lit(" 0 0\n"), F.col("body")).alias("text"))
    f = _joined(faces, "f_idx", F.concat(F.lit("3 "), _numbers("v0", "v1", "v2"))).toDF("shape_id", "nf", "faces")
    m = v.join(f, "shape_id", "left")
    return m.select("shape_id", F.concat(F.lit("OFF\n"), F.col("n"), F.lit(" "), F.coalesce("nf", F.lit(0)), F.lit(" 0\n"), F.concat_ws("\n", "body", "faces")).alias("text"))


def obj_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    v = _joined(vertices, "v_idx", F.concat(F.lit("v "), _numbers("x", "y", "z"))).select("shape_id", F.col("body").alias("v"))
    f = _joined(faces, "f_idx", F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")])).select("shape_id", F.col("body").alias("f"))
    return v.join(f, "shape_id", "left").select("shape_id", F.concat_ws("\n", "v", "f").alias("text"))


def ply_text(points: DataFrame, *, index: str = "point_idx") -> DataFrame:
    v = _joined(points, index, _numbers("x", "y", "z"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n"), F.lit("\nproperty float x\nproperty float y\nproperty float z\nend_header\n"))
    return v.select("shape_id", F.concat(head, F.col("body")).alias("text"))


def pts_text(points: DataFrame) -> DataFrame:
    """.pts with face and centroid; without them, face 0 and equal weights."""
    have = "face_idx" in points.columns
    face = F.coalesce(F.col("face_idx"), F.lit(0)).cast("string") if have else F.lit("0")
    b = [F.coalesce(F.col(c), F.lit(0.333)).cast("string") if have else F.lit("0.333") for c in ("bx", "by", "bz")]
    return _joined(points, "point_idx", F.concat_ws(" ", face, *b, _numbers("x", "y", "z"))).select("shape_id", F.col("body").alias("text"))


def labels_text(labels: DataFrame) -> DataFrame:
    """.seg; a missing label is -1."""
    return _joined(labels, "elem_idx", F.coalesce(F.col("label"), F.lit(-1)).cast("string")).select("shape_id", F.col("body").alias("text"))


def grouped_labels_text(face_labels: DataFrame) -> DataFrame:
    """Label lines and the faces (from 1) that have it, labels in order."""
    g = face_labels.groupBy("shape_id", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("elem_idx")), lambda x: (x + 1).cast("string")), " ").alias("faces"))
    return _joined(g, "label", F.concat(F.col("label").cast("string"), F.lit("\n"), F.col("faces"))).select("shape_id", F.col("body").alias("text"))


def features_text(features: DataFrame, *, digits: int | None = None) -> DataFrame:
    """Comma-separated rows; `digits`: significant ones, else all."""
    one = (lambda x: F.format_string(f"%.{digits}g", x)) if digits else (lambda x: x.cast("string"))
    return _joined(features, "point_idx", F.array_join(F.transform("f", one), ",")).select("shape_id", F.col("body").alias("text"))


def dataset_text(features: DataFrame) -> DataFrame:
    """Feature rows with the label as last value."""
    line = F.concat_ws(",", F.array_join(F.transform("f", lambda x: x.cast("string")), ","), F.col("label").cast("string"))
    return _joined(features, "point_idx", line).select("shape_id", F.col("body").alias("text"))


def probabilities_text(wide: DataFrame) -> DataFrame:
    columns = [c for c in wide.columns if c not in ("shape_id", "point_idx")]
    return _joined(wide, "point_idx", F.concat_ws(",", *[F.col(c).cast("string") for c in columns])).select("shape_id", F.col("body").alias("text"))


def values_text(values: DataFrame) -> DataFrame:
    return _joined(values, "elem_idx", F.col("value").cast("string")).select("shape_id", F.col("body").alias("text"))


def feature_vertices_text(rows: DataFrame) -> DataFrame:
    return _joined(rows, "v_idx", F.concat_ws(", ", F.col("v_idx").cast("string"), "note")).select("shape_id", F.col("body").alias("text"))


def graph_text(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    v = _joined(vertices, "v_idx", F.concat_ws(" ", (F.col("v_idx") + 1).cast("string"), _numbers("x", "y", "z"))).select("shape_id", F.col("body").alias("v"))
    e = _joined(edges.withColumn("k", F.struct("i", "j")), "k", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"))).select("shape_id", F.col("body").alias("e"))
    return v.join(e, "shape_id", "left").select("shape_id", F.concat_ws("\n", "v", F.lit("#"), "e").alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder shape_id=... for each shape."""
    texts.write.partitionBy("shape_id").text(path)


def write_list(paths: DataFrame, path: str) -> None:
    paths.select("path").distinct().write.text(path)
