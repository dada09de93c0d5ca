"""Whole jobs over folders of shapes: sampling of meshes, features and classification. Each job handles all shapes together; what
several steps read is written to the shared folder once, so that no step plans or computes it anew."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import features, labels as lab, learning, normalize, parts, sampling
from ..shared import written
from ..sources import sinks, text


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices, scaled to the mesh's unit sphere and set on z = 0, and triangles of .off files."""
    vertices = text.read_off_vertices(spark, path).select("shape_id", "v_idx", "x", "y", "z")
    return written(normalize.normalize_mesh(vertices), "vertices"), written(text.triangles(text.read_off_polygons(spark, path)), "faces")


def sample_meshes(spark: SparkSession, meshes: str, out: str, n: int, *, n_dense: int = 0, labels: str | None = None, seed: int = 0) -> DataFrame:
    """Samples each mesh: out/pts, with n_dense out/dense, with labels of faces out/seg, and the meshes as sampled in out/off.

    Returns the samples, with their labels where there are any.
    """
    vertices, faces = load_mesh(spark, meshes)
    samples = written(sampling.sample_points(faces, vertices, n, seed=seed), "samples")
    sinks.write_texts(sinks.pts_text(samples), f"{out}/pts")
    sinks.write_texts(sinks.off_text(vertices, faces), f"{out}/off")
    dense = sampling.dense_sample(samples, faces, vertices, n, n_dense)
    if dense is not None:
        sinks.write_texts(sinks.pts_text(dense), f"{out}/dense")
    if labels is None:
        return samples
    labelled = sampling.transfer_labels(samples, text.read_face_labels(spark, labels))
    sinks.write_texts(sinks.labels_text(labelled.withColumnRenamed("point_idx", "elem_idx").select("shape_id", "elem_idx", "label")), f"{out}/seg")
    return labelled


def _features(points: DataFrame) -> DataFrame:
    cloud = written(normalize.normalize_points(points.select("shape_id", "point_idx", "x", "y", "z")), "points")
    return written(features.features36(cloud), "features")


def train_forests(points: DataFrame, groups: list[list[int]], n_labels: int, **how) -> list[RandomForestClassificationModel]:
    """One forest for each group from labelled points (shape_id, point_idx, label, x, y, z)."""
    known = points.selectExpr("shape_id", "point_idx as elem_idx", "label")
    return learning.train(learning.training_set(_features(points), known, n_labels), groups, **how)


def classify(points: DataFrame, models: list[RandomForestClassificationModel], groups: list[list[int]], n_labels: int, out: str) -> DataFrame:
    """Probabilities of all points, written by shape to out/probabilities (Parquet) and out/labels (text); returns the best labels."""
    probs = learning.predict(_features(points), models, groups, n_labels)
    probs.repartition("shape_id").write.partitionBy("shape_id").parquet(f"{out}/probabilities")
    kept = points.sparkSession.read.schema(probs.schema).parquet(f"{out}/probabilities")
    best = lab.best_label(kept)
    sinks.write_texts(sinks.labels_text(best.withColumnRenamed("point_idx", "elem_idx")), f"{out}/labels")
    return best


def split_shapes(points: DataFrame, groups: DataFrame, directions, out: str, *, mode: str = "force_match") -> tuple[DataFrame, DataFrame]:
    """New labels of all shapes, written to out, and the shapes whose parts do not fit their groups. Labels of no group are an error."""
    points = written(parts.checked(points, groups.count()), "points")
    split = parts.split_parts(points, groups, directions)
    sinks.write_texts(sinks.labels_text(split.selectExpr("shape_id", "point_idx as elem_idx", "new_label as label")), f"{out}/seg")
    several = points.join(groups.filter("size(members) > 1").selectExpr("group_idx as label"), "label", "left_semi")
    return split, parts.wrong_shapes(points, parts.part_components(several, parts.SMALL), groups, mode)
