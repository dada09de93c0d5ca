"""One-vs-rest random forests: one per symmetry group, trained and applied with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .labels import accuracy, best_label, binary_target, clamp, null_label

KEY = ["shape_id", "point_idx"]


def training_set(features: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """Features (shape_id, point_idx, f) with their labels (shape_id, elem_idx, label); unknown labels are the null label."""
    known = labels.select("shape_id", F.col("elem_idx").alias("point_idx"), null_label(F.col("label"), n_labels).alias("label"))
    return features.join(known, KEY)


def mismatched(features: DataFrame, labels: DataFrame) -> DataFrame:
    """shape_id, features, labels of shapes whose numbers differ."""
    a = features.groupBy("shape_id").agg(F.count(F.lit(1)).alias("features"))
    b = labels.groupBy("shape_id").agg(F.count(F.lit(1)).alias("labels"))
    zero = {"features": 0, "labels": 0}
    return a.join(b, "shape_id", "full").fillna(zero).filter("features <> labels")


def train(rows: DataFrame, groups: list[list[int]], *, trees: int = 100, depth: int = 12, seed: int = 1) -> list[RandomForestClassificationModel]:
    """A forest for each group: labels symmetric to its first one against all others."""
    vectors = rows.select(array_to_vector("f").alias("features"), "label").persist()
    try:
        out = []
        for g in groups:
            forest = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=1, seed=seed)
            out.append(forest.fit(vectors.withColumn("target", binary_target(F.col("label"), g, groups))))
        return out
    finally:
        vectors.unpersist()


def save(models: list[RandomForestClassificationModel], groups: list[list[int]], folder: str, category: str) -> None:
    for m, g in zip(models, groups, strict=True):
        m.write().overwrite().save(f"{folder}/{category}_{g[0]}")


def load(groups: list[list[int]], folder: str, category: str) -> list[RandomForestClassificationModel]:
    return [RandomForestClassificationModel.load(f"{folder}/{category}_{g[0]}") for g in groups]


def predict(features: DataFrame, models: list[RandomForestClassificationModel], groups: list[list[int]], n_labels: int, *, least: float | None = 1e-6) -> DataFrame:
    """shape_id, point_idx, label, p: each group's probability for all of its labels; 0 for labels of no group and the null label."""
    rows = features.withColumn("features", array_to_vector("f"))
    names = []
    for k, m in enumerate(models):
        out = m.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_v{k}")
        p = F.get(vector_to_array(f"_v{k}"), F.lit(1))
        rows = out.transform(rows).withColumn(f"_p{k}", F.coalesce(p, F.lit(0.0)) if least is None else clamp(F.coalesce(p, F.lit(0.0)), least)).drop(f"_v{k}")
        names.append(f"_p{k}")
    of = {label: names[k] for k, g in enumerate(groups) for label in g}
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), (F.col(of[k]) if k in of else F.lit(0.0)).alias("p")) for k in range(n_labels + 1)])
    return rows.select(*KEY, F.explode(pairs).alias("e")).select(*KEY, "e.label", "e.p")


def evaluate(probs: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """hits, n and accuracy of the best labels; points of the null label always miss unless nothing has a probability."""
    truth = labels.select("shape_id", F.col("elem_idx").alias("point_idx"), null_label(F.col("label"), n_labels).alias("label"))
    return accuracy(best_label(probs), truth)
