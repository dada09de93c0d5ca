"""Labels of points and faces, probabilities of labels, and colours for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G

#: The hue step (golden ratio) and the first hue of label colours, one step of the congruence from its seed.
GOLDEN = 0.618033988749895
SEED = 20130923
FIRST_HUE = ((SEED * 69069 + 12345) % 2**32) / 2**32


def rebase(labels: DataFrame) -> DataFrame:
    return labels.withColumn("label", F.col("label") - 1)


def null_label(label: Column, n: int) -> Column:
    """Labels outside 0 to n - 1, and null, become n."""
    return F.when((label >= 0) & (label < n), label).otherwise(F.lit(n))


def symmetric(a: Column, b: Column, groups: list[list[int]]) -> Column:
    """Whether two labels are equal or stand in one group of at least two."""
    together = F.lit(False)
    for g in groups:
        if len(g) > 1:
            together = together | (a.isin(g) & b.isin(g))
    return (a == b) | together


def binary_target(label: Column, group: list[int], groups: list[list[int]]) -> Column:
    """1.0 for labels that are symmetric to a group's first one."""
    return symmetric(F.lit(group[0]), label, groups).cast("double")


def one_hot(label: Column, n: int = 8) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def label_counts(labels: DataFrame, k: int) -> DataFrame:
    """bucket, n: labels counted, those from k - 1 on together."""
    return labels.groupBy(F.least("label", F.lit(k - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def clamp(p: Column, least: float = 1e-6) -> Column:
    return F.when(p < least, F.lit(0.0)).otherwise(p)


def spread_groups(probs: DataFrame, groups: DataFrame) -> DataFrame:
    """A group's probability (shape_id, point_idx, group_idx, p) written to each of its labels."""
    return probs.join(F.broadcast(groups), "group_idx").select("shape_id", "point_idx", F.explode("members").alias("label"), "p")


def best_label(probs: DataFrame) -> DataFrame:
    """shape_id, point_idx, label of the largest probability, the smallest such label."""
    return probs.groupBy("shape_id", "point_idx").agg(F.max_by("label", F.struct("p", -F.col("label"))).alias("label"))


def accuracy(best: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hits, n (points with a true label) and their ratio."""
    met = truth.join(best.withColumnRenamed("label", "found"), ["shape_id", "point_idx"], "left")
    return met.agg(F.sum(F.coalesce((F.col("found") == F.col("label")).cast("int"), F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.try_divide(F.col("hits"), F.col("n")))


def wide(probs: DataFrame, labels: int) -> DataFrame:
    """A column p0 ... for each label and the null label (0 where there is none)."""
    return probs.groupBy("shape_id", "point_idx").agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("p"))), F.lit(0.0)).alias(f"p{k}") for k in range(labels + 1)))


# ---------------------------------------------------------------------------------------------- colours


def gray_rgb(v: Column) -> tuple[Column, Column, Column]:
    """0 to blue, 1 to red, over the hues between; outside values are cut off."""
    hue = F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))) * 240)
    return tuple(F.floor(c * 255).cast("int") for c in G.hsv_to_rgb(hue / 360.0, F.lit(1.0), F.lit(1.0)))


def scaled_colors(values: DataFrame) -> DataFrame:
    """shape_id, elem_idx, r, g, b: values between the shape's smallest and largest; equal ones count as 0."""
    ends = values.groupBy("shape_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return values.join(ends, "shape_id").select("shape_id", "elem_idx", *(c.alias(n) for c, n in zip(gray_rgb(v), "rgb", strict=True)))


def label_rgb(label: Column) -> tuple[Column, Column, Column]:
    """A hue per label, a golden step after the other."""
    hue = F.lit(FIRST_HUE) + F.abs(label) * GOLDEN
    return tuple(F.floor(c * 255).cast("int") for c in G.hsv_to_rgb(hue - F.floor(hue), F.lit(0.9), F.lit(0.9)))


def face_colors(faces: DataFrame, face_labels: DataFrame) -> DataFrame:
    """shape_id, f_idx, r, g, b: the colour of each face's label, white where it has none."""
    met = faces.join(face_labels.select("shape_id", F.col("elem_idx").alias("f_idx"), "label"), ["shape_id", "f_idx"], "left")
    return met.select("shape_id", "f_idx", *(F.when(F.col("label").isNull(), F.lit(255)).otherwise(c).alias(n) for c, n in zip(label_rgb(F.col("label")), "rgb", strict=True)))


def near_zero(values: DataFrame, share: float = 0.01) -> DataFrame:
    """Values whose magnitude is below a share of the shape's largest."""
    top = values.groupBy("shape_id").agg(F.max(F.abs("value")).alias("top"))
    return values.join(top, "shape_id").filter(F.abs("value") < share * F.col("top")).drop("top")


# ---------------------------------------------------------------------------------------------- faces and vertices


def _corners(faces: DataFrame) -> DataFrame:
    return faces.select("*", F.explode(F.array("v0", "v1", "v2")).alias("v_idx"))


def vertex_areas(areas: DataFrame) -> DataFrame:
    """shape_id, v_idx, area: mean area of the faces at a vertex."""
    return _corners(areas).groupBy("shape_id", "v_idx").agg(F.avg("area").alias("area"))


def faces_by_label(face_labels: DataFrame) -> DataFrame:
    """shape_id, label, faces (sorted), rank (from 0, in the order in which labels first occur)."""
    from pyspark.sql import Window as W

    sets = face_labels.groupBy("shape_id", "label").agg(F.sort_array(F.collect_list("elem_idx")).alias("faces"))
    return sets.withColumn("rank", (F.row_number().over(W.partitionBy("shape_id").orderBy(F.get("faces", F.lit(0)))) - 1).cast("int"))


def vertex_labels(faces: DataFrame, face_labels: DataFrame) -> DataFrame:
    """shape_id, v_idx, label of the last face at a vertex."""
    met = faces.join(face_labels.withColumnRenamed("elem_idx", "f_idx"), ["shape_id", "f_idx"])
    return _corners(met).groupBy("shape_id", "v_idx").agg(F.max_by("label", "f_idx").alias("label"))
