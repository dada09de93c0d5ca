"""Matrix-style operators on tables: a vector is a column with an index, a matrix is rows with an index or (i, j, v) triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..shared import written


def before(rows: DataFrame, keys: list[str | Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows that come before in the order of keys (unique): sums within ranges of the keys, and
    the ranges' totals, a row each, before them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that both readers below see the same ranges
    dealt = written(rows.withColumn("_value", value).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_part").agg(F.sum("_value").alias("_value")).select("_part", upto(W.orderBy("_part")).alias("_before"))
    own = dealt.withColumn("_own", upto(W.partitionBy("_part").orderBy(*keys)))
    return own.join(F.broadcast(totals), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before", "_value")


def places(rows: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """Adds the place (from 0) of a row in the order of keys (unique): as `before` with ones, but from the places in the sorted ranges as they
    are written (the lower 33 bits of `monotonically_increasing_id`; the others are the range), without another exchange."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    upto = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", upto.alias("_before"))
    return dealt.join(F.broadcast(totals), "_part").withColumn(name, F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before")).drop("_part", "_at", "_before")


def unique(table: DataFrame, columns: list[str], index: str) -> DataFrame:
    """Distinct rows of `columns` with first (the smallest index that holds them), times, and place (from 0, in sorted order)."""
    rows = table.groupBy(*columns).agg(F.min(index).alias("first"), F.count(F.lit(1)).alias("times"))
    return before(rows, list(columns), F.lit(1), "place").withColumn("place", F.col("place").cast("int"))


def unique_places(table: DataFrame, columns: list[str], index: str) -> DataFrame:
    """index and place of its row among the distinct ones."""
    return table.join(unique(table, columns, index).drop("first", "times"), columns).select(index, "place")


def sort_rows(table: DataFrame, keys: list[Column], index: str, *, by: list[str] | None = None) -> DataFrame:
    """Adds rank (from 0) in the order of keys within groups; ties go by index."""
    if not by:
        return before(table, [*keys, index], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int"))
    return table.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*keys, index)) - 1)


def running_sum(table: DataFrame, value: str, index: str, by: list[str]) -> DataFrame:
    return table.withColumn("running", F.sum(value).over(W.partitionBy(*by).orderBy(index).rowsBetween(W.unboundedPreceding, W.currentRow)))


def histc(table: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n: values of [edge k, edge k + 1); the last edge has a bin of its own; -1 holds the rest."""
    x = F.col(value)
    place = F.lit(-1)
    for k, e in enumerate(edges):
        place = F.when(x >= e, F.lit(k)).otherwise(place)
    place = F.when(x > edges[-1], F.lit(-1)).otherwise(place)
    return table.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def medians(table: DataFrame, value: str, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.median(value).alias("median"))


def modes(table: DataFrame, value: str, index: str, by: list[str]) -> DataFrame:
    """The most frequent value of each group, at a tie the one that comes first."""
    counts = table.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("at"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias("mode"), F.max("n").alias("times"))


def maxima(table: DataFrame, value: str, index: str, by: list[str]) -> DataFrame:
    """Largest and smallest value of each group and where each comes first."""
    return table.groupBy(*by).agg(F.max(value).alias("hi"), F.max_by(index, F.struct(value, -F.col(index))).alias("hi_at"), F.min(value).alias("lo"), F.min_by(index, F.struct(value, index)).alias("lo_at"))


def setdiff(a: DataFrame, b: DataFrame, column: str, index: str) -> DataFrame:
    """Distinct values of a that b lacks, and where they come first in a."""
    return a.join(b.select(column).distinct(), column, "left_anti").groupBy(column).agg(F.min(index).alias("first"))


def intersect_bag(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value, n: common values as often as the product of their counts, counted rather than listed."""
    n = lambda t, c: t.groupBy(column).agg(F.count(F.lit(1)).alias(c))
    return n(a, "na").join(n(b, "nb"), column).select(column, (F.col("na") * F.col("nb")).alias("n"))


def find_nonzero(table: DataFrame, array: str, index: str) -> DataFrame:
    """i, j, v of the non-zero elements of an array column."""
    return table.select(F.col(index).alias("i"), F.posexplode(array).alias("j", "v")).filter(F.col("v") != 0)


def slice_array(array: Column, places: list[int]) -> Column:
    """Elements at the places (from 0), repeats allowed; null outside."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda i: F.get(array, i))


def slice_rows(table: DataFrame, places: DataFrame, index: str) -> DataFrame:
    """Rows at places (new, old): each new index with the row of its old one."""
    return places.join(table, places["old"] == table[index]).drop("old", index)


def slice_into(target: DataFrame, source: DataFrame, index: str, value: str) -> DataFrame:
    """target with the values that source has for the same index."""
    return target.join(source.select(index, F.col(value).alias("_new")), index, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def repeat_rows(table: DataFrame, times: int) -> DataFrame:
    return table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def permutation(table: DataFrame, index: str, by: list[str], *, seed: int = 0) -> DataFrame:
    """Adds place: a permutation of each group's rows that index and seed decide."""
    key = ((F.col(index).cast("long") * 48_271 + seed) % 2_147_483_647 * 48_271) % 2_147_483_647
    return table.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(key, index)) - 1)


def row_normalize(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their sum in each row; null where it is 0."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return table.withColumns({c: F.try_divide(F.col(c), total) for c in columns})


def sparse(triplets: DataFrame) -> DataFrame:
    """i, j, v with equal places summed."""
    return triplets.groupBy("i", "j").agg(F.sum("v").alias("v"))


def compressed_columns(triplets: DataFrame) -> DataFrame:
    """j, rows, values and start (elements before the column): compressed storage by columns."""
    c = sparse(triplets).groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e"))
    return before(c, ["j"], F.size("e"), "start").select("j", F.col("e.i").alias("rows"), F.col("e.v").alias("values"), "start")


def diagonal(triplets: DataFrame, *, inverse: bool = False) -> DataFrame:
    """i, v of the diagonal, or of its reciprocals."""
    d = sparse(triplets).filter("i = j")
    return d.select("i", (F.try_divide(F.lit(1.0), F.col("v")) if inverse else F.col("v")).alias("v"))


def is_symmetric(triplets: DataFrame) -> DataFrame:
    """One row: whether the matrix equals its transpose, and whether it is diagonal."""
    a = sparse(triplets).filter("v <> 0")
    b = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    met = a.join(b, ["i", "j"], "full")
    return met.agg(F.coalesce(F.bool_and(F.coalesce(F.col("v") == F.col("w"), F.lit(False))), F.lit(True)).alias("symmetric"), F.coalesce(F.bool_and((F.col("i") == F.col("j"))), F.lit(True)).alias("diagonal"))


def sums(triplets: DataFrame, dim: str) -> DataFrame:
    """Sums of a matrix over the other dimension: `dim` is the one that stays."""
    return triplets.groupBy(dim).agg(F.sum("v").alias("v"))


def group_sums(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return table.groupBy(by).agg(*(F.sum(c).alias(c) for c in columns))


def list_shape(table: DataFrame, array: str) -> DataFrame:
    """One row: smallest and largest size of the lists, and whether they make a matrix."""
    return table.agg(F.min(F.size(array)).alias("min_size"), F.max(F.size(array)).alias("max_size")).withColumn("rectangular", F.col("min_size") == F.col("max_size"))


def combinations(table: DataFrame, column: str, k: int, *, most: int = 1000) -> DataFrame:
    """All ascending k-tuples of a column's distinct values, as columns c0, c1, ...; over `most` values are an error."""
    values = table.select(column).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"{column} has over {most} distinct values")
    values = F.broadcast(values)
    out = values.select(F.col(column).alias("c0"))
    for n in range(1, k):
        nxt = values.select(F.col(column).alias(f"c{n}"))
        out = out.join(nxt, F.col(f"c{n}") > F.col(f"c{n - 1}"))
    return out


def fill_forward(table: DataFrame, value: str, index: str, by: list[str]) -> DataFrame:
    """Null values become the previous known one in index order, leading ones the next."""
    w = W.partitionBy(*by).orderBy(index)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    return table.withColumn(value, F.coalesce(back, ahead))


def triangles_from_strip(table: DataFrame, vertex: str, index: str, by: list[str]) -> DataFrame:
    """Adds v1, v2: each vertex with its next two; the last two of a group make no triangle."""
    w = W.partitionBy(*by).orderBy(index)
    return table.withColumns({"v1": F.lead(vertex, 1).over(w), "v2": F.lead(vertex, 2).over(w)}).filter(F.col("v2").isNotNull())
