"""Contiguous shards of near-equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Only DataFrame functions. Rows are dealt to ranges of (doc_id, size, text crc32) whose bounds are approximate quantiles of
the key, so a range's rows are bounded by the number of ranges, not by how keys are spread; each range sums its own rows in
order, and the few totals, summed in one small task, lift these sums to global ones. A row belongs to the shard whose target
interval holds its first byte.

Law `bytes`: a shard's bytes differ from the mean by less than one row's size at either end. Equal texts are rows like any
other. Cases: a null text has size 1 and crc32 0; null doc_ids come first; rows equal in all three columns are numbered, so
that they spread over ranges like all others; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written


def byte_shards(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: no such law here) of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # written once: range bounds, totals and rows below must come from one and the same deal
    key = ["doc_id", "size", "text_crc32", "row"]  # the last one tells rows apart that are equal in all others
    dealt = written(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "dealt")
    order = W.partitionBy("part").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("b", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("r", F.coalesce(F.count(F.lit(1)).over(order), F.lit(0)))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(  # a row per range: as many as there are shuffle partitions
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    at = local.join(F.broadcast(totals), "part").withColumn("first", F.col("b") + F.col("bytes_before")).withColumn("at", F.col("r") + F.col("rows_before"))
    at = at.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(first * {shards}) div all_bytes")).cast("int"))
    heads = at.groupBy("shard").agg(F.min("at").alias("head"))  # at most `shards` rows
    return at.join(F.broadcast(heads), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("head")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

