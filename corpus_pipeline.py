"""From raw documents to packed training bins: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage works on all that its predecessor kept and returns the columns of `documents` (the last one: bins). Documents are
told apart by doc_id and a hash of the text, so a stage's decision about one row touches no other row that repeats its doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm import cgk_decontam, conflict_packing, phrase_automata, ppm_lang, setsketch
from pointloom.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are null or have no letter go; the language found rejects none, but is written where `lang` is null."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = ppm_lang.identify(docs, passing=COLUMNS).filter((F.col("lang_pred") != "und") | lettered)
    return found.withColumn("lang", F.coalesce("lang", F.nullif(F.col("lang_pred"), F.lit("und")))).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows named by doc_id and text_hash."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more) stays, the one with the smallest doc_id; rows that repeat it go too."""
    found = written(setsketch.near_duplicates(docs, percent=80), "near")
    rest = _without(docs.select(*COLUMNS), found.filter("not kept"))
    twice = written(found.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1"), "twice")
    if twice.isEmpty():
        return rest
    again = F.col("doc_id").cast("long").eqNullSafe(F.col("twice_id")) & (F.xxhash64("text") == F.col("twice_hash"))
    named = twice.select(F.col("doc_id").alias("twice_id"), F.col("text_hash").alias("twice_hash"))
    return rest.join(named, again, "left_anti").union(rest.join(named, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words that stand earlier go; a document that loses all its words goes."""
    out = phrase_automata.remove_repeats(docs, span=20, passing=("lang", "source", "n_chars"), clean_as_is=True).filter("kept_text <> ''")
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, at most a fifth of its words edited, go."""
    found = cgk_decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)
    return _without(docs.select(*COLUMNS), written(found, "leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return conflict_packing.pack(docs, capacity=8192)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: None of the stages but the last parts of some can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
