"""A corpus from documents to packed sequences: quality, repeated lines, near copies, benchmark leaks, packing.

Each stage takes what the one before it kept, with the columns of `documents`, and its decisions take effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontam, line_dedup, ngram_join, packing, quality
from assayer.llm.ship import ship
from assayer.llm.storage import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in five documents or more, but for the largest; a text may become empty."""
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, Scratch(spark, "line-dedup")))
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first of the smallest id, of each group of near copies and of repeated rows; rows without an id are members too.

    Rows are told apart by a number written with them. Texts without words are no copies of each other, but repeat by id.
    """
    scratch = Scratch(spark, "ngram-join")
    numbered = scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    classes = ngram_join.jaccard_components(numbered, scratch, doc_id="__row").select(F.col("doc_id").alias("__row"), "n_shingles", "component_id")
    by_id = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    members = numbered.select("__row", "doc_id").join(classes, "__row")
    groups = members.groupBy(by_id.alias("by_id"), F.when(by_id, F.col("doc_id")).otherwise(F.col("component_id")).alias("g"))
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("m")).select(F.col("m.__row").alias("__row"))
    return numbered.join(first, "__row", "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with or without an id, each by its own text."""
    key = F.xxhash64("doc_id", "text")
    found = decontam.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "decontamination"))
    return docs.withColumn("__key", key).join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids."""
    return packing.binary_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
