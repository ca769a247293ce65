"""The corpus pipeline over documents: classifier, rules, exact dedup, near dedup, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules
from codeloom.llm.common import documents, prepare
from codeloom.llm.queries import vocabulary_path
from codeloom.session import checkpoint_dir


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that the classifier scores 0.7 or more; it learns from the labels of these documents."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.train(docs, labels))


def clean_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, and documents with too few words, too much repetition or too much lost go whole."""
    prepare(spark)
    return quality_rules.clean_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary_path()).drop("ids")


STAGES = [("quality_classifier", drop_low_quality), ("quality_rules", clean_by_rules), ("exact_dedup", drop_exact_copies),
          ("near_dedup", drop_near_copies), ("packing", pack)]

# the classifier and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next one."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
