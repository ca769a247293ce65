"""Scan a source tree, or take a table of documents as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

BINARY_PROBE = 1024


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 1024."""
    return F.contains(F.substring(content, 1, BINARY_PROBE), F.lit(bytearray(b"\x00")))


def scan_tree(spark: SparkSession, root: str, strip_root: bool = False) -> DataFrame:
    """Every file below ``root`` as (path, content); binary files are left out.

    Files are spread over tasks by size; nothing is listed or read on the driver
    beyond Spark's own file index.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    path = F.substr(path, F.length(F.lit(clean)) + 1)
    if strip_root:
        path = paths.drop_root(path)
    kept = base.filter(~looks_binary(F.col("content")))
    return as_files(kept.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")))


def as_files(df: DataFrame) -> DataFrame:
    """Add kind, extension and module to a (path, content) table."""
    ext = paths.extension(F.col("path"))
    return df.select("path", "content", paths.classify(ext).alias("kind"), ext.alias("ext"),
                     paths.parent_module(F.col("path")).alias("module"))


def file_structure(files: DataFrame) -> DataFrame:
    """Flat file list with byte sizes."""
    return files.select("path", F.lit("file").alias("node_type"),
                        F.octet_length("content").cast("bigint").alias("size"))
