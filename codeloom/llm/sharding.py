"""Rendezvous sharding: each key ranks all shards by a hash of (key, shard) and takes the best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import text_of
from codeloom.session import cut_lineage

# 13 hexadecimal digits: 52 bits are exact in a double
DIGITS = 13
TOP = float(16 ** DIGITS)


def _uniform(word: Column) -> Column:
    """A number in (0, 1) from the hash of a string."""
    return (F.conv(F.substring(F.md5(word), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(TOP)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key. A shard of twice the weight gets twice the keys.

    Taking one more shard into the list moves a key only if the new shard ranks best for it; no key moves between the old ones.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    ranked = [F.struct((F.lit(-float(w)) / F.log(_uniform(F.concat(key, F.lit(f":{s}"))))).alias("score"),
                       F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*ranked))["shard"] if len(ranked) > 1 else F.lit(0)


def record_key(key: str, text: str) -> Column:
    """The key as a string; rows without one are spread by their text."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(text_of(text))))


def assign_shards(docs: DataFrame, weights: Sequence[float], *, grown: Sequence[float] | None = None, key: str = "doc_id",
                  text: str = "text", buckets: int = 1024) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the UTF-8 length of the text plus 1, a null text has none. ``slot`` counts each shard's rows from 0 without
    gaps: rows are ranked inside one of ``buckets`` hash ranges of their shard, and the counts of the ranges before are
    added; that table has ``shards * buckets`` rows at most, so it may be broadcast. Rows without key go by their text.
    Repeated rows share a shard and get slots of their own.
    """
    name = record_key(key, text)
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        (rendezvous(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("bucket"))
    rows = cut_lineage(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    return (rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "bucket"])
            .select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float], *, key: str = "doc_id", text: str = "text",
                 parts: int = 8) -> None:
    """Write the rows as Parquet, one folder ``shard=N`` for each shard, in about ``parts`` files each."""
    shard = rendezvous(record_key(key, text), weights)
    rows = docs.drop("shard").withColumn("shard", shard)
    spread = F.pmod(F.xxhash64(record_key(key, text)), F.lit(parts))
    rows.repartition(len(weights) * parts, "shard", spread).write.partitionBy("shard").parquet(folder)
