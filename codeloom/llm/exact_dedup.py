"""Exact dedup by skew-safe combining, with built-in functions only.

Rows of equal normalised text are combined in three steps, each of which groups by the whole normalised text beside its
digest, so equal digests of different texts never meet:

1. locally: the partial aggregate of each task leaves one row for each text it has read,
2. by salt: these rows are shuffled by (text, salt), so that a text with a third of all rows goes to several tasks,
3. globally: the few winners of the salts of a text are combined.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WHITE, text_of
from codeloom.session import cut_lineage

LAST_ID = (1 << 63) - 1


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), WHITE, "")


def _rank(length: Column, key: Column) -> Column:
    """Larger for more code points, then for a smaller key; one number, so that hash aggregation can hold it."""
    low = F.coalesce(key, F.lit(LAST_ID)).cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    return (length.cast("decimal(10,0)") * F.lit(Decimal(1 << 64)).cast("decimal(21,0)") - low).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", salts: int = 16,
                 digest: Column | None = None) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row for each different normalised text.

    Kept is the row with the most code points, then the smallest key; a null key comes last.
    """
    norm = normalised(text)
    rows = docs.select(F.col(key).cast("long").alias("key"), norm.alias("norm"),
                       (F.sha2(norm, 256) if digest is None else digest).alias("digest"),
                       _rank(F.char_length(text_of(text)), F.col(key).cast("long")).alias("rank"),
                       F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "norm", "salt").agg(
        F.max_by("key", "rank").alias("key"), F.max("rank").alias("rank"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(
        F.max_by("key", "rank").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", salts: int = 16,
                digest: Column | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row, dropped ones too.

    Null and empty texts, and texts of white space only, are equal to one another. Of rows that repeat the kept row's
    key and text exactly one is kept. If the kept key is null, as all keys of the group are, one such row is kept.
    An empty table gives an empty result; other columns are not read, whatever their names.
    ``digest`` may replace the hash the rows are shuffled by; texts that share one are told apart by their content.
    """
    norm = normalised(text)
    by = F.sha2(norm, 256) if digest is None else digest
    groups = cut_lineage(exact_groups(docs, key=key, text=text, salts=salts, digest=digest)
                         .select("digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = docs.select(F.col(key).alias("key"), by.alias("digest"), F.sha2(norm, 256).alias("text_sha256"))
    joined = rows.join(groups, ["digest", "text_sha256"])
    # rows that repeat a key and a text: the first is the one that stays
    copy = F.row_number().over(Window.partitionBy("key", "text_sha256").orderBy("keep_id"))
    return (joined.withColumn("copy", copy)
            .select(F.col("key").alias(key), "keep_id", "group_size",
                    (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    def named(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("none")).alias("id")

    groups = cut_lineage(exact_groups(docs, key=key, text=text, salts=salts).select("digest", named(F.col("keep_id"))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named(F.col(key).cast("long")),
                        F.sha2(normalised(text), 256).alias("digest"))
    # rows that repeat the winner are numbered where the join has put them
    by = Window.partitionBy("id", "digest").orderBy("id", "digest")
    return (whole.join(groups, ["id", "digest"]).withColumn("copy", F.row_number().over(by)).filter("copy = 1").select("row.*"))
