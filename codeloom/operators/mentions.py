"""Where symbols are mentioned, and usage examples.

A text search for every name is an inverted-index join: the words of a chunk are
exploded once and joined by equality with the names. The name side is unique, so
a very common word only widens the streamed side, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as tx

EXAMPLES_PER_SYMBOL = 5


def mention_pairs(chunks: DataFrame, names: DataFrame, keys=("path", "chunk_ord"), text: str = "text",
                  name: str = "name") -> DataFrame:
    """Whole-word mentions: distinct (name, *keys).

    A name of several words is found by its first two words with what stands between them; the text is searched only if
    the name has more than that.
    """
    keys = list(keys)
    wanted = names.select(F.col(name).alias("name")).filter(F.col("name") != "").distinct()
    single = wanted.filter(~F.col("name").rlike(tx.WORD_BREAK))
    tokens = chunks.select(*keys, F.explode(F.array_distinct(tx.words(F.col(text)))).alias("name"))
    direct = tokens.join(single, "name")
    several = wanted.filter(F.col("name").rlike(tx.WORD_BREAK))
    pair = tx.word_pairs(F.col("name"))
    pairs = chunks.select(*keys, F.explode(F.array_distinct(tx.word_pairs(F.col(text)))).alias("anchor"))
    found = pairs.join(several.select("name", F.get(pair, F.lit(0)).alias("anchor")), "anchor").select(*keys, "name", "anchor")
    exact = found.filter(F.col("name") == F.col("anchor"))
    # a word with marks around it is anchored by the word
    alone = several.filter(F.size(tx.words(F.col("name"))) == 1).select(F.col("name").alias("full_name"), tx.words(F.col("name"))[0].alias("name"))
    maybe = found.filter(F.col("name") != F.col("anchor")).select(*keys, "name").unionByName(
        tokens.join(alone, "name").select(*keys, F.col("full_name").alias("name")))
    edge = r"[\p{L}\p{M}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{edge})\\Q"), F.col("name"), F.lit(f"\\E(?!{edge})"))
    checked = maybe.join(chunks.select(*keys, F.col(text).alias("__text")), keys).filter(
        F.regexp_like(F.col("__text"), pattern))
    checked = checked.select("name", *keys).unionByName(exact.select("name", *keys))
    return direct.select("name", *keys).unionByName(checked.select("name", *keys))


def _test_and_doc(chunks: DataFrame) -> DataFrame:
    path = F.col("path")
    flagged = chunks.withColumn("is_test", paths.is_test_path(path)).withColumn("is_doc", paths.is_doc_path(path))
    return flagged.filter(F.col("is_test") | F.col("is_doc"))


def cross_references(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions in test and doc files as distinct rows (name, ref_type, location)."""
    found = _test_and_doc(chunks)
    where = found.select("path", "chunk_ord", "chunk_id", "is_test", "is_doc")
    hits = mention_pairs(found, names).join(where, ["path", "chunk_ord"])
    kinds = F.filter(F.array(F.when(F.col("is_test"), "test"), F.when(F.col("is_doc"), "doc")), lambda k: k.isNotNull())
    return hits.select("name", F.explode(kinds).alias("ref_type"),
                       F.concat("path", F.lit(":"), "chunk_id").alias("location")).distinct()


def usage_examples(chunks: DataFrame, names: DataFrame, limit: int = EXAMPLES_PER_SYMBOL) -> DataFrame:
    """Up to ``limit`` examples per name, tests before docs, then by file.

    Ranking runs on keys alone; texts are fetched for the kept rows only.
    """
    found = _test_and_doc(chunks)
    where = found.select("path", "chunk_ord", F.when(F.col("is_test"), "test").otherwise("doc").alias("example_type"))
    hits = mention_pairs(found, names).join(where, ["path", "chunk_ord"])
    best = Window.partitionBy("name").orderBy(F.desc("example_type"), "path", "chunk_ord")
    kept = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    span = tx.span_numbers(F.col("chunk_id"))
    return (kept.join(chunks.select("path", "chunk_ord", "chunk_id", "text"), ["path", "chunk_ord"])
            .select("name", "rank", F.col("path").alias("file"), "example_type",
                    tx.snippet(F.col("text"), F.col("name")).alias("context"),
                    span["line_start"].alias("line_start"), span["line_end"].alias("line_end")))
