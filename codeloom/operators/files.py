"""File level operators: plans, metadata, extractions, hashes, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import paths
from codeloom.functions import text as tx

PLAN_SCHEMA = ("kind string, extract array<string>, chunking string, symbol_parse boolean, "
               "embed boolean, assembly string, metadata array<string>")


def plan_table(spark: SparkSession, plans=None) -> DataFrame:
    return spark.createDataFrame(rules.PLANS if plans is None else plans, PLAN_SCHEMA)


def plan_files(files: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Attach the processing plan of each file's kind, and the skip flag.

    The plan table has one row per kind (four), which is the proof of its size.
    """
    plans = plan_table(files.sparkSession) if plans is None else plans
    return (files.join(F.broadcast(plans), "kind", "left")
            .withColumn("skip", paths.is_noise(F.col("path"))))


def keep_processable(files: DataFrame) -> DataFrame:
    """Noise files never reach chunking."""
    return files.filter(~paths.is_noise(F.col("path")))


def headings(text: Column) -> Column:
    return F.array_join(F.filter(tx.lines(text), lambda l: tx.ltrim(l).startswith("#")), "\n")


def anchors(text: Column) -> Column:
    return F.array_join(F.filter(tx.lines(text), lambda l: l.contains("#")), "\n")


def extractions(planned: DataFrame) -> DataFrame:
    """One row per extraction of a file's plan: (path, extract_ord, extract, text)."""
    out = planned.select("path", "content", F.posexplode("extract").alias("extract_ord", "extract"))
    text = (F.when(F.col("extract") == "Headings", headings(F.col("content")))
            .when(F.col("extract") == "Anchors", anchors(F.col("content")))
            .otherwise(F.col("content")))
    return out.select("path", "extract_ord", "extract", text.alias("text"))


def metadata(planned: DataFrame) -> DataFrame:
    """Map of path, filetype and the keys each plan asks for."""
    text = F.col("content")
    values = {
        "title": F.coalesce(F.try_element_at(tx.lines(text), F.lit(1)), F.lit("")),
        "anchors": F.size(F.filter(tx.lines(text), lambda l: l.contains("#"))).cast("string"),
        "language": F.col("ext"),
        "dependencies": F.lit("[]"),
        "filetype": F.col("ext"),
    }

    def value(key: Column) -> Column:
        out = F.lit("")
        for name, col in values.items():
            out = F.when(key == name, col).otherwise(out)
        return out

    wanted = F.array_distinct(F.concat(F.array(F.lit("filetype")), F.filter("metadata", lambda k: k != "path")))
    entries = F.concat(F.array(F.struct(F.lit("path").alias("key"), F.col("path").alias("value"))),
                       F.transform(wanted, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))
    return planned.select("path", F.map_from_entries(entries).alias("metadata"))


def content_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def patch_statistics(patches: DataFrame, key: str = "patch_id", patch: str = "patch") -> DataFrame:
    """Hunks, added and removed lines of each patch; read row by row, no shuffle."""
    rows = tx.lines(F.col(patch))

    def count(mark: str, but: str | None = None) -> Column:
        test = lambda l: l.startswith(mark) & (~l.startswith(but) if but else F.lit(True))
        return F.size(F.filter(rows, test)).cast("bigint")

    return patches.select(key, count("@@").alias("hunks"), count("+", "+++").alias("lines_added"),
                          count("-", "---").alias("lines_removed"))


def validate(files: DataFrame) -> DataFrame:
    return files.select("path", tx.validate_content(F.col("content")).alias("result")).select(
        "path", "result.valid", "result.errors", "result.warnings")
