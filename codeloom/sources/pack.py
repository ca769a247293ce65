"""A knowledge pack: one Parquet table per entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema

PACK_VERSION = "1.0.0"


@dataclass
class KnowledgePack:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)


def write_pack(pack: KnowledgePack, folder: str, as_json: bool = False) -> None:
    for name, df in pack.tables.items():
        writer = df.write.mode("overwrite")
        (writer.json if as_json else writer.parquet)(f"{folder}/{name}")


def read_pack(spark: SparkSession, folder: str, names=None) -> KnowledgePack:
    """Tables are lazy; a query reads only the columns it selects. Without names, all tables the pack has."""
    out = {}
    for name in [*schema.PACK_TABLES, *schema.DOCUMENTATION_TABLES] if names is None else names:
        layout = schema.PACK_TABLES.get(name)
        try:
            out[name] = (spark.read.schema(layout) if layout else spark.read).parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if names is not None or name not in (*schema.OPTIONAL_TABLES, *schema.DOCUMENTATION_TABLES) or error.getCondition() != "PATH_NOT_FOUND":
                raise
    return KnowledgePack(out)


def manifest(pack: KnowledgePack) -> DataFrame:
    """One row of totals; every part is an aggregate pushed to its own scan."""
    files = pack.files.agg(F.count("*").alias("total_files"))
    chunks = pack.chunks.agg(F.count("*").alias("total_chunks"))
    vectors = pack.embeddings.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"))
    symbols = pack.symbols.agg(F.count("*").alias("total_symbols"))
    return files.select(
        F.lit(PACK_VERSION).alias("version"), "total_files", chunks.scalar().alias("total_chunks"),
        symbols.scalar().alias("total_symbols"), vectors.scalar().alias("embedding_dim"),
        F.current_timestamp().alias("generated_at"))
