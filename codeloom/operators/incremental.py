"""Incremental refresh by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, status): new, modified, deleted or unchanged."""
    a = old.select(key, F.col(digest).alias("__old"))
    b = new.select(key, F.col(digest).alias("__new"))
    status = (F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted")
              .when(F.col("__old") != F.col("__new"), "modified").otherwise("unchanged"))
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge_table(stored: DataFrame, fresh: DataFrame, status: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows of unchanged files plus recomputed rows of new and modified ones."""
    stale = status.filter(F.col("status") != "unchanged").select(key)
    return stored.join(stale, key, "left_anti").unionByName(fresh)


def to_process(files: DataFrame, status: DataFrame, key: str = "path") -> DataFrame:
    return files.join(status.filter(F.col("status").isin("new", "modified")), key, "left_semi")
