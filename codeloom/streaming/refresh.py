"""Incremental refresh as a stream of arriving files.

Every stored table is cut into hash buckets of the path. A batch reads and writes only the buckets whose files it changes, so
its cost grows with the batch and not with what is stored:

    <folder>/<table>/version=<n>/path_bucket=<k>/...    the rows of bucket k as batch n left them
    <folder>/_published                                 per version, table and bucket: whether it holds rows

The current rows of a bucket are those of the last published version that wrote it. State is the stored hash table, not
stream state: a batch publishes last, so a failed batch leaves what was published intact, and a replayed batch, known by
its token, sees the buckets as they were before it and writes its version again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators import files as fo
from codeloom.session import cut_lineage
from codeloom.sources import tree

Derive = Callable[[DataFrame], dict[str, DataFrame]]
BUCKETS = 256
HASHES = "file_hashes"
_BUCKET = "path_bucket"
_PUBLISHED = "version long, token string, buckets int, table string, bucket int, held boolean, layout string"


def bucket_of(buckets: int, path: str = "path"):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _published(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_PUBLISHED).parquet(f"{folder}/_published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, folder: str) -> int:
    """Highest published version, 0 for none."""
    marks = _published(spark, folder)
    return int(marks.agg(F.max("version")).first()[0] or 0) if marks is not None else 0


def _version_path(folder: str, name: str, version: int) -> str:
    return f"{folder}/{name}/version={version}"


def read_current(spark: SparkSession, folder: str, name: str, *, before: int | None = None, buckets: Collection[int] | None = None) -> DataFrame:
    """The rows of a table as published (before a version), of some buckets or all.

    The driver sees one row a bucket, whose number is fixed when the folder is first written.
    """
    marks = _published(spark, folder)
    if marks is None:
        raise ValueError(f"nothing is published in {folder}")
    mine = marks.filter(F.col("table") == name)
    if before is not None:
        mine = mine.filter(F.col("version") < before)
    last = mine.groupBy("bucket").agg(F.max("version").alias("version"), F.max_by("held", "version").alias("held"),
                                      F.max_by("layout", "version").alias("layout")).collect()
    if not last:
        raise ValueError(f"table {name} is not published in {folder}")
    layout = StructType.fromJson(json.loads(max(last, key=lambda r: r["version"])["layout"]))
    paths = [f"{_version_path(folder, name, r['version'])}/{_BUCKET}={r['bucket']}" for r in last
             if r["held"] and (buckets is None or r["bucket"] in buckets)]
    return spark.read.schema(layout).parquet(*paths) if paths else spark.createDataFrame([], layout)


def _version_of(spark: SparkSession, folder: str, token: str) -> int:
    """The version a batch writes: its own if it was published before, else the next one."""
    marks = _published(spark, folder)
    if marks is None:
        return 1
    mine, last = marks.agg(F.max(F.when(F.col("token") == token, F.col("version"))), F.max("version")).first()
    return int(mine or last + 1)


def refresh_batch(spark: SparkSession, folder: str, arrived: DataFrame, derive: Derive, token: str, order: str | None = None,
                  buckets: int = BUCKETS) -> None:
    """Bring the stored tables up to date with one batch of (path, content) rows.

    Of rows that share a path the last by ``order`` counts, by content if no column is named. A null content deletes the path.
    ``derive`` turns the changed files into tables with a ``path`` column whose rows depend on their own file only. ``token``
    names the batch; ``buckets`` counts for a new folder only.
    """
    last = F.max_by(F.struct("content"), F.col(order)) if order else F.max(F.struct("content"))
    arrived = cut_lineage(arrived.groupBy("path").agg(last.alias("last")).select("path", "last.content"))
    version = _version_of(spark, folder, token)
    marks = _published(spark, folder)
    if marks is not None:
        buckets = marks.select("buckets").first()[0]
    files = tree.as_files(arrived.filter(F.col("content").isNotNull()))
    hashes = fo.content_hashes(files)
    gone = arrived.filter(F.col("content").isNull()).select("path")
    known = version > 1
    if known:
        met = [r[0] for r in arrived.select(bucket_of(buckets).alias("b")).distinct().collect()]
        old = read_current(spark, folder, HASHES, before=version, buckets=met)
        same = hashes.join(old, ["path", "sha256"], "left_semi").select("path")
        changed = files.join(same, "path", "left_anti")
        gone = gone.join(old, "path", "left_semi")
    else:
        changed = files
    changed = cut_lineage(changed)
    stale = cut_lineage(changed.select("path").unionByName(gone) if known else changed.select("path"))
    dirty = sorted(r[0] for r in stale.select(bucket_of(buckets).alias("b")).distinct().collect())
    rows = []
    for name, fresh in {HASHES: fo.content_hashes(changed), **derive(changed)}.items():
        if known:
            kept = read_current(spark, folder, name, before=version, buckets=dirty).join(stale, "path", "left_anti")
            fresh = kept.unionByName(fresh)
        path = _version_path(folder, name, version)
        # one task a bucket, more for a large one
        fresh.withColumn(_BUCKET, bucket_of(buckets)).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        held = spark.read.schema(fresh.withColumn(_BUCKET, F.lit(0)).schema).parquet(path).select(_BUCKET).distinct()
        held = {r[0] for r in held.collect()}
        layout = fresh.schema.json()
        rows += [(version, token, buckets, name, b, b in held, layout) for b in dirty or [None]]
    spark.createDataFrame(rows, _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{folder}/_published")


def start_refresh(spark: SparkSession, source: DataFrame, folder: str, derive: Derive, checkpoint: str, order: str | None = None,
                  buckets: int = BUCKETS, **trigger):
    """Start the stream; ``source`` is a streaming (path, content) DataFrame, with an ``order`` column if named."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # the id that the stream has written into its checkpoint folder; a fresh folder means another stream
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        refresh_batch(batch.sparkSession, folder, batch, derive, f"{stream}:{batch_id}", order, buckets)

    return (source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
