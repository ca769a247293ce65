"""Embedding of texts and aggregates of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions import vectors as vx
from codeloom.operators.similarity import _matrix

BATCH = 32
DIM = 64


def token_hash(tok: Column, name: str = "xxhash64") -> Column:
    """Non-negative 32 bit hash of a token, computed on the JVM."""
    if name == "md5":
        return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.xxhash64(tok), F.lit(1 << 32))


def hashing_embedding(df: DataFrame, text: str, keys: list[str], dim: int = DIM, hash_name: str = "xxhash64") -> DataFrame:
    """Default embedder: signed feature hashing of lower-case words, unit length.

    Tokens are hashed by built-in expressions; a task then adds up whole Arrow
    batches with one ``bincount``.
    """
    hashes = F.transform(tx.words(F.lower(F.col(text))), lambda t: token_hash(t, hash_name))
    slots = F.transform(hashes, lambda h: F.pmod(h, F.lit(dim)).cast("int"))
    signs = F.transform(hashes, lambda h: F.when(F.pmod(F.floor(h / dim), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1)))
    rows = df.select(*keys, slots.alias("__slots"), signs.alias("__signs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def add_up(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            slots_col = batch.column("__slots")
            flat = slots_col.flatten().to_numpy(zero_copy_only=False)
            sign = batch.column("__signs").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), np.diff(slots_col.offsets.to_numpy()))
            total = np.bincount(row * dim + flat, weights=sign, minlength=n * dim).reshape(n, dim)
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            unit = np.where(length > 1e-12, total / np.maximum(length, 1e-300), total).astype(np.float32)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            out = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [out], names=[*keys, "embedding"])

    return rows.mapInArrow(add_up, f"{schema}, embedding array<float>")


def model_embedding(df: DataFrame, text: str, keys: list[str], load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                    batch: int = BATCH) -> DataFrame:
    """Embed with any model; ``load_model`` runs once per task and returns texts -> matrix."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(batches):
        model = load_model()
        for big in batches:
            for at in range(0, big.num_rows, batch):
                part = big.slice(at, batch)
                vectors = np.asarray(model(part.column("__text").to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keys] + [pa.array(vectors.tolist(), pa.list_(pa.float32()))],
                                                 names=[*keys, "embedding"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, embedding array<float>")


def group_sums(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """(group, dim, total, n, squares): vector sums per group, pre-added inside each Arrow batch."""
    rows = df.select(*[F.col(g) for g in group], F.col(vector).alias("__vec"))
    key = F.struct(*group)
    rows = rows.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("__key"), "__vec")

    def partial(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("__key").dictionary_encode()
            index = keys.indices.to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("__vec"))
            n_keys, dim = len(keys.dictionary), x.shape[1]
            total = np.zeros((n_keys, dim))
            np.add.at(total, index, x)
            squares = np.bincount(index, weights=(x * x).sum(axis=1), minlength=n_keys)
            n = np.bincount(index, minlength=n_keys).astype(np.int64)
            offsets = pa.array(np.arange(0, (n_keys + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [keys.dictionary, pa.ListArray.from_arrays(offsets, pa.array(total.ravel())), pa.array(n), pa.array(squares)],
                names=["__key", "total", "n", "squares"])

    parts = rows.mapInArrow(partial, "__key string, total array<double>, n bigint, squares double")
    key_schema = df.select(*group).schema
    wide = parts.select("__key", F.posexplode("total").alias("dim", "total"), "n", "squares")
    sums = wide.groupBy("__key", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"),
                                            F.sum("squares").alias("squares"))
    return sums.select(F.from_json("__key", key_schema).alias("k"), "dim", "total", "n", "squares").select(
        *[F.col("k")[g].alias(g) for g in group], "dim", "total", "n", "squares")


def group_centroids(df: DataFrame, group: list[str], vector: str = "embedding", unit: bool = False) -> DataFrame:
    """Mean vector per group, optionally scaled to unit length."""
    means = group_sums(df, group, vector)
    # a vector has ``dim`` entries, which bounds the collected array
    packed = means.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("total") / F.col("n")).alias("v")))),
                    lambda s: s["v"]).alias("centroid"), F.max("n").alias("n"))
    return packed.withColumn("centroid", vx.l2_normalise(F.col("centroid"))) if unit else packed


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector", mask: str = "mask") -> DataFrame:
    """Mean of token vectors per text over the positions the attention mask keeps."""
    return group_centroids(tokens.filter(F.col(mask) > 0), [key], vector)


def cohesion(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Mean pairwise similarity per group in closed form; 1.0 below two members.

    (|sum v|^2 - sum |v|^2) / (n (n - 1)): one aggregate, no pairs.
    """
    sums = group_sums(df, group, vector)
    per = sums.groupBy(*group).agg(F.sum(F.col("total") * F.col("total")).alias("s2"), F.max("squares").alias("q"),
                                   F.max("n").alias("n"))
    value = F.when(F.col("n") < 2, F.lit(1.0)).otherwise(
        (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1)))
    return per.select(*group, "n", value.alias("cohesion"))


def centrality(df: DataFrame, group: list[str], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Sum of similarities to the other members: v . sum - v . v."""
    totals = group_sums(df, group, vector).groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda s: s["total"]).alias("__total"))
    v = F.col(vector)
    return df.join(totals, group).select(*group, vec_id, (vx.dot(v, F.col("__total")) - vx.dot(v, v)).alias("centrality"))
