"""Column functions over ``array<float>`` vectors, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import rules


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different length have similarity 0."""
    value = _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def l2_normalise(v: Column) -> Column:
    length = norm(v)
    return F.when(length > 1e-12, F.transform(as_double(v), lambda x: x / length)).otherwise(as_double(v))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as SQL engines do it: what rounds to zero from below keeps its sign."""
    value = F.round(x, digits)
    return F.when((value == 0) & (x < 0), F.lit(-0.0)).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def clamp_ids(ids: Column) -> Column:
    """Token ids outside the vocabulary become the unknown token."""
    return F.transform(ids, lambda i: F.when(i > rules.MAX_TOKEN_ID, F.lit(rules.UNKNOWN_TOKEN_ID)).otherwise(i))


def pad(ids: Column, size: Column) -> Column:
    """Ids padded with zeros to ``size`` and the mask of real positions."""
    missing = F.greatest(size - F.size(ids), F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), missing)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size(ids)),
                             F.array_repeat(F.lit(0).cast("bigint"), missing)).alias("attention_mask"))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 if one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))
