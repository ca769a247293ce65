"""Sequence operators that do not put one key's rows into one task.

A plain window partitioned by key sorts the whole key in one task. Here rows
are first split by key *and* range of the order column; the window runs inside
each range and a summary with one row per range carries the state across. The
order column must be an integer, unique within its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000
_RANGE = "__range"


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_RANGE, F.floor(F.col(order) / width))


def _before(keys) -> Window:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def forward_fill(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                 width: int = ROWS_PER_RANGE) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    rows = _ranged(df, order, width).withColumn("__value", value)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order)
    local = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(inside))
    carry = (rows.filter(F.col("__value").isNotNull()).groupBy(*keys, _RANGE)
             .agg(F.max_by("__value", order).alias("__last")))
    # every range needs the state, also ranges without a value of their own
    ranges = rows.select(*keys, _RANGE).distinct().join(carry, [*keys, _RANGE], "left")
    carry = ranges.select(*keys, _RANGE, F.last("__last", ignorenulls=True).over(_before(keys)).alias("__carry"))
    return (local.join(carry, [*keys, _RANGE], "left")
            .withColumn(out, F.coalesce("__local", "__carry"))
            .drop(_RANGE, "__value", "__local", "__carry"))


def shift_value(df: DataFrame, keys: list[str], order: str, value: Column, out: str, back: bool = False,
                width: int = ROWS_PER_RANGE) -> DataFrame:
    """``value`` of the following row of the key (of the preceding one with ``back``)."""
    move, edge = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    rows = _ranged(df, order, width).withColumn("__value", value)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order)
    local = (rows.withColumn("__next", move("__value").over(inside))
             .withColumn("__inner", move(F.lit(True)).over(inside)))
    borders = rows.groupBy(*keys, _RANGE).agg(edge(F.struct(F.col("__value").alias("v")), order).alias("__border"))
    over_ranges = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_RANGE)
    borders = borders.select(*keys, _RANGE, move("__border").over(over_ranges)["v"].alias("__carry"))
    return (local.join(borders, [*keys, _RANGE], "left")
            .withColumn(out, F.when(F.col("__inner"), F.col("__next")).otherwise(F.col("__carry")))
            .drop(_RANGE, "__value", "__next", "__inner", "__carry"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                width: int = ROWS_PER_RANGE) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    rows = _ranged(df, order, width).withColumn("__value", value)
    inside = (Window.partitionBy(*keys, _RANGE).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumn("__local", F.sum("__value").over(inside))
    totals = rows.groupBy(*keys, _RANGE).agg(F.sum("__value").alias("__total"))
    totals = totals.select(*keys, _RANGE, F.coalesce(F.sum("__total").over(_before(keys)), F.lit(0)).alias("__carry"))
    return (local.join(totals, [*keys, _RANGE], "left")
            .withColumn(out, F.col("__local") + F.col("__carry"))
            .drop(_RANGE, "__value", "__local", "__carry"))
