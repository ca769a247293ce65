"""Change logs as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.ordered import ROWS_PER_RANGE, forward_fill


def parse_log(log: DataFrame, line: str = "line", order: str = "line_no", keys: list[str] | None = None,
              width: int = ROWS_PER_RANGE) -> DataFrame:
    """``hash|author|date`` headers followed by path lines -> (author, date, path).

    The header of a path line is the last one above it. A log is one sequence,
    so the fill runs by ranges of line numbers, never as one window.
    """
    keys = keys or []
    text = tx.trim(F.col(line))
    parts = F.split(text, r"\|")
    rows = log.select(*keys, order, text.alias("__text")).filter(F.col("__text") != "")
    text, is_header = F.col("__text"), F.col("__text").contains("|")
    parts = F.split(text, r"\|")
    header = F.when(is_header & (F.size(parts) >= 3),
                    F.struct(parts[1].alias("author"), parts[2].alias("date")))
    filled = forward_fill(rows, keys, order, header, "__header", width)
    return (filled.filter(~is_header & F.col("__header").isNotNull())
            .select(*keys, order, F.col("__header.author").alias("author"),
                    F.col("__header.date").alias("date"), text.alias("path")))


def parse_numstat(stats: DataFrame, line: str = "line") -> DataFrame:
    """``added deleted path`` lines summed per path; non-numeric rows (binary) are skipped."""
    parts = F.split(tx.trim(F.col(line)), r"\s+")
    number = lambda i: F.when(F.try_element_at(parts, F.lit(i)).rlike("^[0-9]+$"),
                              F.try_element_at(parts, F.lit(i)).cast("bigint"))
    rows = stats.select(number(1).alias("added"), number(2).alias("deleted"),
                        F.try_element_at(parts, F.lit(3)).alias("path"))
    return (rows.filter(F.col("added").isNotNull() & F.col("deleted").isNotNull())
            .groupBy("path").agg(F.sum(F.col("added") + F.col("deleted")).alias("lines_changed")))
