"""Chunkers: each turns one text row into chunk rows without a shuffle.

All return (path, chunk_ord, chunk_id, start, end, text); ``start``/``end`` are
byte positions where the strategy knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import files as fo

_LONG = "bigint"


def _rows(df: DataFrame, chunks: Column, keys: list[str]) -> DataFrame:
    out = df.select(*keys, F.posexplode(chunks).alias("__ord", "__chunk"))
    return out.select(*keys, F.col("__ord").cast(_LONG).alias("chunk_ord"), F.col("__chunk.id").alias("chunk_id"),
                      F.lit(None).cast(_LONG).alias("start"), F.lit(None).cast(_LONG).alias("end"),
                      F.col("__chunk.text").alias("text"))


def _numbered(parts: Column, prefix: str) -> Column:
    return F.transform(parts, lambda t, i: F.struct(F.concat(F.lit(prefix), i).alias("id"), t.alias("text")))


def whole(df: DataFrame, text: str = "content", keys=("path",)) -> DataFrame:
    chunk = F.array(F.struct(F.lit("full").alias("id"), F.col(text).alias("text")))
    return _rows(df, chunk, list(keys))


def by_lines(df: DataFrame, n: int, text: str = "content", keys=("path",)) -> DataFrame:
    """Chunks of ``n`` lines."""
    # the line array is a column of its own: inside the lambda it would be split again per chunk
    df = df.select(*keys, tx.lines(F.col(text)).alias("__rows"))
    rows = F.col("__rows")
    count = F.ceil(F.size(rows) / n).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.array_join(F.slice(rows, i * n + 1, F.lit(n)), "\n"))
    return _rows(df, _numbered(parts, "l-"), list(keys))


def by_delimiter(df: DataFrame, delimiter: str, text: str = "content", keys=("path",)) -> DataFrame:
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return _rows(df, _numbered(F.split(F.col(text), quoted, -1), "d-"), list(keys))


def by_paragraph(df: DataFrame, text: str = "content", keys=("path",)) -> DataFrame:
    """Blank-line paragraphs; empty ones are dropped but keep their number."""
    numbered = _numbered(F.transform(F.split(F.col(text), "\n\n", -1), tx.trim), "c-")
    return _rows(df, F.filter(numbered, lambda c: c["text"] != ""), list(keys))


def by_heading(df: DataFrame, text: str = "content", keys=("path",), extract_ord: Column | None = None) -> DataFrame:
    """Sections that open at a line starting with ``#``; text before the first is its own section.

    Section starts are found first and each section is one slice of the line
    array, so the work is linear in the text.
    """
    number = F.lit(0) if extract_ord is None else extract_ord
    keys = list(keys)
    df = df.select(*keys, number.alias("__number"), F.split(F.col(text), "\n", -1).alias("__rows"))
    rows, number = F.col("__rows"), F.col("__number")
    opens = F.filter(F.transform(rows, lambda l, i: F.when(tx.ltrim(l).startswith("#"), i)), lambda i: i.isNotNull())
    df = df.withColumn("__starts", F.array_distinct(F.concat(F.array(F.lit(0)), opens)))
    starts, last = F.col("__starts"), F.size(rows)

    def section(start: Column, i: Column) -> Column:
        is_last = i == F.size(starts) - 1
        stop = F.when(is_last, last).otherwise(F.try_element_at(starts, i + 2))
        name = F.when(is_last, F.lit("tail")).otherwise(stop.cast("string"))
        body = F.concat(F.array_join(F.slice(rows, start + 1, stop - start), "\n"), F.lit("\n"))
        return F.struct(F.concat(F.lit("h-"), number, F.lit("-"), name).alias("id"), body.alias("text"))

    return _rows(df, F.transform(starts, section), keys)


def documentation_chunks(planned: DataFrame, all_extractions: bool = False) -> DataFrame:
    """Heading chunks of documentation files.

    Default: the full text only. ``all_extractions`` chunks every extraction of
    the plan, which covers the text up to three times.
    """
    parts = fo.extractions(planned)
    if not all_extractions:
        parts = parts.filter(F.col("extract") == "FullText")
    # number of the extraction inside the plan, as in the chunk id
    out = by_heading(parts.withColumn("__n", F.col("extract_ord")), "text", ("path", "extract_ord"),
                     F.col("__n"))
    # one ordinal per file: extraction first, then section
    return out.select("path", (F.col("extract_ord").cast(_LONG) * F.lit(1 << 32) + F.col("chunk_ord")).alias("chunk_ord"),
                      "chunk_id", "start", "end", "text")


CHUNKERS = {
    "None": whole,
    "Lines": by_lines,
    "Delimiter": by_delimiter,
    "Paragraphs": by_paragraph,
    "HeadingSections": by_heading,
}


def chunk(df: DataFrame, strategy: str, *args, **options) -> DataFrame:
    """Apply a chunker by name; register another in ``CHUNKERS`` to extend."""
    return CHUNKERS[strategy](df, *args, **options)
