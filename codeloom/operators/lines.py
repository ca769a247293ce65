"""Line table and line statistics.

A file is one row, so per-line state is folded inside the row: no line is
shuffled to count comments. The exploded line table is for operators that need
lines as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import text as tx

IMPORT_LIMIT = 20


def line_table(files: DataFrame, text: str = "content") -> DataFrame:
    return files.select("path", F.posexplode(tx.lines(F.col(text))).alias("line_no", "line"))


def comment_style(ext: Column) -> Column:
    return (F.when(ext.isin(rules.C_STYLE_EXTENSIONS), "c")
            .when(ext.isin(rules.HASH_STYLE_EXTENSIONS), "hash").otherwise("none"))


def line_counts(text: Column, style: Column) -> Column:
    """Struct of total, code, comment and blank line counts.

    Block state: a line with ``/*`` opens a block (also inside a string), lines
    of a block are comments until one with ``*/``.
    """
    zero = F.lit(0).cast("bigint")
    c_style, hash_style = style == "c", style == "hash"

    def step(acc: Column, line: Column) -> Column:
        blank = line == ""
        block = c_style & ~blank & (acc["open"] | line.contains("/*"))
        single = (c_style & line.startswith("//")) | (
            hash_style & (line.startswith("#") | line.startswith('"""') | line.startswith("'''")))
        comment = block | single
        one = lambda test: F.when(test, F.lit(1).cast("bigint")).otherwise(zero)
        return F.struct(
            F.when(block, ~line.contains("*/")).otherwise(acc["open"]).alias("open"),
            (acc["code"] + one(~blank & ~comment)).alias("code"),
            (acc["comment"] + one(comment)).alias("comment"),
            (acc["blank"] + one(blank)).alias("blank"))

    start = F.struct(F.lit(False).alias("open"), zero.alias("code"), zero.alias("comment"), zero.alias("blank"))
    return F.aggregate(F.transform(tx.lines(text), tx.trim), start, step)


def line_stats(files: DataFrame, style: Column | None = None) -> DataFrame:
    """(path, total, code, comment, blank); pass ``style`` to override the extension's comment syntax."""
    style = comment_style(F.col("ext")) if style is None else style
    counted = files.select("path", line_counts(F.col("content"), style).alias("c"))
    total = F.col("c.code") + F.col("c.comment") + F.col("c.blank")
    return counted.select("path", total.alias("total"), "c.code", "c.comment", "c.blank")


def document_line_stats(files: DataFrame) -> DataFrame:
    """The documentation variant: only ``.rs`` files have comments."""
    return line_stats(files, F.when(F.col("path").endswith(".rs"), "c").otherwise("none"))


def block_state(lines: DataFrame) -> DataFrame:
    """Line table with the flag ``in_block``: the line opens in a running block comment.

    Lines of one file are bounded by the file's own row.
    """
    event = F.when(F.col("line").contains("*/"), False).when(F.col("line").contains("/*"), True)
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_block", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))


def imports(files: DataFrame, limit: int = IMPORT_LIMIT) -> DataFrame:
    """First ``limit`` import lines of each file as (path, import_ord, import)."""
    trimmed = F.transform(tx.lines(F.col("content")), tx.trim)
    found = F.filter(trimmed, lambda l: l.startswith("use ") | l.startswith("import "))
    return files.select("path", F.posexplode(F.slice(found, 1, limit)).alias("import_ord", "import"))
