"""Hot spots: change frequency, connectivity, complexity, orphans, refactor impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import graph

# --- fixed values: complexity thresholds and the score of a High function -----
MEDIUM_FILE, HIGH_FILE, HIGH_FUNCTION_SCORE = 3.0, 5.0, 4.5
ORPHAN_LIMIT = 2


def _top(df: DataFrame, n: int | None, *order) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def most_modified(changes: DataFrame, n: int | None = 10) -> DataFrame:
    """Per path: changes, contributors, last date, lines; changes (path, author, date[, lines]).

    Contributors are counted from distinct (path, author) rows, so a path with a
    third of all changes is combined before the shuffle.
    """
    amount = F.sum("lines") if "lines" in changes.columns else F.lit(0)
    per_author = changes.groupBy("path", "author").agg(F.count("*").alias("n"), F.max("date").alias("last"),
                                                       amount.cast("double").alias("lines"))
    out = per_author.groupBy("path").agg(
        F.sum("n").alias("modification_count"), F.count("*").alias("n_contributors"),
        F.max("last").alias("last_modified"), F.sum("lines").alias("lines_changed"))
    return _top(out, n, F.desc("modification_count"), "path")


def contributors(changes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Distinct (path, author), for the paths of ``of`` if given."""
    rows = changes.select("path", "author").distinct()
    return rows if of is None else rows.join(of.select("path").distinct(), "path", "left_semi")


def most_connected(edges: DataFrame, symbols: DataFrame, n: int | None = 10) -> DataFrame:
    """Degree per node with its file, ``unknown`` for nodes outside the symbol table (name, file)."""
    ranked = _top(graph.degrees(edges), n, F.desc("total"), "node")
    files = symbols.select(F.col("name").alias("node"), "file")
    return ranked.join(files, "node", "left").select(
        F.col("node").alias("symbol"), "incoming", "outgoing", "total",
        F.coalesce("file", F.lit("unknown")).alias("file"))


def complexity_bombs(file_summaries: DataFrame, function_docs: DataFrame, n: int | None = 10,
                     medium: float = MEDIUM_FILE) -> DataFrame:
    """Files above ``medium`` (3.0) and functions rated High."""
    files = file_summaries.filter(F.col("complexity_score") > medium).select(
        F.concat(F.lit("file:"), "path").alias("symbol"), "path",
        F.col("complexity_score").cast("double").alias("complexity_score"),
        F.when(F.col("complexity_score") > HIGH_FILE, "High").otherwise("Medium").alias("complexity_estimate"),
        F.lit("file").alias("symbol_kind"))
    functions = function_docs.filter(F.col("complexity_estimate") == "High").select(
        F.col("name").alias("symbol"), "path", F.lit(HIGH_FUNCTION_SCORE).alias("complexity_score"),
        "complexity_estimate", F.lit("function").alias("symbol_kind"))
    return _top(files.unionByName(functions), n, F.desc("complexity_score"), "symbol", "path")


def orphans(symbols: DataFrame, edges: DataFrame, n: int | None = 10, limit: int = ORPHAN_LIMIT) -> DataFrame:
    """Symbols (name, kind, file, signature) with at most ``limit`` connections."""
    counts = graph.degrees(edges).select(F.col("node").alias("name"), F.col("total").alias("c"))
    kept = symbols.filter(~paths.skip_as_orphan(F.col("name"), F.col("kind")))
    out = (kept.join(counts, "name", "left").withColumn("connection_count", F.coalesce("c", F.lit(0)))
           .filter(F.col("connection_count") <= limit))
    out = out.select(F.col("name").alias("symbol"), "file", "connection_count", F.col("kind").alias("symbol_kind"),
                     paths.likely_exported(F.col("kind"), F.col("signature")).alias("is_exported"))
    return _top(out, n, "connection_count", "symbol", "file")


def most_impacting(edges: DataFrame, n: int | None = 10, edge_types=None) -> DataFrame:
    """Symbols by the number of distinct targets they touch."""
    counted = graph.impact_pairs(edges, edge_types).groupBy(F.col("src").alias("symbol")).agg(
        F.count("*").alias("n_targets"))
    return _top(counted, n, F.desc("n_targets"), "symbol")


def refactor_confidence(files: Column, symbols: Column, changes: Column) -> Column:
    value = (F.lit(0.9) - F.least(files, F.lit(10)) * 0.05 - F.least(symbols, F.lit(20)) * 0.02
             - F.least(changes, F.lit(10)) * 0.03)
    return F.greatest(value, F.lit(0.1))


def refactor_impact(edges: DataFrame, symbols: DataFrame, changes: int = 1) -> DataFrame:
    """For all symbols at once: distinct symbols and files within one hop, and a confidence.

    Both distinct counts are taken as distinct rows first, so a hub is counted by
    many tasks. An edge is one row for either direction, only ends that may have
    a file are looked up, and both counts are added up together. A symbol always
    affects itself and its own file, which takes no rows of pairs.
    """
    turned = F.col("src") > F.col("dst")
    pairs = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("u"),
                         F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("v")).distinct()
    placed = symbols.filter(F.col("file").isNotNull())
    low, high = placed.agg(F.min("name"), F.max("name")).first()
    differs = (F.col("u") != F.col("v")).alias("differs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("symbol"), differs), F.struct(F.col("v").alias("symbol"), differs))).alias("p"))
    n_symbols = ends.groupBy("p.symbol").agg(F.count_if("p.differs").alias("others")).select("symbol", "others", F.lit(None).cast("bigint").alias("files"))
    # names of other kinds than those of the symbols are not shuffled; the filter stays above the list, so that both counts read one shuffle of pairs
    inside = lambda end: F.col(end).between(F.lit(low), F.lit(high))
    sides = F.array(F.when(inside("v"), F.struct(F.col("u").alias("symbol"), F.col("v").alias("other"))),
                    F.when(inside("u"), F.struct(F.col("v").alias("symbol"), F.col("u").alias("other"))))
    asked = pairs.select(F.explode(sides).alias("p")).filter("p IS NOT NULL").select("p.*")
    located = (asked.join(placed.select(F.col("name").alias("other"), "file"), "other").select("symbol", "file")
               .unionByName(placed.select(F.col("name").alias("symbol"), "file")))
    n_files = located.distinct().groupBy("symbol").agg(F.count("*").alias("files")).select("symbol", F.lit(None).cast("bigint").alias("others"), "files")
    counts = n_symbols.unionByName(n_files).groupBy("symbol").agg(F.sum("others").alias("others"), F.sum("files").alias("files"))
    out = counts.filter("others IS NOT NULL").select("symbol", (F.col("others") + 1).alias("symbols_affected"), F.coalesce("files", F.lit(0)).alias("files_affected"))
    return out.withColumn("confidence", refactor_confidence(
        F.col("files_affected"), F.col("symbols_affected"), F.lit(changes)))
