"""Roll-ups and documentation tables.

Lists that can grow with the corpus are rows, never one array; arrays are used
only where a file or a fixed top-n bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import paths
from codeloom.functions import text as tx
from codeloom.operators import graph, lines
from codeloom.session import cut_lineage

ROOT = "<root>"
_LONG = "bigint"


def _count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def purpose(n_traits: Column, n_structs: Column, n_functions: Column, n_symbols: Column) -> Column:
    half = F.floor(n_symbols / 2)
    return (F.when(n_traits > 0, rules.PURPOSE_TRAITS)
            .when(n_structs > half, rules.PURPOSE_STRUCTS)
            .when(n_functions > half, rules.PURPOSE_FUNCTIONS)
            .otherwise(rules.PURPOSE_MIXED))


def _zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def symbols_per_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path").agg(
        F.count("*").alias("symbol_count"), _count_if(F.col("kind") == "trait").alias("n_traits"),
        _count_if(F.col("kind") == "struct").alias("n_structs"),
        _count_if(F.col("kind") == "function").alias("n_functions"))


def module_rollup(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per directory: files, symbols, lines, purpose. Symbols are counted per file before the join."""
    per_file = files.select("path", F.coalesce("module", F.lit(ROOT)).alias("module"),
                            F.size(tx.lines(F.col("content"))).alias("n_lines"))
    rolled = (per_file.join(symbols_per_file(symbols), "path", "left").groupBy("module")
              .agg(F.count("*").alias("file_count"), F.sum(_zero("symbol_count")).alias("symbol_count"),
                   F.sum("n_lines").alias("line_count"), F.sum(_zero("n_traits")).alias("t"),
                   F.sum(_zero("n_structs")).alias("s"), F.sum(_zero("n_functions")).alias("f")))
    why = purpose(F.col("t"), F.col("s"), F.col("f"), F.col("symbol_count"))
    return rolled.select("module", "file_count", "symbol_count", "line_count", why.alias("purpose")).withColumn(
        "description", F.format_string(rules.MODULE_DESCRIPTION, "module", "file_count", "purpose", "symbol_count"))


def module_exports(files: DataFrame, symbols: DataFrame, n: int = 10) -> DataFrame:
    """First n public symbols of each module as (module, rank, export)."""
    public = symbols.filter(F.col("visibility") == "pub").select(
        F.coalesce(paths.parent_module(F.col("path")), F.lit(ROOT)).alias("module"), "path", "start", "name",
        F.concat("kind", F.lit("::"), "name").alias("export"))
    first = Window.partitionBy("module").orderBy("path", "start", "name")
    return (public.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
            .select("module", "rank", "export"))


def submodules(files: DataFrame) -> DataFrame:
    """Direct child directories of each module: (module, submodule). A ``/`` boundary is required."""
    modules = files.filter(F.col("module").isNotNull()).select("module").distinct()
    parts = F.split("module", "/")
    depth = F.size("parts")
    pairs = modules.select("module", parts.alias("parts")).filter(depth > 1).select(
        F.explode(F.transform(
            F.sequence(F.lit(1), depth - 1),
            lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), "/").alias("module"),
                               F.try_element_at("parts", i + 1).alias("submodule")))).alias("p")).select("p.*").distinct()
    return pairs.join(modules, "module", "left_semi")


def edge_counts(symbols: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges a file owns: symbol to chunk, and symbol to symbol by parent, member and trait."""
    has_parent = F.col("parent").isNotNull()
    own = (has_parent.cast("int") + (has_parent & F.col("kind").isin("field", "variant")).cast("int")
           + ((F.col("kind") == "impl") & F.col("trait_impl").isNotNull()).cast("int"))
    both = (symbols.select("path", own.cast(_LONG).alias("n"))
            .unionByName(placed.select("path", F.lit(1).cast(_LONG).alias("n"))))
    return both.groupBy("path").agg(F.sum("n").alias("edge_count"))


def complexity(n_symbols: Column, n_chunks: Column, n_edges: Column) -> Column:
    return (n_symbols * 0.4 + n_chunks * 0.3 + n_edges * 0.3) / 10


def kind_breakdown(symbols: DataFrame) -> DataFrame:
    """Per file a text of counts by kind, kinds in alphabetical order (at most one entry per kind)."""
    counted = symbols.groupBy("path", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda s: F.concat(s["n"], F.lit(" "), s["kind"])), ", ")
        .alias("breakdown"))


def file_summaries(files: DataFrame, symbols: DataFrame, chunks: DataFrame, placed: DataFrame) -> DataFrame:
    stats = lines.document_line_stats(files)
    n_chunks = chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))
    # names of one file, in file order
    listed = symbols.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "name", "kind"))),
                    lambda s: F.concat(s["kind"], F.lit("::"), s["name"])).alias("symbols"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("visibility") == "pub", F.struct("start", "name")))),
                    lambda s: s["name"]).alias("exports"),
        F.count("*").alias("symbol_count"))
    none = F.array().cast("array<string>")
    trimmed = F.transform(tx.lines(F.col("content")), tx.trim)
    imported = F.slice(F.filter(trimmed, lambda l: l.startswith("use ") | l.startswith("import ")), 1,
                       lines.IMPORT_LIMIT)
    out = (files.select("path", F.col("ext").alias("language"), imported.alias("imports"))
           .join(stats, "path").join(n_chunks, "path", "left").join(listed, "path", "left")
           .join(edge_counts(symbols, placed), "path", "left").join(kind_breakdown(symbols), "path", "left"))
    n = _zero("symbol_count")
    return out.select(
        "path", "language", F.col("total").alias("lines_total"), F.col("code").alias("lines_code"),
        F.col("comment").alias("lines_comment"), F.col("blank").alias("lines_blank"),
        F.coalesce("symbols", none).alias("symbols"), "imports", F.coalesce("exports", none).alias("exports"),
        complexity(n, _zero("chunk_count"), _zero("edge_count")).alias("complexity_score"),
        F.format_string("File '%s' with %d symbols: %s", "path", n, F.coalesce("breakdown", F.lit("")))
        .alias("description"))


def kind_rollup(symbols: DataFrame) -> DataFrame:
    """Counts per (path, kind), per path and over all, by one rollup."""
    return symbols.rollup("path", "kind").agg(F.count("*").alias("n_symbols"))


def kind_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n_symbols"))


# --- structs and functions ----------------------------------------------------
def struct_members(symbols: DataFrame) -> DataFrame:
    """Fields, methods and trait impls of every struct: (path, struct, role, member).

    Impl names contain the struct's name as a word: the words of each impl are
    exploded and joined by equality within the file. Symbols are written once, so
    that the three branches do not derive them again.
    """
    symbols = cut_lineage(symbols.select("path", "kind", "name", "parent", "trait_impl"))
    structs = symbols.filter(F.col("kind") == "struct").select("path", F.col("name").alias("struct")).distinct()
    by_parent = symbols.filter(F.col("kind").isin("field", "function") & F.col("parent").isNotNull()).select(
        "path", F.col("parent").alias("struct"),
        F.when(F.col("kind") == "field", "field").otherwise("method").alias("role"), F.col("name").alias("member"))
    impls = symbols.filter((F.col("kind") == "impl") & F.col("trait_impl").isNotNull()).select(
        "path", F.explode(F.array_distinct(tx.words(F.col("name")))).alias("struct"), F.lit("trait").alias("role"),
        F.col("trait_impl").alias("member"))
    return by_parent.unionByName(impls).join(structs, ["path", "struct"], "left_semi")


def struct_docs(symbols: DataFrame) -> DataFrame:
    members = struct_members(symbols).groupBy("path", F.col("struct").alias("name")).agg(
        _count_if(F.col("role") == "field").alias("field_count"),
        _count_if(F.col("role") == "method").alias("method_count"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "trait", F.col("member")))).alias("traits"))
    structs = symbols.filter(F.col("kind") == "struct").select(
        "path", "name", "docs", F.coalesce("visibility", F.lit("private")).alias("visibility"),
        F.filter("attributes", lambda a: a.contains("derive")).alias("derives"))
    out = structs.join(members, ["path", "name"], "left")
    text = F.format_string("Struct '%s' with %d field(s) and %d method(s)", "name", _zero("field_count"),
                           _zero("method_count"))
    return out.select("path", "name", F.coalesce("docs", text).alias("description"), "visibility",
                      _zero("field_count").alias("field_count"), _zero("method_count").alias("method_count"),
                      F.coalesce("traits", F.array().cast("array<string>")).alias("traits_implemented"), "derives")


def function_complexity(n_parameters: Column, n_calls: Column) -> Column:
    score = n_parameters + n_calls * 2
    return F.when(score < 5, "Low").when(score < 15, "Medium").otherwise("High")


def function_docs(symbols: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row per function; ``calls`` (path, name, callee) fills the call counts if given."""
    rows = symbols.filter(F.col("kind") == "function")
    if calls is None:
        rows = rows.withColumn("n_calls", F.lit(0).cast(_LONG))
    else:
        counted = calls.distinct().groupBy("path", "name").agg(F.count("*").alias("c"))
        rows = rows.join(counted, ["path", "name"], "left").withColumn("n_calls", _zero("c"))
    n = F.coalesce(F.size("parameters"), F.lit(0))
    n = F.when(F.col("parameters").isNull(), F.lit(0)).otherwise(n)
    return rows.select(
        "path", "name",
        F.coalesce("docs", F.format_string(rules.FUNCTION_DESCRIPTION, "name", n)).alias("description"),
        tx.full_signature(F.col("name"), F.col("visibility"), F.col("modifiers"), F.col("generics"),
                          F.col("parameters"), F.col("return_type")).alias("signature"),
        n.cast(_LONG).alias("parameter_count"), F.coalesce("return_type", F.lit("()")).alias("return_type"),
        F.coalesce("visibility", F.lit("private")).alias("visibility"),
        F.array_contains("modifiers", "async").alias("is_async"),
        F.array_contains("modifiers", "unsafe").alias("is_unsafe"), "n_calls",
        function_complexity(n, F.col("n_calls")).alias("complexity_estimate"))


# --- corpus level -------------------------------------------------------------
def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("ext").alias("language")).agg(F.count("*").alias("n_files"))


def module_hierarchy(files: DataFrame) -> DataFrame:
    """Distinct modules in order, one per row."""
    return files.filter(F.col("module").isNotNull()).select("module").distinct().orderBy("module")


def overview(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: totals, style and detected patterns."""
    f = files.agg(F.count("*").alias("total_files"),
                  F.coalesce(F.sum(F.size(tx.lines(F.col("content")))), F.lit(0)).alias("total_lines"))
    s = symbols.agg(F.struct(
        F.count("*").alias("n"), F.bool_or(F.col("kind") == "trait").alias("traits"),
        F.bool_or(F.lower("name").contains("builder")).alias("builders"),
        F.bool_or(F.col("kind") == "mod").alias("mods")).alias("s"))
    one = f.withColumn("s", s.scalar())
    patterns = F.filter(F.array(F.when(F.col("s.traits"), rules.PATTERN_TRAITS),
                                F.when(F.col("s.builders"), rules.PATTERN_BUILDER)), lambda p: p.isNotNull())
    return one.select("total_files", F.col("s.n").alias("total_symbols"), "total_lines", patterns.alias("design_patterns"),
                      F.when(F.col("s.mods"), rules.STYLE_MODULAR).otherwise(rules.STYLE_FLAT)
                      .alias("architectural_style"))


def core_components(edges: DataFrame, n: int = 5) -> DataFrame:
    return (graph.degrees(edges).select(F.col("node").alias("name"), F.col("total").alias("interaction_count"))
            .orderBy(F.desc("interaction_count"), "name").limit(n))


def internal_dependencies(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(rules.FILE_TO_FILE, rules.SYMBOL_TO_SYMBOL))


def circular_dependencies(edges: DataFrame, n: int | None = 5) -> DataFrame:
    """Two-node cycles; the first n in order, all with ``n=None``."""
    found = graph.mutual_edges(internal_dependencies(edges)).select("src", "dst", F.lit("Low").alias("severity"))
    return found if n is None else found.orderBy("src", "dst").limit(n)


def dependency_popularity(edges: DataFrame, n: int = 10) -> DataFrame:
    counted = internal_dependencies(edges).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("dependents"))
    return counted.orderBy(F.desc("dependents"), "name").limit(n)


def dependency_overview(edges: DataFrame) -> DataFrame:
    """One row of counts and their text; external dependencies are not recorded and count 0."""
    internal = internal_dependencies(edges).agg(F.count("*").alias("internal"))
    circular = circular_dependencies(edges, n=None).agg(F.count("*"))
    one = internal.select("internal", F.lit(0).cast(_LONG).alias("external"), circular.scalar().alias("circular"))
    return one.withColumn("summary", F.format_string(rules.DEPENDENCY_SUMMARY, "internal", "external", "circular"))


def least_coupled(files: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """Files with the fewest own edges; files without any count 0."""
    return (files.select("path").join(counts, "path", "left").select("path", _zero("edge_count").alias("edge_count"))
            .orderBy("edge_count", "path").limit(n))


def cluster_summaries(symbols: DataFrame, cluster: Column | None = None, n: int = 5) -> DataFrame:
    """Per cluster: size, topic and the first n names; by kind unless a cluster column is given."""
    key = F.concat(F.lit("cluster_"), F.col("kind")) if cluster is None else cluster
    rows = symbols.select(key.alias("cluster_id"), "name")
    low = F.lower("name")
    rank = F.lit(len(rules.TOPICS))
    for i, (_, term) in reversed(list(enumerate(rules.TOPICS))):
        rank = F.when(low.contains(term), i).otherwise(rank)
    totals = rows.groupBy("cluster_id").agg(F.count("*").alias("symbol_count"), F.min(rank).alias("r"))
    first = Window.partitionBy("cluster_id").orderBy("name")
    shown = (rows.distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= n)
             .groupBy("cluster_id").agg(F.array_sort(F.collect_list("name")).alias("representative_symbols")))
    topic = F.lit(rules.DEFAULT_TOPIC)
    for i, (title, _) in enumerate(rules.TOPICS):
        topic = F.when(F.col("r") == i, title).otherwise(topic)
    return totals.join(shown, "cluster_id").select(
        "cluster_id", topic.alias("topic_label"), "symbol_count", "representative_symbols",
        F.format_string(rules.CLUSTER_DESCRIPTION, "symbol_count").alias("description"))


def processing_report(files: DataFrame, chunks: DataFrame, symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks, symbols, embeddings and code lines of every file."""
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    return (lines.line_stats(files).select("path", F.col("total").alias("n_lines"), F.col("code").alias("loc"))
            .join(count(chunks, "n_chunks"), "path", "left").join(count(symbols, "n_symbols"), "path", "left")
            .join(count(embeddings, "n_embeddings"), "path", "left").fillna(0, ["n_chunks", "n_symbols", "n_embeddings"]))
