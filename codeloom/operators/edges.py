"""Containment joins and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.ordered import shift_value

BYTES_PER_BIN = 4096


def containment(symbols: DataFrame, chunks: DataFrame, bin_size: int = BYTES_PER_BIN) -> DataFrame:
    """Symbols inside chunks of the same file: start and end both within the chunk.

    Chunks are spread over the bins they cover and a symbol looks only into the
    bin of its start, so a very large file is many small equi-join groups and
    every match is found once.
    """
    ranged = chunks.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))
    right = ranged.select("path", F.explode(bins).alias("bin"), "chunk_ord", "chunk_id",
                          F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    left = symbols.filter(F.col("start").isNotNull()).select(
        "path", "name", "start", "end", F.floor(F.col("start") / bin_size).alias("bin"))
    hit = (F.col("start") >= F.col("c_start")) & (F.col("end") <= F.col("c_end"))
    return (left.join(right, ["path", "bin"]).filter(hit)
            .select("path", "name", "start", "end", "chunk_ord", "chunk_id"))


def containing_symbols(placed: DataFrame) -> DataFrame:
    """Symbol names per chunk, in file order; bounded by one file."""
    return placed.groupBy("path", "chunk_ord", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda s: s["name"])
        .alias("containing_symbols"))


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit(":"), name)


def chunk_key(path: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit("chunk:"), path, F.lit(":"), chunk_id)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def _edge(df: DataFrame, src: Column, dst: Column, edge_type: str, score: Column | None = None) -> DataFrame:
    score = F.lit(None) if score is None else score
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("edge_type"),
                     score.cast("double").alias("score"))


def symbol_chunk_edges(placed: DataFrame) -> DataFrame:
    return _edge(placed, symbol_id(F.col("path"), F.col("name")), chunk_key(F.col("path"), F.col("chunk_id")),
                 rules.SYMBOL_TO_CHUNK)


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """Child to parent, parent to field and variant, impl to its trait."""
    path = F.col("path")
    own, parent = symbol_id(path, F.col("name")), symbol_id(path, F.col("parent"))
    has_parent, is_impl = F.col("parent").isNotNull(), (F.col("kind") == "impl") & F.col("trait_impl").isNotNull()
    edge = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    # in one pass, so that symbols are derived once
    found = F.array(F.when(has_parent, edge(own, parent)),
                    F.when(has_parent & F.col("kind").isin("field", "variant"), edge(parent, own)),
                    F.when(is_impl, edge(own, symbol_id(path, F.col("trait_impl")))))
    rows = symbols.select(F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"))
    return _edge(rows, F.col("e.src"), F.col("e.dst"), rules.SYMBOL_TO_SYMBOL)


def file_edges(files: DataFrame) -> DataFrame:
    rows = files.filter(F.col("module").isNotNull())
    return _edge(rows, F.col("module"), file_id(F.col("path")), rules.FILE_TO_FILE)


def sequential_edges(chunks: DataFrame, keys=("path",), order: str = "chunk_ord") -> DataFrame:
    """Each chunk to the next of its file; one hot file is split by ranges of the ordinal."""
    rows = shift_value(chunks, list(keys), order, F.col("chunk_id"), "next_id").filter(F.col("next_id").isNotNull())
    path = F.concat_ws("/", *keys)
    return _edge(rows, chunk_key(path, F.col("chunk_id")), chunk_key(path, F.col("next_id")), rules.CHUNK_TO_CHUNK)


def similarity_edges(pairs: DataFrame, edge_type: str = rules.SYMBOL_SIMILARITY) -> DataFrame:
    return _edge(pairs, F.col("src"), F.col("dst"), edge_type, F.col("score"))


def nodes(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """File, symbol and chunk nodes under one id scheme shared with the edges."""
    path = F.col("path")
    empty = F.create_map().cast("map<string,string>")
    file_nodes = files.select(file_id(path).alias("id"), F.lit("file").alias("node_type"), path.alias("name"),
                              F.create_map(F.lit("type"), F.lit("file")).alias("metadata"))
    facts = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("kind").alias("key"), F.col("kind").alias("value")),
        F.struct(F.lit("visibility").alias("key"), F.col("visibility").alias("value"))),
        lambda e: e["value"].isNotNull()))
    symbol_nodes = symbols.select(symbol_id(path, F.col("name")).alias("id"), F.lit("symbol").alias("node_type"),
                                  "name", facts.alias("metadata"))
    chunk_nodes = chunks.select(chunk_key(path, F.col("chunk_id")).alias("id"), F.lit("chunk").alias("node_type"),
                                F.col("chunk_id").alias("name"), empty.alias("metadata"))
    return file_nodes.unionByName(symbol_nodes).unionByName(chunk_nodes)


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each ordered pair once, loops left out."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter(F.col("src") != F.col("dst")).distinct()
