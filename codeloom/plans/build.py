"""The whole build: a source tree to a knowledge pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import vectors as vx
from codeloom.operators import (
    chunking, communities, definitions, dependencies, docs as documentation, edges, embedding, files as fo, graph, similarity)
from codeloom.session import cut_lineage
from codeloom.sources.pack import KnowledgePack
from codeloom.streaming import refresh

SIMILARITY_THRESHOLD = 0.5
CHUNK_NEIGHBOURS, CHUNK_SCORE, SYMBOL_NEIGHBOURS = 5, 0.7, 3
CLUSTER_EPS, CLUSTER_POINTS = 0.3, 3
FILE_TABLES = ("files", "chunks", "symbols", "embeddings")


def chunk_files(files: DataFrame, symbols: DataFrame, all_extractions: bool = False) -> DataFrame:
    """Chunks by the plan of each file's kind."""
    is_rust = F.col("path").endswith(".rs")
    code = files.filter(F.col("kind") == "SourceCode")
    docs = fo.plan_files(files.filter(F.col("kind") == "Documentation"))
    rest = files.filter(F.col("kind").isin("Config", "Other"))
    return (definitions.definition_chunks(code.filter(is_rust), symbols)
            .unionByName(chunking.by_paragraph(code.filter(~is_rust)))
            .unionByName(chunking.documentation_chunks(docs, all_extractions))
            .unionByName(chunking.whole(rest)))


def file_tables(files: DataFrame, embed=embedding.hashing_embedding) -> dict[str, DataFrame]:
    """The tables whose rows depend on their own file only, from scan output (path, content, kind, ext, module).

    A refresh derives them for the files of a batch; ``assemble_pack`` makes the rest from them.
    """
    # the raw tree is read once
    files = cut_lineage(fo.keep_processable(files))
    symbols = cut_lineage(definitions.definitions(files))
    chunks = cut_lineage(chunk_files(files, symbols))
    embedded = chunks.join(files.filter(F.col("kind").isin("SourceCode", "Documentation")).select("path"), "path", "left_semi")
    vectors = cut_lineage(embed(embedded, "text", ["path", "chunk_ord"]))
    return {"files": files, "chunks": chunks, "symbols": symbols, "embeddings": vectors}


def build_pack(files: DataFrame, threshold: float = SIMILARITY_THRESHOLD, with_communities: bool = True,
               embed=embedding.hashing_embedding) -> KnowledgePack:
    """Scan output (path, content, kind, ext, module) -> all pack tables."""
    return assemble_pack(file_tables(files, embed), threshold, with_communities)


def refreshed_pack(spark: SparkSession, folder: str, **options) -> KnowledgePack:
    """The pack of the file tables that a refresh keeps in ``folder``; what spans files is made anew from the current rows."""
    return assemble_pack({name: refresh.read_current(spark, folder, name) for name in FILE_TABLES}, **options)


def assemble_pack(tables: dict[str, DataFrame], threshold: float = SIMILARITY_THRESHOLD, with_communities: bool = True) -> KnowledgePack:
    """All pack tables from the file tables."""
    files, chunks, symbols, vectors = (tables[name] for name in FILE_TABLES)
    placed = edges.containment(symbols, chunks)
    containing = chunks.select("path", "chunk_ord", "chunk_id").join(
        edges.containing_symbols(placed).drop("chunk_id"), ["path", "chunk_ord"], "left")
    graph_edges = (edges.symbol_chunk_edges(placed).unionByName(edges.symbol_edges(symbols))
                   .unionByName(edges.file_edges(files)).unionByName(edges.sequential_edges(chunks)))
    keyed = cut_lineage(vectors.join(chunks.select("path", "chunk_ord", "chunk_id"), ["path", "chunk_ord"]).select(
        edges.chunk_key(F.col("path"), F.col("chunk_id")).alias("vec_id"), "path", "chunk_ord", "embedding"))
    placed = cut_lineage(placed)
    meaning = semantic_edges(keyed, placed)
    nodes = clustered_nodes(edges.nodes(files, symbols, chunks), keyed, placed)
    tables = {"files": files, "chunks": chunks, "symbols": symbols, "embeddings": vectors,
              "symbol_chunks": placed.select("path", "name", "start", "chunk_ord", "chunk_id"),
              "file_hashes": fo.content_hashes(files), "nodes": nodes}
    tables.update(documentation_tables(files, symbols, chunks, placed, graph_edges))
    graph_edges = graph_edges.unionByName(meaning).unionByName(cut_lineage(dependencies.dependency_edges(files, symbols)))
    if with_communities:
        # equal chunks (license headers, say) are one node of the similarity graph and hang on the first of them by one edge each
        classes = cut_lineage(similarity.distinct_vectors(keyed, "vec_id", "embedding"))
        pairs = cut_lineage(similarity.similar_pairs(classes, threshold, vec_id="id"))
        copies = cut_lineage(similarity.copy_members(keyed, classes, "vec_id", "embedding"))
        own = classes.select("id", F.round(vx.dot(F.col("embedding"), F.col("embedding")), similarity.SCORE_DIGITS).alias("score"))
        hanging = copies.filter(F.col("member") != F.col("id")).join(own.filter(F.col("score") >= threshold), "id")
        graph_edges = graph_edges.unionByName(edges.similarity_edges(pairs.unionByName(
            hanging.select(F.col("id").alias("src"), F.col("member").alias("dst"), "score"))))
        found = graph.class_communities(graph.class_links(pairs, classes, threshold))
        grouped = copies.join(found, copies["id"] == found["node"]).select("member", "community")
        # chunks without a similar partner are communities of their own
        member = keyed.join(grouped, keyed["vec_id"] == grouped["member"], "left").select(
            "path", "chunk_ord", F.coalesce("community", "vec_id").alias("community"))
        member = cut_lineage(member)
        tables.update(describe_communities(chunks, containing, vectors, member))
    tables["edges"] = graph_edges
    return KnowledgePack(tables)


def semantic_edges(keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """Nearest chunks of chunks, and nearest symbols and chunks of symbols; a symbol's vector is the mean of its chunks'."""
    vectors = cut_lineage(symbol_vectors(keyed, placed))
    chunk_links = similarity.top_k(keyed, keyed, CHUNK_NEIGHBOURS, mode="full", min_score=CHUNK_SCORE)
    symbol_links = similarity.top_k(vectors, vectors, SYMBOL_NEIGHBOURS, query_id="symbol", base_id="symbol", vector="centroid", mode="full")
    mixed = similarity.top_k(vectors, keyed, SYMBOL_NEIGHBOURS, query_id="symbol", query_vector="centroid")
    return cut_lineage(edges.similarity_edges(chunk_links, rules.SEMANTIC_CHUNK)
                       .unionByName(edges.similarity_edges(symbol_links, rules.SEMANTIC_SYMBOL))
                       .unionByName(edges.similarity_edges(mixed, rules.SEMANTIC_SYMBOL_CHUNK)))


def symbol_vectors(keyed: DataFrame, placed: DataFrame) -> DataFrame:
    rows = placed.select("path", "name", "chunk_ord").distinct().join(keyed, ["path", "chunk_ord"]).select(
        edges.symbol_id(F.col("path"), F.col("name")).alias("symbol"), "embedding")
    return embedding.group_centroids(rows, ["symbol"], unit=True)


def clustered_nodes(nodes: DataFrame, keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes with their density cluster: of chunks, and of symbols the most frequent one of their chunks with its share."""
    reps = cut_lineage(similarity.distinct_vectors(keyed, "vec_id", "embedding"))
    clusters = graph.vector_clusters(reps, CLUSTER_EPS, CLUSTER_POINTS)
    members = similarity.copy_members(keyed, reps, "vec_id", "embedding")
    of_chunks = cut_lineage(members.join(clusters, "id").filter(F.col("cluster").isNotNull()).select(F.col("member").alias("id"), "cluster"))
    inside = placed.select(edges.symbol_id(F.col("path"), F.col("name")).alias("symbol"),
                           edges.chunk_key(F.col("path"), F.col("chunk_id")).alias("id")).join(of_chunks, "id")
    of_symbols = communities.majority_cluster(inside)
    found = of_chunks.select("id", "cluster", F.lit(1.0).alias("confidence")).unionByName(
        of_symbols.select(F.col("symbol").alias("id"), "cluster", "confidence"))
    facts = F.map_from_arrays(F.array(F.lit("cluster"), F.lit("cluster_confidence")), F.array("cluster", F.col("confidence").cast("string")))
    return nodes.join(found, "id", "left").select(
        "id", "node_type", "name", F.when(F.col("cluster").isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", facts)).alias("metadata"))


def documentation_tables(files, symbols, chunks, placed, graph_edges) -> dict[str, DataFrame]:
    return {"doc_modules": documentation.module_rollup(files, symbols), "doc_files": documentation.file_summaries(files, symbols, chunks, placed),
            "doc_structs": documentation.struct_docs(symbols), "doc_functions": documentation.function_docs(symbols),
            "doc_overview": documentation.overview(files, symbols), "doc_dependencies": documentation.dependency_overview(graph_edges),
            "doc_clusters": documentation.cluster_summaries(symbols)}


def describe_communities(chunks, containing, vectors, member) -> dict[str, DataFrame]:
    keys = ["path", "chunk_ord"]
    rows = communities.members(member, containing)
    cohesion = embedding.cohesion(vectors.join(member, keys), ["community"]).select("community", "cohesion")
    central = communities.central_chunks(vectors, member, keys)
    texts = chunks.join(containing.select(*keys, "containing_symbols"), keys, "left")
    phrases = communities.candidate_phrases(texts, keys, communities.comment_texts(chunks, keys))
    by_text = communities.pick_labels(communities.phrase_scores(phrases, central, keys))
    by_name = communities.fallback_labels(
        rows.filter(F.col("symbol").isNotNull()).select("community", "symbol").distinct())
    labels = by_name.withColumnRenamed("label", "other").join(by_text, "community", "full_outer").select(
        "community", F.coalesce("label", "other").alias("label"))
    described = communities.describe(communities.assemble(rows).join(cohesion, "community", "left"), rows, labels)
    return {"communities": described, "community_members": rows}
