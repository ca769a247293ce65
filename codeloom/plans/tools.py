"""Questions a client can ask of a loaded pack, one function per tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import text as tx
from codeloom.operators import communities, docs, edges, embedding, files as fo, graph, hotspots, mentions, search
from codeloom.sources import tree
from codeloom.sources.pack import KnowledgePack


class PackTools:
    """Tools over a pack; every call returns a lazy DataFrame."""

    def __init__(self, pack: KnowledgePack):
        self.pack = pack
        self.spark = pack.files.sparkSession
        has_communities = "communities" in pack.tables
        self.table = search.symbol_table(pack.symbols, communities.community_of_symbols(
            pack.communities, pack.community_members) if has_communities else None)

    def _ids(self, name: str) -> DataFrame:
        rows = self.pack.symbols.filter(F.col("name") == name)
        return rows.select(edges.symbol_id(F.col("path"), F.col("name")).alias("source")).distinct()

    # symbols
    def search_symbols(self, query: str, limit: int = 20, subsystem=None, kind=None) -> DataFrame:
        return search.keyword_search(self.table, query, limit, subsystem, kind)

    def search_by_signature(self, query: str, limit: int = 20, subsystem=None, kind=None) -> DataFrame:
        return search.signature_search(self.table, query, limit, subsystem, kind)

    def semantic_search(self, query: str, limit: int = 20) -> DataFrame:
        return self.ask(query, limit)["symbols"]

    def get_symbol(self, name: str) -> DataFrame:
        return search.get_symbol(self.table, name)

    def list_symbols(self, pattern: str | None = None, limit: int = 100) -> DataFrame:
        return search.list_symbols(self.table, pattern, limit)

    def get_symbol_content(self, name: str) -> DataFrame:
        return search.symbol_sources(search.get_symbol(self.table, name), self.pack.files)

    def get_symbol_examples(self, name: str, limit: int = 5) -> DataFrame:
        names = self.spark.createDataFrame([(name,)], "name string")
        return mentions.usage_examples(self.pack.chunks, names, min(limit, mentions.EXAMPLES_PER_SYMBOL))

    # graph
    def get_impact(self, name: str, max_depth: int = 5, edge_types=(rules.SYMBOL_TO_SYMBOL,)) -> DataFrame:
        return graph.reachable(self.pack.edges, self._ids(name), max_depth, edge_types)

    def get_dependencies(self, name: str, max_depth: int = 5, edge_types=(rules.CALLS, rules.IMPORTS, rules.USES)) -> DataFrame:
        return graph.reachable(self.pack.edges, self._ids(name), max_depth, edge_types)

    def find_path(self, source: str, target: str, max_depth: int = 10) -> DataFrame:
        """Shortest path between two node ids."""
        pair = self.spark.createDataFrame([(source, target)], "source string, target string")
        return graph.shortest_paths(self.pack.edges, pair, max_depth)

    def get_related(self, name: str) -> DataFrame:
        wanted = self._ids(name).withColumnRenamed("source", "node")
        return search.related_symbols(self.pack.edges).join(wanted, "node", "left_semi")

    # communities
    def list_subsystems(self, name: str | None = None, min_confidence: float = 0.0) -> DataFrame:
        return communities.list_communities(self.pack.communities, name, min_confidence)

    def get_subsystem(self, name: str) -> DataFrame:
        return communities.community_detail(self.pack.communities, self.pack.community_members, self.table, name)

    # navigation
    def get_quickstart(self) -> DataFrame:
        return search.quickstart(self.table, self.pack.edges, communities.role_map(self.pack.communities),
                                 [rules.SYMBOL_TO_SYMBOL])

    def get_task_view(self, task: str, context: str | None = None) -> DataFrame:
        return search.task_view(search.task_views(self.table, self.pack.files), self.table, task, context)

    def read_file(self, path: str) -> DataFrame:
        return self.pack.files.filter(F.col("path") == path)

    def read_chunk(self, path: str, chunk_id: str) -> DataFrame:
        return self.pack.chunks.filter((F.col("path") == path) & (F.col("chunk_id") == chunk_id))

    def list_files(self) -> DataFrame:
        return tree.file_structure(self.pack.files)

    # changes
    def check_patches(self, patches: DataFrame) -> DataFrame:
        """Statistics of (patch_id, patch) rows; nothing is applied."""
        return fo.patch_statistics(patches)

    def validate(self) -> DataFrame:
        return fo.validate(self.pack.files)

    def propose_refactor(self, name: str, changes: int = 1) -> DataFrame:
        ids = self.pack.symbols.select(edges.symbol_id(F.col("path"), F.col("name")).alias("name"),
                                       F.col("path").alias("file"))
        wanted = self._ids(name).withColumnRenamed("source", "symbol")
        return hotspots.refactor_impact(self.pack.edges, ids.distinct(), changes).join(wanted, "symbol", "left_semi")

    def analyze_hotspots(self, changes: DataFrame | None = None, n: int = 10) -> dict[str, DataFrame]:
        p = self.pack
        ids = self.table.select(edges.symbol_id(F.col("file"), F.col("name")).alias("name"), "kind", "file", "signature")
        placed = p.symbol_chunks
        out = {
            "most_connected": hotspots.most_connected(p.edges, ids.select("name", "file").distinct(), n),
            "complexity_bombs": hotspots.complexity_bombs(
                docs.file_summaries(p.files, p.symbols, p.chunks, placed), docs.function_docs(p.symbols), n),
            # nearest neighbours exist for every symbol, so they say nothing on being unused
            "orphans": hotspots.orphans(ids, p.edges.filter(~F.col("edge_type").startswith("semantic_")), n),
        }
        if changes is not None:
            out["most_modified"] = hotspots.most_modified(changes, n)
        return out

    # questions
    def ask(self, question: str, limit: int = 10, embed=embedding.hashing_embedding) -> dict[str, DataFrame]:
        asked = self.spark.createDataFrame([("q", question)], "question_id string, text string")
        vector = embed(asked, "text", ["question_id"])
        p = self.pack
        chunks = p.chunks.join(p.embeddings, ["path", "chunk_ord"]).select(
            edges.chunk_key(F.col("path"), F.col("chunk_id")).alias("chunk_key"), F.col("path").alias("file"), "text",
            "embedding")
        return search.answer_questions(vector, chunks, self.table, limit)

    def ask_by_keyword(self, question: str, limit: int = 10) -> DataFrame:
        return search.answer_by_keyword(self.table, question, limit)

    def prompts(self) -> DataFrame:
        return search.prompt_rows(self.table, search.symbol_sources(self.table, self.pack.files))

    @staticmethod
    def clean_responses(responses: DataFrame, column: str = "response") -> DataFrame:
        return responses.withColumn(column, tx.clean_response(F.col(column)))
