"""Table layouts of a knowledge pack."""

from __future__ import annotations

from pyspark.sql import types as T

_PARAM = "array<struct<name:string,type:string>>"

FILES = "path string, content string, kind string, ext string, module string"
CHUNKS = "path string, chunk_ord bigint, chunk_id string, start bigint, end bigint, text string"
SYMBOLS = (
    "path string, name string, kind string, start bigint, end bigint, start_row bigint, "
    "end_row bigint, parent string, docs string, visibility string, "
    f"parameters {_PARAM}, return_type string, generics string, trait_impl string, "
    "field_type string, attributes array<string>, is_mutable boolean, modifiers array<string>"
)
EMBEDDINGS = "path string, chunk_ord bigint, embedding array<float>"
EDGES = "src string, dst string, edge_type string, score double"
NODES = "id string, node_type string, name string, metadata map<string,string>"
SYMBOL_CHUNKS = "path string, name string, start bigint, chunk_ord bigint, chunk_id string"
FILE_HASHES = "path string, sha256 string"
COMMUNITIES = ("community string, name string, n_symbols bigint, n_files bigint, confidence double, role string, "
               "summary string")
COMMUNITY_MEMBERS = "community string, symbol string, file string"

PACK_TABLES = {
    "files": FILES,
    "chunks": CHUNKS,
    "symbols": SYMBOLS,
    "embeddings": EMBEDDINGS,
    "edges": EDGES,
    "nodes": NODES,
    "symbol_chunks": SYMBOL_CHUNKS,
    "file_hashes": FILE_HASHES,
    "communities": COMMUNITIES,
    "community_members": COMMUNITY_MEMBERS,
}
# a pack may be built without these
OPTIONAL_TABLES = ("communities", "community_members")
DOCUMENTATION_TABLES = ("doc_modules", "doc_files", "doc_structs", "doc_functions", "doc_overview", "doc_dependencies", "doc_clusters")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
