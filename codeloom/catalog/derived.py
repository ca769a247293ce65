"""Tables that queries derive from the given ones.

The given tables hold no source code, so a source tree is rendered from whole
tables: one file per row, by expressions that read the same in Spark SQL and in
the check's SQL. Work on them grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from codeloom.sources import tree

# --- one Rust file per part ---------------------------------------------------
_K = "CAST(p_partkey AS STRING)"
CODE_PATH = (f"'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || "
             f"CASE WHEN p_size > 45 THEN '/tests' ELSE '' END || '/part_' || {_K} || '.rs'")


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines) + " || chr(10)"


_HEAD = _text("'//! ' || p_name", "'use std::fmt::Debug;'", "''", "'/// A ' || p_name", "'/// in stock'",
              "'#[derive(Debug, Clone)]'", f"'pub struct Part{{k}} {{'", "'    pub size: i32,'", "'    price: f64,'",
              "'}'")
_ENUM = _text("'pub enum Grade{k} {'", "'    Low,'", "'    High(i32),'", "'}'")
_TRAIT = _text("'/* price'", "'   rules */'", "'pub trait Priced{k} {'", "'    fn price(&self) -> f64;'", "'}'",
               "'impl Priced{k} for Part{k} {'", "'    fn price(&self) -> f64 {'", "'        self.price // { as is'",
               "'    }'", "'}'")
_IMPL = _text("'impl Part{k} {'", "'    /// Builds a ' || p_name",
              "'    pub async fn make_{k}(size: i32, price: f64) -> Part{k} {'", "'        Part{k} { size, price }'",
              "'    }'", "'}'")
_FREE = _text("''", "'pub fn search_{k}<T: Clone>(items: Vec<T>, names: HashMap<String, i32>) -> usize {'",
              "'    items.len() /* size */'", "'}'")
_TAIL = _text("'pub const MAX_{k}: i32 = ' || CAST(p_size AS STRING) || ';'", "'static mut COUNT_{k}: u32 = 0;'",
              "'type Alias{k} = Vec<Part{k}>;'", "'macro_rules! part_{k} {'", "'    () => {};'", "'}'")


def _filled(text: str) -> str:
    return text.replace("{{", "{").replace("}}", "}").replace("{k}", f"' || {_K} || '")


HAS_ENUM, HAS_TRAIT, HAS_FREE = "p_type IN ('PROMO', 'LARGE')", "p_size % 2 = 0", "p_size > 25"
CODE_CONTENT = (f"{_filled(_HEAD)} || CASE WHEN {HAS_ENUM} THEN {_filled(_ENUM)} ELSE '' END"
                f" || CASE WHEN {HAS_TRAIT} THEN {_filled(_TRAIT)} ELSE '' END || {_filled(_IMPL)}"
                f" || CASE WHEN {HAS_FREE} THEN {_filled(_FREE)} ELSE '' END || {_filled(_TAIL)}")

CODE_SQL = f"SELECT p_partkey, p_name, p_type, p_size, p_brand, {CODE_PATH} AS path, {CODE_CONTENT} AS content FROM part"


def code_files(t) -> DataFrame:
    """(path, content, kind, ext, module) of the rendered Rust files."""
    return tree.as_files(t.part.selectExpr(f"{CODE_PATH} AS path", f"{CODE_CONTENT} AS content"))


# --- one markdown file per document ------------------------------------------
DOC_PATH = "'docs/' || source || '/doc_' || CAST(doc_id AS STRING) || '.md'"
DOC_CONTENT = ("'# ' || source || chr(10) || text || chr(10) || '  ## ' || lang || chr(10) || "
               "replace(text, '. ', '.' || chr(10) || '### ') || chr(10) || 'end #' || CAST(doc_id AS STRING)")
DOC_SQL = f"SELECT doc_id, {DOC_PATH} AS path, {DOC_CONTENT} AS content FROM documents"


def doc_files(t) -> DataFrame:
    return tree.as_files(t.documents.selectExpr(f"{DOC_PATH} AS path", f"{DOC_CONTENT} AS content"))


# --- documents as plain text files -------------------------------------------
TEXT_PATH = "source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt'"


def text_files(t) -> DataFrame:
    return tree.as_files(t.documents.selectExpr(f"{TEXT_PATH} AS path", "text AS content"))


# --- part as a symbol table ---------------------------------------------------
# name, kind, file, community, signature and summary read off the part's columns
SYMBOL_COLUMNS = {
    "name": "p_name || ' ' || CAST(p_partkey AS STRING)",
    "kind": "CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'struct' WHEN p_type = 'SMALL' THEN 'const' ELSE 'function' END",
    "file": "'src/' || p_brand || CASE WHEN p_size > 45 THEN '/main.rs' ELSE '/part.rs' END",
    "subsystem": "p_type",
    "signature": ("CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'fn ' || replace(p_name, ' ', '_') || '(size: i32) -> ' || "
                  "CASE WHEN p_size % 2 = 0 THEN 'Result<' || p_type || '>' ELSE p_type END END"),
    "summary": "'Part ' || p_brand || ' of type ' || p_type || ', ' || p_name",
    "chunk": "CAST(p_size AS STRING) || '-' || CAST(p_size + 10 AS STRING)",
}
SYMBOL_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in SYMBOL_COLUMNS.items()) + " FROM part"


def symbol_table(t) -> DataFrame:
    return t.part.selectExpr(*[f"{v} AS {k}" for k, v in SYMBOL_COLUMNS.items()])


# --- supply graph -------------------------------------------------------------
# region -> nation -> supplier -> part -> order -> customer
_EDGE_PARTS = [
    ("nation", "'region:' || CAST(n_regionkey AS STRING)", "'nation:' || CAST(n_nationkey AS STRING)", "file_to_file"),
    ("supplier", "'nation:' || CAST(s_nationkey AS STRING)", "'supplier:' || CAST(s_suppkey AS STRING)", "file_to_file"),
    ("lineitem", "'supplier:' || CAST(l_suppkey AS STRING)", "'part:' || CAST(l_partkey AS STRING)", "symbol_to_symbol"),
    ("lineitem", "'part:' || CAST(l_partkey AS STRING)", "'order:' || CAST(l_orderkey AS STRING)", "symbol_to_chunk"),
    ("orders", "'order:' || CAST(o_orderkey AS STRING)", "'customer:' || CAST(o_custkey AS STRING)", "chunk_to_chunk"),
]
SUPPLY_SQL = " UNION ALL ".join(f"SELECT {s} AS src, {d} AS dst, '{e}' AS edge_type FROM {tab}"
                                for tab, s, d, e in _EDGE_PARTS)


def supply_edges(t) -> DataFrame:
    """Typed edges of the whole supply chain, one per row of the tables."""
    out = None
    for table, src, dst, edge_type in _EDGE_PARTS:
        part = getattr(t, table).selectExpr(f"{src} AS src", f"{dst} AS dst", f"'{edge_type}' AS edge_type")
        out = part if out is None else out.unionByName(part)
    return out
