"""Definitions, containment, edges and documentation over the rendered source tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog.derived import CODE_SQL, HAS_ENUM, HAS_FREE, HAS_TRAIT, code_files
from codeloom.catalog.files import sql_lines
from codeloom.catalog.registry import query
from codeloom.functions import text as tx
from codeloom.operators import chunking, definitions as defs, docs, edges, embedding, hotspots
from codeloom.session import cut_lineage
from codeloom.sources import tree

_NL = "' || chr(10) || '"
_KEY = "' || p_partkey || '"


def _sql(text: str) -> str:
    return "'" + text.replace("\n", _NL).replace("@", _KEY) + "'"


_PRICE_FN = "fn price(&self) -> f64 {\n        self.price // { as is\n    }"
_MAKE_FN = "pub async fn make_@(size: i32, price: f64) -> Part@ {\n        Part@ { size, price }\n    }"
# kind, name, parent, text of the definition, condition, visibility
_KNOWN = [
    ("use", "std::fmt::Debug", None, "use std::fmt::Debug;", "true", None),
    ("struct", "Part@", None, "pub struct Part@ {\n    pub size: i32,\n    price: f64,\n}", "true", "pub"),
    ("field", "size", "Part@", "pub size: i32", "true", "pub"),
    ("field", "price", "Part@", "price: f64", "true", None),
    ("enum", "Grade@", None, "pub enum Grade@ {\n    Low,\n    High(i32),\n}", HAS_ENUM, "pub"),
    ("variant", "Low", "Grade@", "Low", HAS_ENUM, None),
    ("variant", "High", "Grade@", "High(i32)", HAS_ENUM, None),
    ("trait", "Priced@", None, "pub trait Priced@ {\n    fn price(&self) -> f64;\n}", HAS_TRAIT, "pub"),
    ("impl", "Priced@ for Part@", None, "impl Priced@ for Part@ {\n    " + _PRICE_FN + "\n}", HAS_TRAIT, None),
    ("function", "price", "Part@", _PRICE_FN, HAS_TRAIT, None),
    ("impl", "Part@", None, "impl Part@ {\n    /// Builds a ' || p_name || '\n    " + _MAKE_FN + "\n}", "true", None),
    ("function", "make_@", "Part@", _MAKE_FN, "true", "pub"),
    ("function", "search_@", None, "pub fn search_@<T: Clone>(items: Vec<T>, names: HashMap<String, i32>) -> usize {\n"
     "    items.len() /* size */\n}", HAS_FREE, "pub"),
    ("const", "MAX_@", None, "pub const MAX_@: i32 = ' || p_size || ';", "true", "pub"),
    ("static", "COUNT_@", None, "static mut COUNT_@: u32 = 0;", "true", None),
    ("type_alias", "Alias@", None, "type Alias@ = Vec<Part@>;", "true", None),
    ("macro", "part_@", None, "macro_rules! part_@ {\n    () => {};\n}", "true", None),
]


def _known_sql() -> str:
    parts = []
    for kind, name, parent, text, condition, visibility in _KNOWN:
        parent = "NULL" if parent is None else _sql(parent)
        visibility = "NULL" if visibility is None else f"'{visibility}'"
        parts.append(f"SELECT path, content, p_partkey, p_name, p_size, '{kind}' AS kind, {_sql(name)} AS name, {parent} AS parent, "
                     f"{_sql(text)} AS def, {visibility} AS visibility FROM code WHERE {condition}")
    return (f"code AS ({CODE_SQL}), known AS ({' UNION ALL '.join(parts)}), "
            "spans AS (SELECT *, CAST(strpos(content, def) - 1 AS BIGINT) AS start FROM known), "
            'syms AS (SELECT *, start + length(def) AS "end", '
            "CAST(length(left(content, start)) - length(replace(left(content, start), chr(10), '')) AS BIGINT) AS start_row FROM spans)")


SYMS = _known_sql()


def symbols(t):
    return defs.definitions(code_files(t))


@query("definitions", f"""WITH {SYMS}
SELECT path, kind, name, start, "end", start_row, start_row + length(def) - length(replace(def, chr(10), '')) AS end_row FROM syms""")
def definitions(t):
    """All kinds with byte and row spans."""
    return symbols(t).select("path", "kind", "name", "start", "end", "start_row", "end_row")


@query("definition_docs", f"""WITH {SYMS}
SELECT path, kind, name, CASE WHEN kind = 'use' THEN '//! ' || p_name WHEN kind = 'struct' THEN '/// A ' || p_name || chr(10) || '/// in stock'
 WHEN name LIKE 'make%' THEN '/// Builds a ' || p_name END AS docs, CASE WHEN kind = 'struct' THEN '#[derive(Debug, Clone)]' ELSE '' END AS attributes FROM syms""")
def definition_docs(t):
    """Leading documentation and attributes."""
    return symbols(t).select("path", "kind", "name", "docs", F.array_join("attributes", " ").alias("attributes"))


@query("definition_attributes", f"""WITH {SYMS}
SELECT path, kind, name, visibility,
 CASE WHEN name = 'price' AND kind = 'function' THEN '&self: &self' WHEN name LIKE 'make%' THEN 'size: i32, price: f64'
      WHEN name LIKE 'search%' THEN 'items: Vec<T>, names: HashMap<String, i32>' ELSE '' END AS parameters,
 CASE WHEN name = 'price' AND kind = 'function' THEN 'f64' WHEN name LIKE 'make%' THEN 'Part' || p_partkey WHEN name LIKE 'search%' THEN 'usize' END AS return_type,
 CASE WHEN name LIKE 'search%' THEN '<T: Clone>' END AS generics,
 CASE WHEN name = 'size' OR kind = 'const' THEN 'i32' WHEN name = 'price' AND kind = 'field' THEN 'f64' WHEN kind = 'static' THEN 'u32' END AS field_type,
 kind = 'static' AS is_mutable, CASE WHEN name LIKE 'make%' THEN 'async' ELSE '' END AS modifiers FROM syms""")
def definition_attributes(t):
    """D3: visibility, parameters, return type, generics, field type, modifiers."""
    return symbols(t).select("path", "kind", "name", "visibility", tx.parameter_list(F.col("parameters")).alias("parameters"),
                             "return_type", "generics", "field_type", "is_mutable",
                             F.array_join("modifiers", " ").alias("modifiers"))


@query("definition_parents", f"""WITH {SYMS}
SELECT path, kind, name, parent, CASE WHEN kind = 'impl' AND name LIKE 'Priced%' THEN 'Priced' || p_partkey END AS trait_impl FROM syms""")
def definition_parents(t):
    """Enclosing container and impl naming."""
    return symbols(t).select("path", "kind", "name", "parent", "trait_impl")


_CHUNKS = SYMS + """, chunk AS (
 SELECT path, start, "end", def, CASE kind WHEN 'use' THEN 'use_declaration::use_declaration' WHEN 'macro' THEN 'macro_definition::' || name
  WHEN 'type_alias' THEN 'type::' || name WHEN 'function' THEN 'fn::' || name ELSE kind || '::' || name END || ':' || start || '-' || "end" AS chunk_id
 FROM syms WHERE parent IS NULL AND kind NOT IN ('impl', 'trait')
 UNION ALL SELECT path, start, "end", def, 'trait ' || name || ':' || start || '-' || "end" FROM syms WHERE kind = 'trait'
 UNION ALL SELECT path, start, "end", def, 'impl ' || CASE WHEN name = 'price' THEN 'Priced' || p_partkey || ' for Part' || p_partkey ELSE parent END
  || '::' || name || ':' || start || '-' || "end" FROM syms WHERE kind = 'function' AND parent IS NOT NULL)"""


@query("definition_chunks", f"WITH {_CHUNKS} SELECT path, chunk_id, sha256(def) AS digest FROM chunk")
def definition_chunks(t):
    """One chunk per top-level item, impls split per member."""
    files = code_files(t)
    out = defs.definition_chunks(files, defs.definitions(files))
    return out.select("path", "chunk_id", F.sha2("text", 256).alias("digest"))


_PLACED = _CHUNKS + """, placed AS (SELECT s.path, s.name, s.kind, s.start, c.chunk_id, c.start AS c_start FROM syms s JOIN chunk c ON s.path = c.path AND s.start >= c.start AND s."end" <= c."end")"""


def _placed(t):
    """Tables of the rendered tree; definitions and chunks are written once and read by every branch."""
    files = code_files(t)
    syms = cut_lineage(defs.definitions(files))
    chunks = cut_lineage(defs.definition_chunks(files, syms))
    return files, syms, chunks, edges.containment(syms, chunks)


@query("span_containment", f"""WITH {_PLACED}
SELECT path, chunk_id, string_agg(name, ',' ORDER BY start, name) AS containing_symbols FROM placed GROUP BY path, chunk_id""")
def span_containment(t):
    """Symbols inside chunks by byte span."""
    _, _, _, placed = _placed(t)
    return edges.containing_symbols(placed).select("path", "chunk_id",
                                                   F.array_join("containing_symbols", ",").alias("containing_symbols"))


_SYMBOL_EDGES = """e AS (
 SELECT 'symbol:' || path || ':' || name AS src, 'symbol:' || path || ':' || parent AS dst FROM syms WHERE parent IS NOT NULL
 UNION ALL SELECT 'symbol:' || path || ':' || parent, 'symbol:' || path || ':' || name FROM syms WHERE kind IN ('field', 'variant')
 UNION ALL SELECT 'symbol:' || path || ':' || name, 'symbol:' || path || ':Priced' || p_partkey FROM syms WHERE kind = 'impl' AND name LIKE 'Priced%')"""


@query("symbol_edges", f"WITH {SYMS}, {_SYMBOL_EDGES} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def symbol_edges(t):
    """Parent, member and trait edges."""
    return edges.symbol_edges(symbols(t)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("symbol_chunk_edges", f"WITH {_PLACED} SELECT 'symbol:' || path || ':' || name AS src, 'chunk:' || path || ':' || chunk_id AS dst FROM placed")
def symbol_chunk_edges(t):
    """Symbol to chunk."""
    return edges.symbol_chunk_edges(_placed(t)[3]).select("src", "dst")


@query("file_edges", f"WITH code AS ({CODE_SQL}) SELECT regexp_extract(path, '^(.*)/', 1) AS src, 'file:' || path AS dst FROM code")
def file_edges(t):
    """Directory to file."""
    return edges.file_edges(code_files(t)).select("src", "dst")


@query("edge_histogram", f"""WITH {_PLACED}, {_SYMBOL_EDGES}, seq AS (SELECT path, count(*) - 1 AS n FROM chunk GROUP BY path)
SELECT 'symbol_to_symbol' AS edge_type, count(*) AS n_edges FROM e UNION ALL SELECT 'symbol_to_chunk', count(*) FROM placed
UNION ALL SELECT 'file_to_file', count(*) FROM code UNION ALL SELECT 'chunk_to_chunk', CAST(sum(n) AS BIGINT) FROM seq""")
def edge_histogram(t):
    """Union of all edge kinds, counted."""
    files, syms, chunks, placed = _placed(t)
    every = (edges.symbol_edges(syms).unionByName(edges.symbol_chunk_edges(placed)).unionByName(edges.file_edges(files))
             .unionByName(edges.sequential_edges(chunks)))
    return edges.edge_histogram(every)


@query("graph_nodes", f"""WITH {_CHUNKS}
SELECT 'file:' || path AS id, 'file' AS node_type, path AS name, NULL AS kind, NULL AS visibility FROM code
UNION ALL SELECT 'symbol:' || path || ':' || name, 'symbol', name, kind, visibility FROM syms
UNION ALL SELECT 'chunk:' || path || ':' || chunk_id, 'chunk', chunk_id, NULL, NULL FROM chunk""")
def graph_nodes(t):
    """File, symbol and chunk nodes under one id scheme."""
    files, syms, chunks, _ = _placed(t)
    n = edges.nodes(files, syms, chunks)
    return n.select("id", "node_type", "name", F.try_element_at("metadata", F.lit("kind")).alias("kind"),
                    F.try_element_at("metadata", F.lit("visibility")).alias("visibility"))


_MODULES = """per AS (SELECT path, count(*) AS n, count(*) FILTER (kind = 'trait') AS t, count(*) FILTER (kind = 'struct') AS s, count(*) FILTER (kind = 'function') AS f FROM syms GROUP BY path),
m AS (SELECT regexp_extract(path, '^(.*)/', 1) AS module, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS symbol_count,
 CAST(sum(length(content) - length(replace(content, chr(10), ''))) AS BIGINT) AS line_count, sum(t) AS t, sum(s) AS s, sum(f) AS f FROM code JOIN per USING (path) GROUP BY 1)"""


@query("module_rollup", f"""WITH {SYMS}, {_MODULES},
p AS (SELECT module, file_count, symbol_count, line_count, CASE WHEN t > 0 THEN 'Interface definitions and abstractions' WHEN s > symbol_count // 2 THEN 'Data structures and types'
 WHEN f > symbol_count // 2 THEN 'Utility functions and operations' ELSE 'Mixed functionality module' END AS purpose FROM m)
SELECT *, 'Module ''' || module || ''' contains ' || file_count || ' file(s) implementing ' || purpose || '. Total symbols: ' || symbol_count AS description FROM p""")
def module_rollup(t):
    """A1, A2: files, symbols, lines and purpose per directory."""
    files = code_files(t)
    return docs.module_rollup(files, defs.definitions(files))


@query("module_exports", f"""WITH {SYMS}, r AS (SELECT regexp_extract(path, '^(.*)/', 1) AS module, kind || '::' || name AS export,
 row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path, start, name) AS rank FROM syms WHERE visibility = 'pub')
SELECT module, rank, export FROM r WHERE rank <= 10""")
def module_exports(t):
    """First public symbols of each module."""
    files = code_files(t)
    return docs.module_exports(files, defs.definitions(files))


@query("submodules", f"""WITH code AS ({CODE_SQL}), m AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS module FROM code)
SELECT DISTINCT a.module, string_split(substr(b.module, length(a.module) + 2), '/')[1] AS submodule FROM m a JOIN m b ON starts_with(b.module, a.module || '/')""")
def submodules(t):
    """A3: direct child directories."""
    return docs.submodules(code_files(t))


_FILE_EDGES = """fe AS (SELECT path, sum(n) AS edge_count FROM (
 SELECT path, count(*) AS n FROM placed GROUP BY path UNION ALL
 SELECT path, sum((parent IS NOT NULL)::INT + (kind IN ('field', 'variant'))::INT + (kind = 'impl' AND name LIKE 'Priced%')::INT) FROM syms GROUP BY path) GROUP BY path)"""


@query("file_summaries", f"""WITH {_PLACED}, {_FILE_EDGES},
n AS (SELECT path, count(*) AS n, string_agg(kind || '::' || name, ',' ORDER BY start, name) AS symbols, string_agg(name, ',' ORDER BY start) FILTER (visibility = 'pub') AS exports FROM syms GROUP BY path),
k AS (SELECT path, string_agg(c || ' ' || kind, ', ' ORDER BY kind) AS b FROM (SELECT path, kind, count(*) AS c FROM syms GROUP BY path, kind) GROUP BY path),
c AS (SELECT path, count(*) AS c FROM chunk GROUP BY path)
SELECT path, 'rs' AS language, length(content) - length(replace(content, chr(10), '')) AS lines_total, symbols, 'use std::fmt::Debug;' AS imports, exports,
 round((n * 0.4 + c * 0.3 + edge_count * 0.3) / 10, 6) AS complexity_score,
 'File ''' || path || ''' with ' || n || ' symbols: ' || b AS description FROM code JOIN n USING (path) JOIN k USING (path) JOIN c USING (path) JOIN fe USING (path)""")
def file_summaries(t):
    """A4, A5: per-file documentation and complexity."""
    files, syms, chunks, placed = _placed(t)
    s = docs.file_summaries(files, syms, chunks, placed)
    return s.select("path", "language", "lines_total", F.array_join("symbols", ",").alias("symbols"),
                    F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"),
                    F.round(F.col("complexity_score").cast("double"), 6).alias("complexity_score"), "description")


@query("kind_rollup", f"WITH {SYMS} SELECT path, kind, count(*) AS n_symbols FROM syms GROUP BY ROLLUP (path, kind)")
def kind_rollup(t):
    """Kinds per file, per file total, and over all."""
    return docs.kind_rollup(symbols(t))


@query("struct_members", f"""WITH {SYMS}
SELECT path, parent AS struct, CASE kind WHEN 'field' THEN 'field' ELSE 'method' END AS role, name AS member FROM syms WHERE kind IN ('field', 'function') AND parent IS NOT NULL
UNION ALL SELECT path, 'Part' || p_partkey, 'trait', 'Priced' || p_partkey FROM syms WHERE kind = 'trait'""")
def struct_members(t):
    """Fields, methods and trait impls of each struct."""
    return docs.struct_members(symbols(t))


@query("struct_docs", f"""WITH code AS ({CODE_SQL})
SELECT path, 'Part' || p_partkey AS name, '/// A ' || p_name || chr(10) || '/// in stock' AS description, 'pub' AS visibility, 2 AS field_count,
 CASE WHEN {HAS_TRAIT} THEN 2 ELSE 1 END AS method_count, CASE WHEN {HAS_TRAIT} THEN 'Priced' || p_partkey ELSE '' END AS traits, '#[derive(Debug, Clone)]' AS derives FROM code""")
def struct_docs(t):
    """Struct documentation."""
    s = docs.struct_docs(symbols(t))
    return s.select("path", "name", "description", "visibility", "field_count", "method_count",
                    F.array_join("traits_implemented", ",").alias("traits"), F.array_join("derives", ",").alias("derives"))


@query("function_docs", f"""WITH {SYMS}
SELECT path, name, CASE WHEN name = 'price' THEN 'Function ''price'' with 1 parameter(s)' WHEN name LIKE 'make%' THEN '/// Builds a ' || p_name ELSE 'Function ''' || name || ''' with 2 parameter(s)' END AS description,
 split_part(def, ' {{', 1) AS signature, CASE WHEN name = 'price' THEN 1 ELSE 2 END AS parameter_count, coalesce(visibility, 'private') AS visibility,
 name LIKE 'make%' AS is_async, false AS is_unsafe, 'Low' AS complexity FROM syms WHERE kind = 'function'""".replace("split_part(def, ' {', 1)", "CASE WHEN name = 'price' THEN 'fn price(&self: &self) -> f64' ELSE split_part(def, ' {', 1) END"))
def function_docs(t):
    """Function documentation with its full signature."""
    d = docs.function_docs(symbols(t))
    return d.select("path", "name", "description", "signature", "parameter_count", "visibility", "is_async", "is_unsafe",
                    F.col("complexity_estimate").alias("complexity"))


@query("corpus_overview", f"""WITH {SYMS}
SELECT (SELECT count(*) FROM code) AS total_files, (SELECT count(*) FROM syms) AS total_symbols,
 CAST((SELECT sum(length(content) - length(replace(content, chr(10), ''))) FROM code) AS BIGINT) AS total_lines,
 'Trait-based abstraction' AS patterns, 'Flat architecture' AS style""")
def corpus_overview(t):
    """Totals, patterns and style in one row."""
    files = code_files(t)
    o = docs.overview(files, defs.definitions(files))
    return o.select("total_files", "total_symbols", "total_lines", F.array_join("design_patterns", ",").alias("patterns"),
                    F.col("architectural_style").alias("style"))


@query("module_hierarchy", f"WITH code AS ({CODE_SQL}) SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS module FROM code")
def module_hierarchy(t):
    """Ordered list of modules."""
    return docs.module_hierarchy(code_files(t))


@query("least_coupled", f"""WITH {_PLACED}, {_FILE_EDGES}
SELECT path, CAST(edge_count AS BIGINT) AS edge_count FROM fe ORDER BY edge_count, path LIMIT 5""")
def least_coupled(t):
    """Files with the fewest own edges."""
    files, syms, _, placed = _placed(t)
    return docs.least_coupled(files, docs.edge_counts(syms, placed))


@query("cluster_summaries", f"""WITH {SYMS}, r AS (SELECT DISTINCT 'cluster_' || kind AS cluster_id, name FROM syms),
f AS (SELECT cluster_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY name) AS k FROM r) WHERE k <= 5 GROUP BY cluster_id)
SELECT 'cluster_' || kind AS cluster_id, 'General Functionality' AS topic_label, count(*) AS symbol_count, any_value(names) AS names,
 'Cluster of ' || count(*) || ' related symbols with semantic similarity' AS description FROM syms JOIN f ON f.cluster_id = 'cluster_' || kind GROUP BY kind""")
def cluster_summaries(t):
    """Clusters by kind."""
    c = docs.cluster_summaries(symbols(t))
    return c.select("cluster_id", "topic_label", "symbol_count", F.array_join("representative_symbols", ",").alias("names"),
                    "description")


@query("complexity_bombs", f"""WITH {_PLACED}, {_FILE_EDGES}, n AS (SELECT path, count(*) AS n FROM syms GROUP BY path), c AS (SELECT path, count(*) AS c FROM chunk GROUP BY path),
s AS (SELECT path, (n * 0.4 + c * 0.3 + edge_count * 0.3) / 10 AS score FROM n JOIN c USING (path) JOIN fe USING (path))
SELECT 'file:' || path AS symbol, path, round(score, 6) AS complexity_score, CASE WHEN score > 5 THEN 'High' ELSE 'Medium' END AS complexity_estimate, 'file' AS symbol_kind FROM s WHERE score > 1.6""")
def complexity_bombs(t):
    """Files above a complexity limit and functions rated High."""
    files, syms, chunks, placed = _placed(t)
    s = docs.file_summaries(files, syms, chunks, placed)
    b = hotspots.complexity_bombs(s, docs.function_docs(syms), None, medium=1.6)
    return b.withColumn("complexity_score", F.round("complexity_score", 6))


@query("symbol_text", f"""WITH {SYMS}
SELECT path, kind, name, start || '-' || "end" AS reference,
 CASE WHEN kind = 'struct' THEN '/// A ' || p_name WHEN kind = 'use' THEN '//! ' || p_name WHEN name LIKE 'make%' THEN '/// Builds a ' || p_name
  WHEN kind = 'function' THEN 'Function ' || name WHEN kind = 'enum' THEN 'Enum ' || name WHEN kind = 'trait' THEN 'Trait ' || name
  WHEN kind = 'impl' THEN 'Implementation block for ' || name ELSE kind || ' ' || name END AS summary,
 CASE WHEN name = 'price' AND kind = 'function' THEN 'fn price(&self: &self) -> f64' WHEN name LIKE 'make%' THEN 'fn make_' || p_partkey || '(size: i32, price: f64) -> Part' || p_partkey
  WHEN name LIKE 'search%' THEN 'fn search_' || p_partkey || '<<T: Clone>>(items: Vec<T>, names: HashMap<String, i32>) -> usize'
  WHEN kind IN ('struct', 'enum', 'trait') THEN kind || ' ' || name WHEN kind = 'type_alias' THEN 'type ' || name END AS signature FROM syms""")
def symbol_text(t):
    """Signature, span reference and summary."""
    c = F.col
    return symbols(t).select(
        "path", "kind", "name", tx.span_reference(c("start"), c("end"), c("start_row"), c("end_row")).alias("reference"),
        tx.symbol_summary(c("kind"), c("name"), c("docs")).alias("summary"),
        tx.signature(c("kind"), c("name"), c("parameters"), c("return_type"), c("generics")).alias("signature"))


@query("symbol_captions", f"""WITH {SYMS}
SELECT path, kind, name, CASE kind WHEN 'function' THEN 'Function' WHEN 'struct' THEN 'Struct' WHEN 'enum' THEN 'Enum' WHEN 'trait' THEN 'Trait' WHEN 'impl' THEN 'Implementation'
 WHEN 'type_alias' THEN 'Type alias' WHEN 'const' THEN 'Constant' WHEN 'static' THEN 'Static variable' WHEN 'macro' THEN 'Macro' ELSE 'Symbol' END || ' ''' || name || ''''
 || CASE WHEN visibility IS NULL THEN '' ELSE ' (pub)' END || CASE WHEN kind <> 'function' THEN '' WHEN name = 'price' THEN ' with 1 parameter(s)' ELSE ' with 2 parameter(s)' END AS caption FROM syms""")
def symbol_captions(t):
    """The older caption form."""
    c = F.col
    return symbols(t).select("path", "kind", "name",
                             tx.symbol_caption(c("kind"), c("name"), c("visibility"), c("parameters")).alias("caption"))


@query("symbol_sources", f"""WITH {SYMS} SELECT name AS symbol, path AS file, start || '-' || "end" AS chunk_range, def AS content FROM syms""")
def symbol_sources(t):
    """Source text of every symbol by its byte span."""
    from codeloom.operators import search

    files = code_files(t)
    return search.symbol_sources(search.symbol_table(defs.definitions(files)), files)


@query("symbol_places", f"""WITH {_PLACED}, r AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY c_start) AS r FROM placed)
SELECT path, name, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY r) FILTER (r <= 3) AS chunk_ids, greatest(count(*) - 3, 0) AS more FROM r GROUP BY path, name""")
def symbol_places(t):
    """First chunks of each symbol and the number of others."""
    from codeloom.operators import blocks

    p = blocks.symbol_places(_placed(t)[3])
    return p.select("path", "name", "n_chunks", F.array_join("chunk_ids", ",").alias("chunk_ids"), "more")


@query("delimiter_extensions", f"WITH code AS ({CODE_SQL}) SELECT path, len(string_split(content, chr(10) || '}}')) AS n_chunks FROM code")
def delimiter_extensions(t):
    """A chunker chosen by name."""
    return chunking.chunk(code_files(t), "Delimiter", "\n}").groupBy("path").agg(F.count("*").alias("n_chunks"))


# --- a file per part with what a reader of single lines gets wrong -----------------
_WIDE = """pub unsafe fn wide_@(a: i32, // first {
    b: f64) -> f64 {
    const IN_@: i32 = 1;
    let c = "{";
    b
}"""
_RAW = """const RAW_@: &str = r#"
struct Fake_@ {
"#;"""
_CASE = """struct Case_@ {
        id: i32,
    }"""
_CHECK = """fn check_@() {
        const DEEP_@: i32 = 2;
    }"""
_TESTS = f"""mod tests_@ {{
    {_CASE}
    {_CHECK}
}}"""
_SHAPE = """trait Shape_@ {
    type Side_@;
}"""
_LAST = "fn last_@() {}"
_NESTED = f"""/* old
fn dead_@() {{ /* {{ */
*/
/// Docs
#[inline]
{_WIDE}
{_RAW}
{_TESTS}
{_SHAPE}
{_LAST}
"""
# kind, name, parent, text, label of its chunk
_NESTED_KNOWN = [
    ("function", "wide_@", None, _WIDE, "fn::wide_@"), ("const", "IN_@", None, "const IN_@: i32 = 1;", None), ("const", "RAW_@", None, _RAW, "const::RAW_@"),
    ("mod", "tests_@", None, _TESTS, "mod::tests_@"), ("struct", "Case_@", None, _CASE, None), ("field", "id", "Case_@", "id: i32", None),
    ("function", "check_@", None, _CHECK, None), ("const", "DEEP_@", None, "const DEEP_@: i32 = 2;", None), ("trait", "Shape_@", None, _SHAPE, None),
    ("associated_type", "Side_@", "Shape_@", "type Side_@;", "trait Shape_@::Side_@"), ("function", "last_@", None, _LAST, "fn::last_@"),
]
_NESTED_PATH = "'odd/part_' || CAST(p_partkey AS STRING) || '.rs'"
_NESTED_ROWS = " UNION ALL ".join(
    f"SELECT path, content, '{kind}' AS kind, {_sql(name)} AS name, {_sql(parent) if parent else 'NULL'} AS parent, {_sql(text)} AS def, {_sql(label) if label else 'NULL'} AS label FROM n"
    for kind, name, parent, text, label in _NESTED_KNOWN)
_NESTED_SQL = f"""n AS (SELECT p_partkey, {_NESTED_PATH} AS path, {_sql(_NESTED)} AS content FROM part), f AS ({_NESTED_ROWS}),
spans AS (SELECT *, strlen(left(content, instr(content, def) - 1)) AS start FROM f)"""


def _nested_files(t):
    content = _sql(_NESTED).replace("' || p_partkey || '", "' || CAST(p_partkey AS STRING) || '")
    return tree.as_files(t.part.selectExpr(f"{_NESTED_PATH} AS path", f"{content} AS content"))


@query("definitions_nested", f"""WITH {_NESTED_SQL} SELECT path, kind, name, parent, start, start + strlen(def) AS "end",
 CASE WHEN name LIKE 'wide%' THEN '/// Docs' END AS docs, CASE WHEN name LIKE 'wide%' THEN '#[inline]' ELSE '' END AS attributes,
 CASE WHEN name LIKE 'wide%' THEN 'unsafe' ELSE '' END AS modifiers FROM spans""")
def definitions_nested(t):
    """Inline modules, items in bodies, block comments, raw strings, associated types."""
    return defs.definitions(_nested_files(t)).select(
        "path", "kind", "name", "parent", "start", "end", "docs", F.array_join("attributes", " ").alias("attributes"),
        F.array_join("modifiers", " ").alias("modifiers"))


@query("definition_chunks_nested", f"""WITH {_NESTED_SQL} SELECT path, label || ':' || start || '-' || (start + strlen(def)) AS chunk_id, sha256(def) AS digest
FROM spans WHERE label IS NOT NULL""")
def definition_chunks_nested(t):
    """What lies inside an item is part of its chunk."""
    files = _nested_files(t)
    return defs.definition_chunks(files, defs.definitions(files)).select("path", "chunk_id", F.sha2("text", 256).alias("digest"))


@query("processing_report", f"""
WITH {SYMS}, src AS ({CODE_SQL}), lc AS (SELECT path, count(*) AS n_lines FROM ({sql_lines('src')}) GROUP BY path),
sc AS (SELECT path, count(*) AS n_symbols FROM syms GROUP BY path)
SELECT path, n_lines, len(string_split(content, chr(10) || '}}')) AS n_chunks, coalesce(n_symbols, 0) AS n_symbols,
  len(string_split(content, chr(10) || '}}')) AS n_embeddings FROM src JOIN lc USING (path) LEFT JOIN sc USING (path)""")
def processing_report(t):
    """Lines, chunks, symbols and embeddings of every file, here over delimiter chunks."""
    files = code_files(t)
    chunks = chunking.by_delimiter(files, "\n}")
    vectors = embedding.hashing_embedding(chunks, "text", ["path", "chunk_ord"])
    return docs.processing_report(files, chunks, symbols(t), vectors).select("path", "n_lines", "n_chunks", "n_symbols", "n_embeddings")
