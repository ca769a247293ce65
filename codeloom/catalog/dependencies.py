"""Imports, calls and type uses over a crate rendered from the tables: a module for each row, importing the one it refers to."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog.registry import query
from codeloom.operators import definitions as defs, dependencies as deps, graph
from codeloom.session import cut_lineage
from codeloom.sources import tree


def _rendered(key: str, *lines: str) -> str:
    """Content expression; ``@`` is the row's key and ``<column>`` a column of it."""
    parts, rest = [], ("\n".join(lines) + "\n").replace("@", f"<{key}>")
    while "<" in rest:
        before, _, rest = rest.partition("<")
        name, _, rest = rest.partition(">")
        parts += [f"'{before}'", f"CAST({name} AS STRING)"]
    return " || ".join([*parts, f"'{rest}'"]).replace("\n", "' || chr(10) || '")


# comments, literals and macros hold calls that are none
_FILES = {
    "region": _rendered("r_regionkey", "pub struct Rate@;", "pub fn tax_@(x: i64) -> i64 {", "    x // quote_1(x)", "}"),
    "nation": _rendered("n_nationkey", "use crate::regions::{r<n_regionkey>::{self, tax_<n_regionkey>}, r<n_regionkey>::Rate<n_regionkey> as Fee};",
                        "use std::fmt::Debug;", "pub fn levy_@(x: i64, rate: &Fee) -> i64 {", "    tax_<n_regionkey>(x) + half_@(x)", "}",
                        "fn half_@(x: i64) -> i64 {", "    /* levy_@(x) */", "    x", "}"),
    "supplier": _rendered("s_suppkey", "use super::super::nations::n<s_nationkey>;", "pub fn quote_@() -> i64 {",
                          "    n<s_nationkey>::levy_<s_nationkey>(1, None)", "}"),
    "customer": _rendered("c_custkey", "use shop::nations::n<c_nationkey>::*;", "pub fn order_@() {", "    log!(\"half_1(2)\");",
                          "    levy_<c_nationkey>(2);", "}"),
    "part": _rendered("p_partkey", "pub struct Part@ {", "    pub size: i32,", "}", "impl Part@ {", "    fn base(&self) -> i64 {", "        1", "    }",
                      "    pub fn price(&self) -> i64 {", "        self.base() + Self::fee()", "    }", "    fn fee() -> i64 {", "        tax_0(3)", "    }", "}",
                      "pub fn make_@() -> Part@ {", "    Part@ { size: <p_size> }", "}"),
}


def _path(folder: str, key: str) -> str:
    return f"'shop/src/{folder}' || CAST({key} AS STRING) || '.rs'"


_PLACES = {"region": ("regions/r", "r_regionkey"), "nation": ("nations/n", "n_nationkey"), "supplier": ("suppliers/s", "s_suppkey"),
           "customer": ("customers/c", "c_custkey"), "part": ("parts/p", "p_partkey")}


def crate_files(t):
    out = None
    for table, place in _PLACES.items():
        rows = getattr(t, table).selectExpr(f"{_path(*place)} AS path", f"{_FILES[table]} AS content")
        out = rows if out is None else out.unionByName(rows)
    return tree.as_files(out)


def _symbol(table: str, key: str, name: str) -> str:
    return f"'symbol:' || {_path(_PLACES[table][0], key)} || ':{name}' || " + f"CAST({key} AS STRING)"


_FIXED = lambda name: f"'symbol:' || {_path('parts/p', 'p_partkey')} || ':{name}'"
_IMPORTS = " UNION ".join(
    f"SELECT 'file:' || {_path(_PLACES[table][0], key)} AS src, 'file:' || {_path(_PLACES[other][0], to)} AS dst, 'imports' AS edge_type FROM {table}"
    for table, key, other, to in [("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"),
                                  ("customer", "c_custkey", "nation", "c_nationkey")])
_CALLS = " UNION ".join([
    f"SELECT {_symbol('nation', 'n_nationkey', 'levy_')} AS src, {_symbol('region', 'n_regionkey', 'tax_')} AS dst, 'calls' AS edge_type FROM nation",
    f"SELECT {_symbol('nation', 'n_nationkey', 'levy_')}, {_symbol('nation', 'n_nationkey', 'half_')}, 'calls' FROM nation",
    f"SELECT {_symbol('supplier', 's_suppkey', 'quote_')}, {_symbol('nation', 's_nationkey', 'levy_')}, 'calls' FROM supplier",
    f"SELECT {_symbol('customer', 'c_custkey', 'order_')}, {_symbol('nation', 'c_nationkey', 'levy_')}, 'calls' FROM customer",
    *[f"SELECT {_FIXED('price')}, {_FIXED(name)}, 'calls' FROM part" for name in ("base", "fee")],
    f"SELECT {_FIXED('fee')}, 'symbol:shop/src/regions/r0.rs:tax_0', 'calls' FROM part WHERE EXISTS (SELECT * FROM region WHERE r_regionkey = 0)"])
_USES = " UNION ".join([
    f"SELECT {_symbol('nation', 'n_nationkey', 'levy_')} AS src, {_symbol('region', 'n_regionkey', 'Rate')} AS dst, 'uses' AS edge_type FROM nation",
    f"SELECT {_symbol('part', 'p_partkey', 'make_')}, {_symbol('part', 'p_partkey', 'Part')}, 'uses' FROM part"])


def _edges(t, *kinds):
    files = cut_lineage(crate_files(t))
    return deps.dependency_edges(files, cut_lineage(defs.definitions(files)), kinds)


def _of_kind(t, kind: str):
    return _edges(t, kind).select("src", "dst", "edge_type")


@query("import_edges", _IMPORTS)
def import_edges(t):
    """Imports of every file that lead to a file of the corpus: grouped, renamed, glob, by crate and by super."""
    return _of_kind(t, "imports")


@query("call_edges", _CALLS)
def call_edges(t):
    """Every call by the function around it: own file, imported name, module path, glob, method, and a name defined once."""
    return _of_kind(t, "calls")


@query("use_edges", _USES)
def use_edges(t):
    """Types that functions and structs name."""
    return _of_kind(t, "uses")


@query("dependency_closure_code", f"""WITH RECURSIVE d AS (SELECT src, dst FROM ({_CALLS}) UNION SELECT src, dst FROM ({_USES}) UNION SELECT src, dst FROM ({_IMPORTS})),
walk(source, node, depth) AS (SELECT src, dst, 1 FROM d WHERE src LIKE '%:quote_%' OR src LIKE '%:order_%'
 UNION SELECT w.source, d.dst, w.depth + 1 FROM walk w JOIN d ON d.src = w.node WHERE w.depth < 5)
SELECT source, node, min(depth) AS depth FROM walk GROUP BY source, node""")
def dependency_closure_code(t):
    """What every quoting and ordering function depends on."""
    edges = _edges(t, "calls", "imports", "uses")
    sources = edges.filter(F.col("src").rlike(":(quote|order)_")).select(F.col("src").alias("source")).distinct()
    return graph.reachable(edges, sources, 5, ["calls", "imports", "uses"])
