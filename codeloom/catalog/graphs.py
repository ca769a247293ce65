"""Graph traversal, degree reports and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog.derived import SUPPLY_SQL, SYMBOL_SQL, supply_edges, symbol_table
from codeloom.catalog.registry import query
from codeloom.operators import docs, edges, graph, hotspots
from codeloom.sources import changelog

_E = f"e AS ({SUPPLY_SQL})"
_ENDS = "ends AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)"


def _sources(t, *names):
    return t.spark.createDataFrame([(n,) for n in names], "source string")


@query("impact_bfs", f"""WITH RECURSIVE {_E}, d AS (SELECT DISTINCT src, dst FROM e),
walk(source, node, depth) AS (SELECT src, dst, 1 FROM d WHERE src IN ('region:0', 'nation:3') UNION SELECT w.source, d.dst, w.depth + 1 FROM walk w JOIN d ON d.src = w.node WHERE w.depth < 5)
SELECT source, node, min(depth) AS depth FROM walk GROUP BY source, node""")
def impact_bfs(t):
    """Everything a region or nation reaches in five hops."""
    return graph.reachable(supply_edges(t), _sources(t, "region:0", "nation:3"), 5)


@query("dependency_closure", f"""WITH RECURSIVE {_E}, d AS (SELECT DISTINCT dst AS src, src AS dst FROM e WHERE edge_type IN ('symbol_to_symbol', 'file_to_file')),
walk(source, node, depth) AS (SELECT src, dst, 1 FROM d WHERE src LIKE 'part:%' UNION SELECT w.source, d.dst, w.depth + 1 FROM walk w JOIN d ON d.src = w.node WHERE w.depth < 3)
SELECT source, node, min(depth) AS depth FROM walk GROUP BY source, node""")
def dependency_closure(t):
    """What every part depends on, over chosen edge types, for all parts at once."""
    reverse = supply_edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    parts = reverse.filter(F.col("src").startswith("part:")).select(F.col("src").alias("source")).distinct()
    return graph.reachable(reverse, parts, 3, ["symbol_to_symbol", "file_to_file"])


@query("shortest_path", f"""WITH RECURSIVE {_E}, d AS (SELECT DISTINCT src, dst FROM e),
walk(source, node, path, depth) AS (SELECT src, dst, [src, dst], 1 FROM d WHERE src LIKE 'region:%' UNION ALL
 SELECT source, dst, min(list_append(path, dst)), any_value(depth) + 1 FROM walk w JOIN d ON d.src = w.node WHERE depth < 5 GROUP BY source, dst),
best AS (SELECT source, node, arg_min(path, depth) AS path, min(depth) AS depth FROM walk GROUP BY source, node),
pairs AS (SELECT 'region:' || r_regionkey AS source, 'customer:' || c_custkey AS target FROM region, customer WHERE c_custkey % 5 = r_regionkey)
SELECT p.source, p.target, array_to_string(b.path, '>') AS path, coalesce(b.depth, 0) AS length FROM pairs p LEFT JOIN best b ON b.source = p.source AND b.node = p.target""")
def shortest_path(t):
    """Shortest path from a region to each customer."""
    pairs = t.customer.select(F.concat(F.lit("region:"), F.col("c_custkey") % 5).alias("source"),
                              F.concat(F.lit("customer:"), "c_custkey").alias("target"))
    out = graph.shortest_paths(supply_edges(t), pairs, 10)
    return out.withColumn("path", F.array_join("path", ">"))


@query("order_components", """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS src, 'd' || strftime(o_orderdate, '%Y-%m-%d') AS dst FROM orders),
l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
walk(node, root) AS (SELECT src, src FROM l UNION SELECT l.dst, w.root FROM walk w JOIN l ON l.src = w.node)
SELECT node, min(root) AS component FROM walk GROUP BY node""")
def order_components(t):
    """Components of orders that share a day."""
    e = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("src"),
                    F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dst"))
    return graph.connected_components(e)


@query("supply_components", """SELECT 'n' || c_nationkey AS component_of, min(n) AS component, count(*) AS n_nodes FROM
 (SELECT c_nationkey, 'c' || c_custkey AS node FROM customer UNION ALL SELECT DISTINCT c_nationkey, 'n' || c_nationkey FROM customer) JOIN
 (SELECT c_nationkey AS k, min('c' || c_custkey) AS n FROM customer GROUP BY c_nationkey) ON k = c_nationkey GROUP BY c_nationkey""")
def supply_components(t):
    """One hub per nation; every customer hangs on its hub."""
    e = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    found = graph.connected_components(e)
    return found.groupBy("component").agg(F.max("node").alias("component_of"), F.count("*").alias("n_nodes"))


@query("degrees", f"WITH {_E}, {_ENDS} SELECT node, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, count(*) AS total FROM ends GROUP BY node")
def degrees(t):
    """In, out and total degree."""
    return graph.degrees(supply_edges(t))


@query("degree_hotspots", f"""WITH {_E}, {_ENDS}, s AS (SELECT 'part:' || p_partkey AS name, 'src/' || p_brand AS file FROM part)
SELECT node AS symbol, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, count(*) AS total, coalesce(any_value(file), 'unknown') AS file
FROM ends LEFT JOIN s ON name = node GROUP BY node ORDER BY total DESC, symbol LIMIT 10""")
def degree_hotspots(t):
    """Most connected nodes with their file."""
    s = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("file"))
    return hotspots.most_connected(supply_edges(t), s)


@query("core_components", f"WITH {_E}, {_ENDS} SELECT node AS name, count(*) AS interaction_count FROM ends GROUP BY node ORDER BY interaction_count DESC, name LIMIT 5")
def core_components(t):
    """A10: five nodes with the most edges."""
    return docs.core_components(supply_edges(t))


@query("dependency_popularity", f"WITH {_E} SELECT dst AS name, count(*) AS dependents FROM e WHERE edge_type IN ('file_to_file', 'symbol_to_symbol') GROUP BY dst ORDER BY dependents DESC, name LIMIT 10")
def dependency_popularity(t):
    """Most depended-on nodes."""
    return docs.dependency_popularity(supply_edges(t))


# orders point at the nation of the customer and of the next customer: edges with many mutual pairs
_TWO_WAY = """w AS (SELECT 'n' || a.c_nationkey AS src, 'n' || b.c_nationkey AS dst, 'symbol_to_symbol' AS edge_type FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)"""


def _two_way(t):
    a = t.customer.select("c_custkey", F.col("c_nationkey").alias("a"))
    b = t.customer.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_nationkey").alias("b"))
    return a.join(b, "c_custkey").select(F.concat(F.lit("n"), "a").alias("src"), F.concat(F.lit("n"), "b").alias("dst"),
                                         F.lit("symbol_to_symbol").alias("edge_type"))


@query("mutual_edges", f"WITH {_TWO_WAY} SELECT DISTINCT w.src, w.dst FROM w JOIN w x ON x.src = w.dst AND x.dst = w.src")
def mutual_edges(t):
    """Edges whose reverse exists."""
    return graph.mutual_edges(_two_way(t))


@query("circular_dependencies", f"WITH {_TWO_WAY} SELECT DISTINCT w.src, w.dst, 'Low' AS severity FROM w JOIN w x ON x.src = w.dst AND x.dst = w.src ORDER BY 1, 2 LIMIT 5")
def circular_dependencies(t):
    """First two-node cycles."""
    return docs.circular_dependencies(_two_way(t))


@query("dependency_overview", f"""WITH {_TWO_WAY}, n AS (SELECT count(*) AS internal FROM w),
c AS (SELECT count(*) AS circular FROM (SELECT DISTINCT w.src, w.dst FROM w JOIN w x ON x.src = w.dst AND x.dst = w.src))
SELECT internal, 0 AS external, circular, internal || ' internal dependencies, 0 external dependencies, ' || circular || ' circular dependencies detected' AS summary FROM n, c""")
def dependency_overview(t):
    """Dependency counts in one row; all cycles count."""
    return docs.dependency_overview(_two_way(t))


@query("neighbours", f"""WITH {_E} SELECT src AS node, dst AS related FROM e WHERE edge_type = 'symbol_to_symbol' UNION SELECT dst, src FROM e WHERE edge_type = 'symbol_to_symbol'""")
def neighbours(t):
    """Related nodes in either direction."""
    return graph.neighbour_pairs(supply_edges(t), ["symbol_to_symbol"])


@query("impact_graph", f"WITH {_E} SELECT DISTINCT src, dst AS target FROM e WHERE edge_type IN ('symbol_to_symbol', 'file_to_file')")
def impact_graph(t):
    """Impact graph as distinct rows."""
    return graph.impact_pairs(supply_edges(t), ["symbol_to_symbol", "file_to_file"])


@query("most_impacting", f"WITH {_E} SELECT src AS symbol, count(DISTINCT dst) AS n_targets FROM e GROUP BY src ORDER BY n_targets DESC, symbol LIMIT 10")
def most_impacting(t):
    """Symbols with the most distinct targets."""
    return hotspots.most_impacting(supply_edges(t))


@query("orphans", f"""WITH s AS ({SYMBOL_SQL}), e AS (SELECT p_name || ' ' || p_partkey AS src, 'o' || l_orderkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT src, count(*) AS n FROM e GROUP BY src)
SELECT name AS symbol, file, coalesce(n, 0) AS connection_count, kind AS symbol_kind, kind = 'struct' AS is_exported FROM s LEFT JOIN c ON src = name
WHERE kind <> 'const' AND coalesce(n, 0) <= 25 ORDER BY connection_count, symbol, file LIMIT 10""")
def orphans(t):
    """Symbols with at most 25 connections, over all rows."""
    names = t.part.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("src"), F.col("p_partkey").alias("l_partkey"))
    e = t.lineitem.join(names, "l_partkey").select(
        "src", F.concat(F.lit("o"), "l_orderkey").alias("dst"))
    return hotspots.orphans(symbol_table(t), e, limit=25)


@query("refactor_impact", f"""WITH {_E}, d AS (SELECT DISTINCT src, dst FROM e), p AS (SELECT src AS a, dst AS b FROM d UNION SELECT dst, src FROM d UNION SELECT src, src FROM d UNION SELECT dst, dst FROM d),
s AS (SELECT 'part:' || p_partkey AS name, 'src/' || p_brand AS file FROM part),
r AS (SELECT a AS symbol, count(DISTINCT b) AS symbols_affected, count(DISTINCT file) AS files_affected FROM p LEFT JOIN s ON name = b GROUP BY a)
SELECT *, round(greatest(0.1, 0.9 - 0.05 * least(files_affected, 10) - 0.02 * least(symbols_affected, 20) - 0.03), 6)::DOUBLE AS confidence FROM r""")
def refactor_impact(t):
    """Symbols and files within one hop, for every symbol."""
    s = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("file"))
    return hotspots.refactor_impact(supply_edges(t), s).withColumn("confidence", F.round("confidence", 6))


# --- ordered sequences --------------------------------------------------------
@query("sequential_edges", """WITH n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT 'chunk:' || conv_id || ':t-' || turn AS src, 'chunk:' || conv_id || ':t-' || nxt AS dst FROM n WHERE nxt IS NOT NULL""")
def sequential_edges(t):
    """Each turn to the next of its conversation."""
    chunks = t.conversations.select("conv_id", "turn", F.concat(F.lit("t-"), "turn").alias("chunk_id"))
    return edges.sequential_edges(chunks, ("conv_id",), "turn").select("src", "dst")


_LOG = ("CASE WHEN event_type = 'signup' THEN 'h' || event_id || '|user' || user_id || '|2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') "
        "WHEN event_type = 'error' THEN '  ' ELSE 'src/' || event_type || '/' || (event_id % 40) || '.rs' END")
_PARSED = f"""l AS (SELECT event_id, trim({_LOG}) AS line FROM events),
f AS (SELECT *, last_value(CASE WHEN contains(line, '|') THEN line END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM l WHERE line <> ''),
c AS (SELECT event_id, split_part(h, '|', 2) AS author, split_part(h, '|', 3) AS date, line AS path FROM f WHERE NOT contains(line, '|') AND h IS NOT NULL)"""


def _log(t):
    """The events as the lines of one change log: sign-ups are headers, errors blank lines."""
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    line = (F.when(F.col("event_type") == "signup", F.concat(F.lit("h"), "event_id", F.lit("|user"), "user_id", F.lit("|2024-01-"), day))
            .when(F.col("event_type") == "error", "  ")
            .otherwise(F.concat(F.lit("src/"), "event_type", F.lit("/"), F.col("event_id") % 40, F.lit(".rs"))))
    return t.events.select(F.col("event_id").alias("line_no"), line.alias("line"))


@query("log_forward_fill", f"WITH {_PARSED} SELECT event_id AS line_no, author, date, path FROM c")
def log_forward_fill(t):
    """Change log parsed by forward fill over one sequence, in ranges of 1000 lines."""
    return changelog.parse_log(_log(t), width=1000)


@query("log_hotspots", f"""WITH {_PARSED} SELECT path, count(*) AS modification_count, count(DISTINCT author) AS n_contributors, max(date) AS last_modified, 0.0::DOUBLE AS lines_changed
FROM c GROUP BY path ORDER BY modification_count DESC, path LIMIT 10""")
def log_hotspots(t):
    """A19 over S7: most modified files of the log."""
    return hotspots.most_modified(changelog.parse_log(_log(t), width=1000))


@query("numstat", """SELECT 'p' || l_partkey AS path, CAST(sum(l_linenumber + l_suppkey) AS BIGINT) AS lines_changed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey""")
def numstat(t):
    """Added and deleted lines per path, binary rows skipped."""
    binary = F.col("l_returnflag") == "R"
    line = F.concat_ws("\t", F.when(binary, "-").otherwise(F.col("l_linenumber").cast("string")),
                       F.when(binary, "-").otherwise(F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), "l_partkey"))
    return changelog.parse_numstat(t.lineitem.select(line.alias("line")))


@query("modified_hotspots", """SELECT 'supplier:' || l_suppkey AS path, count(*) AS modification_count, count(DISTINCT l_returnflag) AS n_contributors,
 strftime(max(l_shipdate), '%Y-%m-%d') AS last_modified, round(sum(l_quantity), 2) AS lines_changed FROM lineitem GROUP BY l_suppkey ORDER BY modification_count DESC, path LIMIT 10""")
def modified_hotspots(t):
    """Suppliers by number of changes."""
    changes = t.lineitem.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("path"), F.col("l_returnflag").alias("author"),
                                F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").alias("lines"))
    return hotspots.most_modified(changes).withColumn("lines_changed", F.round("lines_changed", 2))


@query("contributors", "SELECT DISTINCT 'supplier:' || l_suppkey AS path, l_returnflag AS author FROM lineitem")
def contributors(t):
    """Contributors of each path as rows."""
    return hotspots.contributors(t.lineitem.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("path"),
                                                   F.col("l_returnflag").alias("author")))
