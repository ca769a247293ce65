"""Iterative graph operators over edge tables.

Edges are (src, dst[, weight]). Each round is a join and an aggregate with
map-side combining, so a node holding a third of all edges is reduced before it
is shuffled and AQE splits its join partition; rounds are cut by reliable
checkpoints. The driver sees only counts.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import vectors as vx
from codeloom.operators.edges import undirected
from codeloom.operators.local_moving import JOB_ROUNDS, PackedLinks
from codeloom.operators.similarity import SCORE_DIGITS, neighbour_sums, similar_forest
from codeloom.session import cut_lineage

MAX_COMPONENT_ROUNDS = 100
FREE_ROWS = 100_000  # frontier rows up to which shortest paths follow every link


def of_types(edges: DataFrame, edge_types) -> DataFrame:
    return edges if edge_types is None else edges.filter(F.col("edge_type").isin(list(edge_types)))


# --- degree, neighbours -------------------------------------------------------
def degrees(edges: DataFrame) -> DataFrame:
    """(node, incoming, outgoing, total); a loop counts once on each side."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), none.alias("incoming"), one.alias("outgoing")),
        F.struct(F.col("dst").alias("node"), one.alias("incoming"), none.alias("outgoing")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"),
                                    (F.sum("incoming") + F.sum("outgoing")).alias("total"))


def impact_pairs(edges: DataFrame, edge_types=None) -> DataFrame:
    """Impact graph as distinct rows (src, target)."""
    return of_types(edges, edge_types).select("src", F.col("dst").alias("target")).distinct()


def neighbour_pairs(edges: DataFrame, edge_types=None) -> DataFrame:
    """Related nodes in either direction as distinct rows (node, related)."""
    rows = of_types(edges, edge_types).select("src", "dst")
    both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.select(F.col("src").alias("node"), F.col("dst").alias("related"))


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists; loops count, both directions are listed."""
    pairs = edges.select("src", "dst").distinct()
    reverse = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(reverse, ["src", "dst"], "left_semi")


# --- traversal ----------------------------------------------------------------
def reachable(edges: DataFrame, sources: DataFrame, max_depth: int = 5, edge_types=None) -> DataFrame:
    """Breadth-first reach of every source: (source, node, depth), depth in 1..max_depth.

    ``sources`` has one column ``source``. A source is in its own result only if
    it lies on a cycle. Depth is the shortest distance.
    """
    links = of_types(edges, edge_types).select("src", "dst").distinct()
    links = cut_lineage(links) if max_depth > 2 else links
    frontier = sources.select("source", F.col("source").alias("node")).distinct()
    seen = None
    for depth in range(1, max_depth + 1):
        step = (frontier.join(links, frontier["node"] == links["src"])
                .select("source", F.col("dst").alias("node")).distinct())
        if seen is not None:
            step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        fresh = cut_lineage(step.withColumn("depth", F.lit(depth)))
        seen = fresh if seen is None else seen.unionByName(fresh)
        if depth == max_depth or fresh.isEmpty():
            break
        frontier = fresh.select("source", "node")
    return seen


def _extent(table: DataFrame, column: str) -> tuple:
    """(rows, smallest, largest) of a written table's column."""
    return tuple(table.agg(F.count("*"), F.min(column), F.max(column)).first())


def _inside(table: DataFrame, column: str, extent: tuple) -> DataFrame:
    """Rows whose id lies in the extent: ids of other kinds stay in their files and are not shuffled."""
    return table.filter(F.col(column).between(F.lit(extent[1]), F.lit(extent[2])))


def _unseen(nodes: DataFrame, extent: tuple, levels) -> DataFrame:
    """Rows (source, node, ...) with nodes in the extent that are in no level."""
    for level in levels:
        nodes = nodes.join(_inside(level, "node", extent).select("source", "node"), ["source", "node"], "left_anti")
    return nodes


def _links_back(links: DataFrame, reached: DataFrame, targets: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Search against the links from targets (source, node) until nodes that their source has reached, ``rounds`` at most.

    Gives (source, node, best), the nodes next to reached ones with the rank of
    the best of these, and the links (source, src, dst) passed before.
    """
    reached = reached.select("source", F.col("node").alias("src"), F.col("rank").alias("best"))
    frontiers, passed, extent = [targets], [], _extent(targets, "node")
    while extent[0] and len(passed) < rounds:
        frontier, into = frontiers[-1], _inside(links, "dst", extent)
        step = (frontier.join(into, frontier["node"] == into["dst"]).select("source", "src", "dst")
                .join(_inside(reached, "src", _extent(into, "src")), ["source", "src"], "left"))
        # all reached parents of a node are one row
        passed.append(cut_lineage(step.groupBy("source", "dst", F.when(F.col("best").isNull(), F.col("src")).alias("src"))
                                  .agg(F.min("best").alias("best"))))
        beyond = passed[-1].filter(F.col("src").isNotNull()).select("source", F.col("src").alias("node"))
        frontiers.append(cut_lineage(_unseen(beyond.distinct(), _extent(beyond, "node"), frontiers)))
        extent = _extent(frontiers[-1], "node")
    rows = functools.reduce(DataFrame.unionByName, passed)
    return (rows.filter(F.col("src").isNull()).select("source", F.col("dst").alias("node"), "best"),
            rows.filter(F.col("src").isNotNull()).select("source", "src", "dst"))


def _paths(levels: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """(source, target, path) read back from the last level to the first by the ranks of the parents."""
    paths = None
    for level, hits in zip(reversed(levels), reversed(found)):
        here = hits.select("source", "target", "best", F.array("target").alias("path"))
        if paths is not None:
            parents = level.select(F.col("rank").alias("best"), "node", F.col("best").alias("above"))
            here = here.unionByName(paths.join(parents, "best").select(
                "source", "target", F.col("above").alias("best"), F.concat(F.array("node"), "path").alias("path")))
        paths = here
    return paths.drop("best")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, edge_types=None) -> DataFrame:
    """Shortest directed path of each pair (source, target): (source, target, path, length).

    At most ``max_depth`` edges; no path gives NULL and length 0; among equally
    short paths the lexicographically smallest wins.

    A node carries its path's rank among those of the same length and that of its
    best parent, never the path. When a frontier has more rows than ``FREE_ROWS``
    and than there are pairs without a path, the links that lead to their targets
    are looked up from there, and later rounds follow no others.
    """
    links = cut_lineage(of_types(edges, edge_types).select("src", "dst").dropna())
    wanted = cut_lineage(pairs.select("source", "target").dropna().distinct())
    aim = _extent(wanted, "target")
    missing, by_source, last = aim[0], False, 0
    step = wanted.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("best")).distinct()
    levels, found = [], []
    for depth in range(max_depth + 1):
        # ranks of parents, then node ids, order paths of one length as their ids in turn do
        level = cut_lineage(step.orderBy("best", "node").withColumn("rank", F.monotonically_increasing_id()))
        extent = _extent(level, "node")
        hits = cut_lineage(_inside(wanted, "target", extent).withColumnRenamed("target", "node")
                           .join(_inside(level, "node", aim), ["source", "node"])
                           .select("source", F.col("node").alias("target"), "best"))
        levels.append(level)
        found.append(hits)
        hit = hits.count()
        missing, last = missing - hit, depth if hit else last
        if not extent[0] or not missing or depth == max_depth:
            break
        if not by_source and extent[0] > max(FREE_ROWS, missing):
            targets = wanted
            for hits in found:
                targets = targets.join(hits, ["source", "target"], "left_anti")
            targets = cut_lineage(targets.withColumnRenamed("target", "node"))
            step, links = _links_back(links, level, targets, max_depth - depth)
            by_source = True
            continue
        out = _inside(links, "src", extent)
        same = level["node"] == out["src"]
        step = (level.join(out, same & (level["source"] == out["source"]) if by_source else same)
                .groupBy(level["source"], F.col("dst").alias("node")).agg(F.min("rank").alias("best")))
        step = _unseen(step, _extent(out, "dst"), levels)
    paths = _paths(levels[:last + 1], found[:last + 1])
    return (pairs.select("source", "target").join(paths, ["source", "target"], "left")
            .withColumn("length", F.coalesce(F.size("path") - 1, F.lit(0))))


# --- components ---------------------------------------------------------------
def _star(edges: DataFrame, smallest: DataFrame, only_larger: bool) -> DataFrame:
    joined = edges.join(smallest, "u")
    return joined.filter(F.col("v") > F.col("u")) if only_larger else joined.filter(F.col("v") != F.col("m"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the component is its smallest node id.

    Alternating large-star and small-star steps: O(log n) rounds also on long
    chains, and every step keeps the number of edges bounded by the input.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    current = cut_lineage(pairs.filter(F.col("u") != F.col("v")).distinct())
    everyone = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("node"))
    fingerprint = None
    for _ in range(MAX_COMPONENT_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both, smallest, True).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least, False).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = cut_lineage(small)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == fingerprint:
            break
        fingerprint = mark
    else:
        raise RuntimeError("components did not settle")
    return (everyone.distinct().join(current, F.col("node") == F.col("u"), "left")
            .select("node", F.coalesce("v", "node").alias("component")))


# --- density clusters ---------------------------------------------------------
def density_clusters(pairs: DataFrame, vectors: DataFrame, eps: float, min_points: int = 3) -> DataFrame:
    """DBSCAN on cosine distance from pairs of distinct vectors: (id, cluster), NULL for noise.

    ``pairs`` (src, dst, score) must hold all pairs with 1 - score < eps;
    ``vectors`` (id, copies) the distinct vectors. A neighbour is closer than eps
    (strictly), the point itself and its copies count.
    """
    close = cut_lineage(pairs.filter((1 - F.col("score")) < eps).select("src", "dst"))
    both = undirected(close)
    weights = vectors.select("id", "copies")
    around = (both.join(weights, both["dst"] == weights["id"]).groupBy("src").agg(F.sum("copies").alias("around")))
    core = (vectors.join(around, vectors["id"] == around["src"], "left")
            .filter(F.coalesce("around", F.lit(0)) + F.col("copies") >= min_points).select("id"))
    core = cut_lineage(core)
    core_src = core.select(F.col("id").alias("src"))
    core_dst = core.select(F.col("id").alias("dst"))
    inner = both.join(core_src, "src", "left_semi").join(core_dst, "dst", "left_semi")
    labels = connected_components(inner, core.select(F.col("id").alias("node")))
    labels = labels.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    # a border point goes to the cluster of its smallest core neighbour
    touching = both.join(core_src, "src", "left_anti").join(labels, both["dst"] == labels["id"])
    border = touching.groupBy("src").agg(F.min_by("cluster", "dst").alias("cluster")).select(
        F.col("src").alias("id"), "cluster")
    return vectors.select("id").join(labels.unionByName(border), "id", "left")


def vector_clusters(vectors: DataFrame, eps: float, min_points: int = 3, vector: str = "embedding") -> DataFrame:
    """``density_clusters`` straight from distinct vectors (id, vector, copies): (id, cluster), NULL for noise.

    Neighbours are counted and core points linked inside the tiles of the similarity join, so close pairs are never rows.
    """
    around = neighbour_sums(vectors, 1 - eps, "id", vector, weight="copies", by_score=False, within=eps).select("id", "total")
    is_core = F.coalesce("total", F.lit(0.0)) + F.col("copies") >= min_points
    marked = cut_lineage(vectors.join(around, "id", "left").select("id", vector, is_core.alias("core")))
    links = cut_lineage(similar_forest(marked, 1 - eps, "id", vector, core="core", within=eps))
    labels = connected_components(links.filter("is_core").select("src", "dst"), marked.filter("core").select(F.col("id").alias("node")))
    labels = cut_lineage(labels.select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    # a border point goes to the cluster of its smallest core neighbour
    nearest = links.filter("NOT is_core").groupBy("src").agg(F.min("dst").alias("dst"))
    border = nearest.join(labels, nearest["dst"] == labels["id"]).select(F.col("src").alias("id"), "cluster")
    return vectors.select("id").join(labels.unionByName(border), "id", "left")


# --- communities --------------------------------------------------------------
def _symmetric(edges: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter(F.col("src") != F.col("dst"))
    both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def class_links(pairs: DataFrame, classes: DataFrame, threshold: float, vector: str = "embedding") -> DataFrame:
    """The graph of all rows with equal ones drawn together: links (src, dst, weight) in both directions, with loops.

    ``pairs`` (src, dst, score) are pairs of distinct vectors, ``classes`` (id, vector, copies) all of these. A link of two
    classes weighs what the pairs of their copies weigh together, and a loop what the pairs inside a class do in both
    directions, if copies are as alike as ``threshold`` asks. So n copies make one node and not n (n - 1) / 2 links, and strengths,
    gains and modularity of a partition that keeps copies together are those of the graph of all rows.
    """
    size = classes.select("id", F.col("copies").cast("double").alias("n"))
    a, b = size.select(F.col("id").alias("src"), F.col("n").alias("na")), size.select(F.col("id").alias("dst"), F.col("n").alias("nb"))
    weighed = cut_lineage(pairs.join(a, "src").join(b, "dst").select("src", "dst", (F.col("score") * F.col("na") * F.col("nb")).alias("weight")))
    own = F.round(vx.dot(F.col(vector), F.col(vector)), SCORE_DIGITS)
    loops = classes.filter("copies > 1").select("id", own.alias("score"), F.col("copies").cast("double").alias("n")).filter(F.col("score") >= threshold)
    return weighed.unionByName(weighed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).unionByName(
        loops.select(F.col("id").alias("src"), F.col("id").alias("dst"), (F.col("score") * F.col("n") * (F.col("n") - 1)).alias("weight")))


def class_modularity(links: DataFrame, membership: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (node, community) of ``class_links``."""
    return _modularity(links, membership)


def class_communities(links: DataFrame, rounds: int = 2000, levels: int = 1) -> DataFrame:
    """Communities of ``class_links``: (node, community); copies are in one community from the start."""
    return _communities(cut_lineage(links), rounds, levels)


def modularity(edges: DataFrame, membership: DataFrame, adjacent_only: bool = False) -> DataFrame:
    """One row (modularity) of a partition (node, community) of undirected edges.

    Standard form sum_c (in_c / 2m - (tot_c / 2m)^2). ``adjacent_only`` sums the
    null model over adjacent pairs alone.
    """
    return _modularity(_symmetric(edges), membership, adjacent_only)


def vector_modularity(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding", community: str = "label",
                      copies: str | None = None, adjacent_only: bool = False) -> DataFrame:
    """``modularity`` of the similarity graph of ``vectors`` with their communities, strengths summed inside the tiles of the join.

    With ``copies`` a row stands for so many equal ones, as in ``class_links``. The similar pairs are never rows.
    """
    size = F.lit(1.0) if copies is None else F.col(copies).cast("double")
    own = F.round(vx.dot(F.col(vector), F.col(vector)), SCORE_DIGITS)
    loop = F.when((size > 1) & (own >= threshold), own * size * (size - 1)).otherwise(F.lit(0.0))
    around = neighbour_sums(vectors, threshold, vec_id, vector, weight=copies, group=community).withColumnRenamed("id", vec_id)
    facts = vectors.select(vec_id, F.col(community).alias("community"), size.alias("n"), loop.alias("loop"))
    rows = cut_lineage(facts.join(around, vec_id, "left").filter("total IS NOT NULL OR loop > 0").select(
        F.col(vec_id).alias("node"), "community", "n", (F.coalesce("total", F.lit(0.0)) * F.col("n") + F.col("loop")).alias("k"),
        (F.coalesce("inside", F.lit(0.0)) * F.col("n") + F.when(F.col("community").isNotNull(), F.col("loop")).otherwise(F.lit(0.0))).alias("k_in"),
        F.when(F.col("community").isNotNull() & (F.col("loop") > 0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("loops")))
    m2 = rows.agg(F.sum("k").alias("m2")).scalar()
    if adjacent_only:
        strong = vectors.join(rows.select(F.col("node").alias(vec_id), "k"), vec_id).select(vec_id, vector, community, "k")
        theirs = neighbour_sums(strong, threshold, vec_id, vector, weight="k", group=community, by_score=False).select(F.col("id").alias("node"), "inside")
        null_model = F.col("k") * (F.coalesce("inside", F.lit(0.0)) + F.col("loops") * F.col("k"))
        return rows.join(theirs, "node", "left").agg(F.coalesce(F.sum(F.col("k_in") - null_model / m2) / m2, F.lit(0.0)).alias("modularity"))
    per = rows.groupBy("community").agg(F.sum("k").alias("w_tot"), F.sum("k_in").alias("w_in"))
    return per.agg(F.coalesce(F.sum(F.col("w_in") / m2 - F.pow(F.col("w_tot") / m2, 2)), F.lit(0.0)).alias("modularity"))


def _modularity(links: DataFrame, membership: DataFrame, adjacent_only: bool = False) -> DataFrame:
    strength = links.groupBy("src").agg(F.sum("weight").alias("k"))
    member = membership.select("node", "community")
    total = strength.agg(F.sum("k").alias("m2"))
    placed = strength.join(member, strength["src"] == member["node"]).select("node", "community", "k")
    a = placed.select(F.col("node").alias("src"), F.col("community").alias("ca"), F.col("k").alias("ka"))
    b = placed.select(F.col("node").alias("dst"), F.col("community").alias("cb"), F.col("k").alias("kb"))
    same = links.join(a, "src").join(b, "dst").filter(F.col("ca") == F.col("cb"))
    m2 = total.scalar()
    if adjacent_only:
        return same.agg(F.coalesce(F.sum(F.col("weight") - F.col("ka") * F.col("kb") / m2) / m2, F.lit(0.0))
                        .alias("modularity"))
    inside = same.groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w_in"))
    totals = placed.groupBy("community").agg(F.sum("k").alias("w_tot"))
    per = totals.join(inside, "community", "left")
    share = F.coalesce("w_in", F.lit(0.0)) / m2 - F.pow(F.col("w_tot") / m2, 2)
    return per.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("modularity"))


def _local_moving(links: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """Parallel local moving: in a round half of the nodes may move to their best neighbour community.

    The round also gives the weight of each node's links into its own community, hence the quality of the state before it.
    """
    packed = PackedLinks(links)
    try:
        state, m2 = packed.state, packed.m2
        if m2 <= 1e-9:
            return state.select("node", "community"), 0.0
        best, best_q, still = state, -2.0, 0
        for first in range(0, rounds + 1, JOB_ROUNDS):
            moved = packed.rounds(state, first)
            sums = [f(F.get(c, F.lit(r))) for r in range(JOB_ROUNDS) for f, c in ((F.sum, "inside"), (F.sum, "outside"), (F.count_if, "wants"))]
            sums = moved.agg(*[x.alias(f"s{n}") for n, x in enumerate(sums)]).first()
            for r in range(JOB_ROUNDS):
                inside, null_model, wanting = sums[3 * r:3 * r + 3]
                q = (inside + packed.loops) / m2 - null_model / (m2 * m2)
                # single nodes are where it starts, not a partition found
                if first + r > 0 or not wanting:
                    seen = moved.select("node", F.get("seen", F.lit(r)).alias("community"))
                    best, best_q, still = (seen, q, 0) if q > best_q + 1e-12 else (best, best_q, still + 1)
                # a node that wants to move has its turn in every other round: many rounds without progress mean moves to and fro
                if not wanting or still >= 8:
                    return best, best_q
            state = moved.select("node", "community", "k", "home", "parts")
        raise RuntimeError(f"communities did not settle in {rounds} rounds")
    finally:
        packed.drop()


def louvain(edges: DataFrame, rounds: int = 2000, levels: int = 1) -> DataFrame:
    """Communities of weighted undirected edges: (node, community), the smallest member as id.

    Local moving in parallel; nodes take turns by a hash so that two neighbours
    do not swap places. It is done when no node wants to move, or with the best partition seen once eight rounds bring no gain; a graph that
    has not settled after ``rounds`` is an error. ``levels`` > 1 adds
    aggregation levels on the community graph.
    """
    # links of a node lie together, so that a round adds them up before it shuffles
    return _communities(cut_lineage(_symmetric(edges).hint("rebalance", "src")), rounds, levels)


def _communities(links: DataFrame, rounds: int, levels: int) -> DataFrame:
    membership, _ = _local_moving(links, rounds)
    for _ in range(levels - 1):
        a = membership.select(F.col("node").alias("src"), F.col("community").alias("ca"))
        b = membership.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
        lifted = (links.join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.sum("weight").alias("weight"))
                  .select(F.col("ca").alias("src"), F.col("cb").alias("dst"), "weight"))
        upper, _ = _local_moving(cut_lineage(lifted), rounds)
        up = upper.select(F.col("node").alias("community"), F.col("community").alias("upper"))
        membership = cut_lineage(membership.join(up, "community", "left").select(
            "node", F.coalesce("upper", "community").alias("community")))
    ids = membership.groupBy("community").agg(F.min("node").alias("id"))
    return membership.join(ids, "community").select("node", F.col("id").alias("community"))
