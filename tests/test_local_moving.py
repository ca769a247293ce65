"""Rounds of local moving over packed links."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, local_moving


def _plain_round(links, community, k, m2):
    """(best community or None, weight of links into the own one) of each node, by dictionaries."""
    sigma, found = {}, {}
    for node, c in community.items():
        sigma[c] = sigma.get(c, 0.0) + k[node]
    for node, own in community.items():
        near = {}
        for (src, dst), w in links.items():
            if src == node != dst:
                near[community[dst]] = near.get(community[dst], 0.0) + w
        k_own, m = near.get(own, 0.0), m2 / 2
        gains = {c: (w - k_own) / m - k[node] * (sigma[c] - sigma[own] + k[node]) / (2 * m * m) for c, w in near.items() if c != own}
        good = [(-round(g, 12), c) for c, g in gains.items() if g > 1e-12]
        found[node] = (min(good)[1] if good else None, k_own)
    return found


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rounds_equal_plain_rounds(spark, monkeypatch, kind):
    """Several parts and chunks, links given twice, loops, a node with a loop only; links are not shuffled again."""
    monkeypatch.setattr(local_moving, "LEAST_LINKS", 40)
    rng = np.random.default_rng(4)
    name = (lambda i: int(i)) if kind == "bigint" else (lambda i: f"n{i}")
    rows = [(name(a), name(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.random(150) + .1) if a != b]
    rows += [(b, a, w) for a, b, w in rows] + [(name(3), name(3), 2.0), (name(77), name(77), 1.0)]
    links, k = {}, {}
    for a, b, w in rows:
        links[a, b] = links.get((a, b), 0.0) + w
        k[a] = k.get(a, 0.0) + w
    packed = local_moving.PackedLinks(spark.createDataFrame(rows, f"src {kind}, dst {kind}, weight double"), chunk=7)
    try:
        assert len(packed.labels) > 3 and abs(packed.m2 - sum(k.values())) < 1e-9 and packed.loops == 3.0
        moved = packed.rounds(packed.state, 5, 3)
        got = {r.node: r for r in moved.collect()}
        turns = {r.node: r.t for r in packed.state.select("node", F.array(*[F.pmod(F.xxhash64("node", F.lit(5 + r)), F.lit(2)) for r in range(3)]).alias("t")).collect()}
    finally:
        packed.drop()
    community = {node: node for node in k}
    for r in range(3):
        want = _plain_round(links, community, k, packed.m2)
        sigma = {c: sum(k[n] for n in community if community[n] == c) for c in community.values()}
        for node, (better, k_own) in want.items():
            assert got[node].seen[r] == community[node] and got[node].wants[r] == (better is not None)
            assert abs(got[node].inside[r] - k_own) < 1e-9 and abs(got[node].outside[r] - k[node] * sigma[community[node]]) < 1e-9
        community = {n: want[n][0] if want[n][0] is not None and turns[n][r] == 0 else c for n, c in community.items()}
    assert {n: row.community for n, row in got.items()} == community and set(got) == set(k)


def test_links_of_a_node_stay_in_one_chunk():
    src = pa.chunked_array([[5, 5, 5, 5, 1, 9, 9]])
    dst = pa.chunked_array([[1, 9, 5, 7, 5, 5, 5]])
    nodes, own, strength, loop, chunks = local_moving.pack_part(src, dst, np.arange(1.0, 8.0), 2)
    assert nodes.to_pylist() == [1, 5, 7, 9] and own.tolist() == [True, True, False, True]
    assert strength.tolist() == [5, 10, 0, 13] and loop.tolist() == [0, 3, 0, 0]
    assert [(s.tolist(), c.tolist(), d.tolist(), w.tolist()) for s, c, d, w in chunks] == [
        ([0], [1], [1], [5]), ([1], [3], [0, 2, 3], [1, 4, 2]), ([3], [1], [1], [13])]


def test_a_graph_without_weight_stays_single(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    assert graph.louvain(none).collect() == []
