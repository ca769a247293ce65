import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import blocks, communities, embedding, graph, similarity
from codeloom.session import cut_lineage


def _clustered(n=400, dim=16, seed=3):
    """Vectors around a few centres, a third of them exact copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.25 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x


@pytest.fixture(scope="module")
def vectors(spark):
    x = _clustered()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    return x.astype(np.float64), df.repartition(4)


@pytest.mark.parametrize("cell_rows", [50_000, 40])
def test_similar_pairs_equal_brute_force(vectors, cell_rows):
    x, df = vectors
    sims = np.round(x @ x.T, similarity.SCORE_DIGITS)
    i, j = np.nonzero(np.triu(sims >= 0.8, 1))
    got = [(r.src, r.dst) for r in similarity.similar_pairs(df, 0.8, cell_rows=cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist()))


def test_links_connect_what_all_pairs_connect(vectors):
    x, df = vectors
    every = graph.connected_components(similarity.similar_pairs(df, 0.8)).collect()
    links = similarity.similarity_links(df, 0.8)
    assert {tuple(r) for r in graph.connected_components(links).collect()} == {tuple(r) for r in every}
    copies = len(x) // 3
    assert links.filter("src = 0").filter(F.col("dst") < copies).count() == copies - 1


@pytest.mark.parametrize("cell_rows", [50_000, 40])
def test_top_k_equals_brute_force(vectors, cell_rows):
    x, df = vectors
    sims = np.round(x @ x.T, similarity.SCORE_DIGITS)
    got = {}
    for r in similarity.top_k(df, df, 3, mode="full", cell_rows=cell_rows).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst, r.score))
    for src in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != src), key=lambda j: (-sims[src, j], j))[:3]
        mine = sorted(got[src])
        # equal up to the last digit of products that tie
        assert np.allclose([s for *_, s in mine], sims[src, order], atol=1e-8)


def test_density_clusters_equal_brute_force(spark, vectors):
    x, df = vectors
    eps, min_points = 0.15, 4
    close = (1 - np.round(x @ x.T, similarity.SCORE_DIGITS)) < eps
    core = close.sum(axis=1) >= min_points
    label = [None] * len(x)
    for start in np.nonzero(core)[0]:
        if label[start] is None:
            stack, label[start] = [start], int(start)
            while stack:
                for j in np.nonzero(close[stack.pop()] & core)[0]:
                    if label[j] is None:
                        label[j] = int(start)
                        stack.append(j)
    for i in np.nonzero(~core)[0]:
        near = np.nonzero(close[i] & core)[0]
        label[i] = label[near[0]] if len(near) else None
    reps = similarity.distinct_vectors(df, "vec_id", "embedding")
    pairs = similarity.similar_pairs(reps, 1 - eps, vec_id="id")
    found = graph.density_clusters(pairs, reps, eps, min_points)
    rows = similarity.copy_members(df, reps, "vec_id", "embedding").join(found, "id").collect()
    assert {r.member: r.cluster for r in rows} == dict(enumerate(label))


def test_louvain_finds_two_cliques(spark):
    rows = [(0, 1, .9), (0, 2, .9), (1, 2, .9), (3, 4, .9), (3, 5, .9), (4, 5, .9), (2, 3, .1)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    member = graph.louvain(e)
    got = {r.node: r.community for r in member.collect()}
    assert len({got[0], got[1], got[2]}) == 1 and len({got[3], got[4], got[5]}) == 1 and got[0] != got[3]
    assert graph.modularity(e, member).first()[0] > 0.3


def test_components_of_a_long_chain_and_a_hub(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(5, 5)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(60))


def test_reach_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")], "src string, dst string")
    reach = graph.reachable(e, spark.createDataFrame([("a",)], "source string"), 5)
    assert {(r.node, r.depth) for r in reach.collect()} == {("b", 1), ("d", 1), ("c", 2), ("a", 3)}
    pairs = spark.createDataFrame([("a", "c"), ("a", "a"), ("c", "x")], "source string, target string")
    got = {(r.source, r.target): (r.path, r.length) for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {("a", "c"): (["a", "b", "c"], 2), ("a", "a"): (["a"], 0), ("c", "x"): (None, 0)}


def _plain_path(edges, source, target, max_depth):
    level, seen = {source: [source]}, set()
    for _ in range(max_depth + 1):
        if target in level:
            return level[target], len(level[target]) - 1
        seen |= set(level)
        steps = [path + [dst] for node, path in level.items() for src, dst in edges if src == node and dst not in seen]
        level = {path[-1]: path for path in sorted(steps, reverse=True)}
    return None, 0


@pytest.mark.parametrize("free_rows", [0, 10**6])
def test_paths_equal_a_plain_search(spark, monkeypatch, free_rows):
    monkeypatch.setattr(graph, "FREE_ROWS", free_rows)
    draw = random.Random(5)
    nodes = [f"{kind}{i}" for kind in "ab" for i in range(20)]
    rows = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(80)] + [(None, "a1"), ("a1", None)]
    wanted = [(draw.choice(nodes[::9]), draw.choice(nodes + ["z"])) for _ in range(10)] + [(None, "a1"), ("a1", None)]
    e = spark.createDataFrame(rows + rows[:5], "src string, dst string")
    got = graph.shortest_paths(e, spark.createDataFrame(wanted, "source string, target string"), 6).collect()
    links = [row for row in rows if None not in row]
    want = [(s, t, *(_plain_path(links, s, t, 6) if s and t else (None, 0))) for s, t in wanted]
    assert sorted(map(str, want)) == sorted(str((r.source, r.target, r.path, r.length)) for r in got)
    assert max(length for *_, length in want) > 3 and any(path is None for _, _, path, _ in want)


def test_paths_write_no_more_rows_than_links(spark, monkeypatch):
    written = []

    def recorded(df):
        table = cut_lineage(df)
        written.append((table.count(), [kind for _, kind in table.dtypes]))
        return table

    monkeypatch.setattr(graph, "FREE_ROWS", 10, raising=False)
    monkeypatch.setattr(graph, "cut_lineage", recorded)
    rows = ([(f"s{i}", "hub") for i in range(5)] + [("hub", f"m{i}") for i in range(50)]
            + [(f"m{i % 50}", f"leaf{i}") for i in range(500)])
    pairs = spark.createDataFrame([(f"s{i % 5}", f"leaf{i * 20}") for i in range(25)], "source string, target string")
    got = graph.shortest_paths(spark.createDataFrame(rows, "src string, dst string"), pairs).collect()
    assert {tuple(r.path) for r in got} == {(f"s{i % 5}", "hub", f"m{i * 20 % 50}", f"leaf{i * 20}") for i in range(25)}
    # every source reaches every leaf, but no table holds sources times leaves, and none holds paths
    assert max(count for count, _ in written) <= len(rows)
    assert not any(kind.startswith("array") for _, kinds in written for kind in kinds)


def test_cohesion_of_one_member_is_one(spark):
    df = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0]), ("y", [0.0, 1.0])], "g string, embedding array<float>")
    assert {r.g: r.cohesion for r in embedding.cohesion(df, ["g"]).collect()} == {"x": 1.0, "y": 0.0}


def test_model_embedder_runs_per_batch(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "k bigint, text string")
    out = embedding.model_embedding(df, "text", ["k"], lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.k: r.embedding[0] for r in out.collect()} == {i: float(i) for i in range(70)}


def test_label_prefix(spark):
    df = spark.createDataFrame([(1, "parse_symbols"), (1, "parse_file"), (1, "parse_chunk")], "community bigint, symbol string")
    assert communities.fallback_labels(df).first().label == "parse"


def test_merge_blocks(spark):
    def row(i, chunk_id, symbols, kinds, community=None):
        return ("f", i, chunk_id, i + 1, symbols, kinds, community, None, [i - 1, i + 1])

    rows = [row(0, "fn::a:0-1", ["a"], ["function"]), row(1, "fn::b:2-3", ["b"], ["function"]),
            row(2, "struct::S:4-5", ["S"], ["struct"], 7), row(3, "struct::T:6-7", ["T"], ["field"], 7),
            row(4, "fn::c:8-9", ["c"], ["x"])]
    df = spark.createDataFrame(rows, "path string, chunk_ord bigint, chunk_id string, block bigint, containing_symbols array<string>, "
                                     "kinds array<string>, community bigint, embedding array<float>, links array<bigint>")
    got = {r.chunk_ord: r.unit for r in blocks.merge_blocks(df).collect()}
    # same kinds join; another top-level kind never does; a shared community joins
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_ranges_do_not_change_sequence_results(spark):
    from codeloom.functions.ordered import forward_fill, running_sum, shift_value

    df = spark.range(500).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("o"),
                                 F.when(F.col("id") % 17 == 0, F.col("id")).alias("v"))
    results = []
    for width in (7, 1000):
        out = forward_fill(df, ["k"], "o", F.col("v"), "fill", width)
        out = shift_value(out, ["k"], "o", F.col("o"), "next", width=width)
        out = shift_value(out, ["k"], "o", F.col("v"), "prev", back=True, width=width)
        out = running_sum(out, ["k"], "o", F.coalesce("v", F.lit(0)), "total", width)
        results.append({r.o: tuple(r) for r in out.collect()})
    assert len(results[0]) == 500 and results[0] == results[1]


def test_class_graph_equals_the_graph_of_all_rows(spark):
    """Three groups of near vectors, with many copies of some: one node a class, same communities and modularity."""
    import random

    from codeloom.operators import graph, similarity

    rng, rows = random.Random(2), []
    for group in range(3):
        for k in range(6):
            v = [1.0 if d == group else 0.25 * rng.random() for d in range(3)]
            size = sum(x * x for x in v) ** .5
            rows += [[x / size for x in v]] * (40 if k == 0 else rng.randint(1, 3))
    rows += [[0.0] * 3] * 5  # copies that are not alike
    rng.shuffle(rows)
    df = spark.createDataFrame([(n, v) for n, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    classes = similarity.distinct_vectors(df, "vec_id", "embedding")
    pairs = similarity.similar_pairs(classes, 0.6, vec_id="id")
    links = graph.class_links(pairs, classes, 0.6)
    assert links.count() < 19 * 19 < similarity.similar_pairs(df, 0.6).count()
    by_class = graph.class_communities(links)
    every = similarity.similar_pairs(df, 0.6).withColumnRenamed("score", "weight")
    members = similarity.copy_members(df, classes, "vec_id", "embedding")
    spread = members.join(by_class, members["id"] == by_class["node"]).select(members["member"].alias("node"), "community")
    found = {r.node: r.community for r in spread.collect()}
    assert found == {r.node: r.community for r in graph.louvain(every).collect()} and len(set(found.values())) == 3
    q = graph.modularity(every, spread).first()[0]
    assert abs(q - graph.class_modularity(links, by_class).first()[0]) < 1e-9 and q > 0.5

def test_queries_of_another_id_type_visit_cells(spark):
    """Ids of queries are text, those of the base numbers, and there are several cells."""
    rng = np.random.default_rng(5)
    unit = lambda n: (x := rng.normal(size=(n, 8))) / np.linalg.norm(x, axis=1)[:, None]
    q, b = unit(20), unit(300)
    queries = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(q)], "symbol string, embedding array<double>")
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "vec_id long, embedding array<double>")
    found = similarity.top_k(queries, base, 3, query_id="symbol", cell_rows=50).collect()
    want = {(f"s{i}", int(j)) for i, row in enumerate(np.round(q @ b.T, 9)) for j in np.argsort(-row, kind="stable")[:3]}
    assert {(r["src"], r["dst"]) for r in found} == want


def test_normalise_keeps_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    """SQL rounds a tiny negative component to -0.0."""
    from codeloom import catalog

    rows = [(0, [1.0, -1e-8]), (1, [1.0, 1e-8]), (2, [0.0, 3.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    units = {r["vec_id"]: str(r["unit"]) for r in catalog.queries()["normalise"](spark, str(tmp_path)).collect()}
    assert units == {0: "[1.0, -0.0]", 1: "[1.0, 0.0]", 2: "[0.0, 1.0]"}


def test_small_cells_are_visited_by_groups(spark):
    """1,600 vectors in 32 cells of 50: a row goes to groups of about a block and not to every cell."""
    x = _clustered(n=1600)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<float>")
    cells = similarity.build_cells(df, cell_rows=50)
    assert len(cells.pivots) == 32 and len(cells.count) <= 1600 // cells.block + 1 and cells.count.sum() == 1600
    sims = np.round(x.astype(np.float64) @ x.astype(np.float64).T, similarity.SCORE_DIGITS)
    np.fill_diagonal(sims, -np.inf)
    got = {(r.src, r["rank"]): r.dst for r in similarity.top_k(df, df, 4, query_id="id", base_id="id", vector="vec", mode="full", cell_rows=50).collect()}
    assert got == {(i, n + 1): int(j) for i, row in enumerate(sims) for n, j in enumerate(np.argsort(-row, kind="stable")[:4])}


@pytest.mark.parametrize("cell_rows", [50_000, 40])
def test_modularity_is_summed_in_tiles(spark, vectors, cell_rows):
    """Equal to the modularity of the pairs as rows; no tile gives more rows than its blocks have."""
    x, df = vectors
    sums = similarity.neighbour_sums(df, 0.8, cell_rows=cell_rows)
    sims = np.round(x @ x.T, similarity.SCORE_DIGITS)
    np.fill_diagonal(sims, 0.0)
    strength = np.where(sims >= 0.8, sims, 0.0).sum(axis=1)
    got = {r.id: r.total for r in sums.collect()}
    assert np.allclose([got.get(i, 0.0) for i in range(len(x))], strength)
    labelled = df.withColumn("label", F.when(F.col("vec_id") % 5 > 0, F.concat(F.lit("l"), F.col("vec_id") % 5)))
    member = labelled.select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    every = similarity.similar_pairs(df, 0.8).withColumnRenamed("score", "weight")
    for adjacent in (False, True):
        want = graph.modularity(every, member, adjacent).first()[0]
        assert abs(graph.vector_modularity(labelled, 0.8, adjacent_only=adjacent).first()[0] - want) < 1e-9
    reps = similarity.distinct_vectors(df, "vec_id", "embedding").withColumn("label", F.col("id") % 3)
    links = graph.class_links(similarity.similar_pairs(reps, 0.8, vec_id="id"), reps, 0.8)
    want = graph.class_modularity(links, reps.select(F.col("id").alias("node"), F.col("label").alias("community"))).first()[0]
    assert abs(graph.vector_modularity(reps, 0.8, "id", copies="copies").first()[0] - want) < 1e-9


@pytest.mark.parametrize("cell_rows", [50_000, 40])
def test_clusters_of_vectors_equal_clusters_of_pairs(spark, vectors, cell_rows):
    """A tile gives a forest: fewer links than rows, the same components and border points."""
    x, df = vectors
    forest = similarity.similar_forest(df, 0.8, cell_rows=cell_rows)
    every = similarity.similar_pairs(df, 0.8)
    assert {tuple(r) for r in graph.connected_components(forest).collect()} == {tuple(r) for r in graph.connected_components(every).collect()}
    assert forest.count() < every.count() / 2
    reps = similarity.distinct_vectors(df, "vec_id", "embedding")
    for eps in (0.04, 0.15):
        pairs = similarity.similar_pairs(reps, 1 - eps, vec_id="id")
        want = {r.id: r.cluster for r in graph.density_clusters(pairs, reps, eps, 4).collect()}
        assert {r.id: r.cluster for r in graph.vector_clusters(reps, eps, 4).collect()} == want


@pytest.mark.parametrize("cell_rows", [50_000, 40])
def test_copies_go_to_tiles_once(spark, vectors, monkeypatch, cell_rows):
    """Equal vectors are one row for the tiles, more than max_members several; pairs leave in small batches and none is lost."""
    x, df = vectors
    dealt = []
    old = similarity._self_tiles
    monkeypatch.setattr(similarity, "_self_tiles", lambda base, *rest: dealt.append(base.count()) or old(base, *rest))
    i, j = np.nonzero(np.triu(np.round(x @ x.T, similarity.SCORE_DIGITS) >= 0.8, 1))
    distinct, copies = len(np.unique(x, axis=0)), len(x) // 3
    for limits in ({}, {"max_members": 10, "batch_pairs": 7}):
        got = [(r.src, r.dst) for r in similarity.similar_pairs(df, 0.8, cell_rows=cell_rows, **limits).collect()]
        assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist()))
    assert dealt[0] == distinct and distinct < dealt[1] <= distinct + 2 * copies / 10


def test_pairs_of_classes_come_in_bounded_batches():
    import pyarrow as pa

    left, right = pa.array([[1, 9], [4]]), pa.array([[2, 3, 7], [5], [8, 6]])
    i, j = np.array([0, 0, 1, 1]), np.array([0, 2, 1, 0])
    got = list(similarity.member_pairs(left, right, i, j, np.array([.1, .2, .3, .4]), 4))
    assert [len(src) for src, *_ in got] == [6, 4, 4]
    rows = [(s, d, v) for src, dst, score, _ in got for s, d, v in zip(src.to_pylist(), dst.to_pylist(), score.to_pylist())]
    want = [(min(a, b), max(a, b), v) for x, y, v in zip(i, j, (.1, .2, .3, .4)) for a in left[int(x)].as_py() for b in right[int(y)].as_py()]
    assert rows == want
