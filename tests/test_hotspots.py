"""Symbols and files within one hop."""

from codeloom.operators import hotspots


def test_refactor_impact_counts_itself_without_pairs(spark):
    """Loops, double edges and edges both ways count once; a symbol's own file counts."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("a", "a"), ("c", "c"), ("b", "d")], "src string, dst string")
    symbols = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f1"), ("d", None), ("x", "f9")], "name string, file string")
    out = hotspots.refactor_impact(edges, symbols)
    assert {(r.symbol, r.symbols_affected, r.files_affected) for r in out.collect()} == {("a", 2, 2), ("b", 3, 2), ("c", 1, 1), ("d", 2, 1)}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    exploded = text[text.index("explode(array("):].split("\n")[0]
    assert exploded.count("struct(") == 2  # two rows an edge, not four


def test_refactor_impact_shuffles_an_edge_once(spark):
    """Ends of other kinds are not looked up, nulls and double edges count as before, and the pairs are one shuffle for both counts."""
    rows = [("a1", "p1"), ("p1", "a1"), ("p1", "p2"), ("p2", "p2"), ("a2", "p3"), ("z1", "p2"), ("z1", "p1"), ("z1", "a1"), (None, "p1"), ("a2", None)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    symbols = spark.createDataFrame([("p1", "f1"), ("p2", "f1"), ("p3", None), ("p9", "f2")], "name string, file string")
    out = hotspots.refactor_impact(edges, symbols)
    want = {}
    for a, b in {(a, b) for s, d in rows for a, b in ((s, d), (d, s))}:
        near, files = want.setdefault(a, (set(), set()))
        if a is not None and b is not None:
            near.add(b)
        files |= {{"p1": "f1", "p2": "f1", "p9": "f2"}.get(x) for x in (a, b)} - {None}
    got = {(r.symbol, r.symbols_affected, r.files_affected) for r in out.collect()}
    assert got == {(a, len(near - {a}) + 1, len(files)) for a, (near, files) in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # made distinct as one row an edge, and what is looked up is not filtered below that, where it would be another shuffle
    pairs = [line for line in plan.split("\n") if "Aggregate [u#" in line]
    assert len(pairs) == 2 and not any("Filter" in line and ">= p1" in line for line in plan.split("\n"))
    none = spark.createDataFrame([], "name string, file string")
    assert {(r.symbol, r.symbols_affected, r.files_affected) for r in hotspots.refactor_impact(edges, none).collect()} == {(a, n, 0) for a, n, _ in got}
