"""Imports, calls and type uses of small crates."""

from pyspark.sql import functions as F

from codeloom.operators import definitions as defs, dependencies as deps
from codeloom.sources import tree

FILES = {
    "one/src/lib.rs": "pub mod net;\npub fn start() {\n    crate::net::open(1);\n    helper();\n}\npub struct Config;\n",
    "one/src/net/mod.rs": ("use super::Config;\nuse self::wire::{Frame as Packet, send};\nuse std::{fmt, io::{self, Read}};\n"
                           "pub fn open(x: i32) -> Config {\n    send(Packet::new());\n    // close()\n    let s = \"send(1)\";\n    start()\n}\nfn close() {}\n"),
    "one/src/net/wire.rs": ("pub struct Frame;\nimpl Frame {\n    pub fn new() -> Frame {\n        Self::check();\n        Frame\n    }\n    fn check() {}\n}\n"
                            "pub fn send(f: Frame) {\n    fn check() {}\n    f.new();\n    Other::new();\n}\n"),
    "two-b/src/main.rs": "use one::{net::{wire, *}, start as begin};\nuse two_b::deep::er;\nfn main() {\n    begin();\n    open(2);\n    wire::send(3);\n    er::run();\n    new();\n}\n",
    "two-b/src/deep/er.rs": "use super::super::deep;\nuse crate::missing::Thing;\npub fn run() {}\npub struct Other;\nimpl Other {\n    pub fn new() {}\n}\n",
    "plain.rs": "use ;\nuse a::{b, c\nfn open(\n", "empty.rs": "", "none.rs": None, "notes.md": "use crate::net;\n",
}


def _edges(spark, files: dict) -> set:
    frame = tree.as_files(spark.createDataFrame(list(files.items()), "path string, content string"))
    rows = deps.dependency_edges(frame, defs.definitions(frame)).collect()
    assert len(rows) == len({(r.src, r.dst, r.edge_type) for r in rows})
    return {(r.edge_type, r.src.split(":", 1)[1], r.dst.split(":", 1)[1]) for r in rows}


def test_edges_of_two_crates(spark):
    lib, net, wire, main, er = list(FILES)[:5]
    found = _edges(spark, FILES)
    assert {e[1:] for e in found if e[0] == "imports"} == {(net, lib), (net, wire), (main, wire), (main, net), (main, lib), (main, er),
                                                                # ``deep`` has no file of its own, so the root declares it
                                                                (er, main)}
    calls = {e[1:] for e in found if e[0] == "calls"}
    assert calls == {
        (f"{lib}:start", f"{net}:open"),        # no import shows the module, but it has the only ``open`` of a module of that name
        (f"{net}:open", f"{wire}:send"), (f"{net}:open", f"{wire}:new"), (f"{net}:open", f"{lib}:start"),
        (f"{wire}:new", f"{wire}:check"), (f"{wire}:send", f"{wire}:new"), (f"{wire}:send", f"{er}:new"),
        (f"{main}:main", f"{lib}:start"), (f"{main}:main", f"{net}:open"), (f"{main}:main", f"{wire}:send"), (f"{main}:main", f"{er}:run")}
    assert {e[1:] for e in found if e[0] == "uses"} == {(f"{net}:open", f"{lib}:Config"), (f"{wire}:new", f"{wire}:Frame"), (f"{wire}:send", f"{wire}:Frame")}


def test_use_items_come_apart(spark):
    items = ["a", "a::b as c", "a::{b, c::{d as e, self}, *}", "{x, y::{z}}", "a::{}", "a::{b,}", "a\n  ::b", ""]
    rows = spark.createDataFrame(list(enumerate(items)), "i int, use string").select("i", deps.use_leaves(F.col("use")).alias("leaves")).collect()
    assert [r.leaves for r in sorted(rows, key=lambda r: r.i)] == [
        ["a"], ["a::b as c"], ["a::b", "a::c::d as e", "a::c::self", "a::*"], ["x", "y::z"], [], ["a::b"], ["a\n  ::b"], []]


def test_a_common_name_pairs_with_nothing(spark):
    """Hundreds of files define and call ``new`` of others: only names one can tell apart give edges, so rows stay linear."""
    many = {f"src/m{i}.rs": f"pub struct T{i};\nimpl T{i} {{\n    pub fn new() {{}}\n}}\npub fn go_{i}() {{\n    x.reset();\n    T{(i + 1) % 300}::new();\n}}\n"
            "pub fn reset() {}\n" for i in range(300)}
    many["src/caller.rs"] = "pub fn all() {\n    reset();\n    new();\n}\n"
    calls = {e[1:] for e in _edges(spark, many) if e[0] == "calls"}
    assert calls == {(f"src/m{i}.rs:go_{i}", f"src/m{i}.rs:reset") for i in range(300)} | {
        (f"src/m{i}.rs:go_{i}", f"src/m{(i + 1) % 300}.rs:new") for i in range(300)}


def test_no_files(spark):
    none = tree.as_files(spark.createDataFrame([], "path string, content string"))
    assert deps.dependency_edges(none, defs.definitions(none)).count() == 0


def test_rows_that_ask_for_one_key_are_spread(spark):
    """50,000 files ask for one name and one that nothing defines: the first is found for all, none gathers in one task."""
    from codeloom.operators import dependencies

    names = F.explode(F.array(F.lit("i32"), F.lit("Rate")))
    asking = spark.range(50_000).select(F.concat(F.lit("f"), "id").alias("path"), names.alias("name"))
    known = spark.createDataFrame([("Rate", "rate.rs"), ("Fee", "fee.rs")], "dst string, dst_path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = dependencies._find(asking, known, {"name": "dst"})
        rows = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert found.columns == ["path", "name", "dst", "dst_path"] and found.filter("dst_path = 'rate.rs'").count() == 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in rows) == 50_000 and max(r["count"] for r in rows) < 25_000
