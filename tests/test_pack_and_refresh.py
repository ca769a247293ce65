from pyspark.sql import functions as F

from codeloom.operators import chunking, search
from codeloom.plans.build import build_pack
from codeloom.plans.tools import PackTools
from codeloom.sources.pack import manifest, read_pack, write_pack
from codeloom.sources import tree
from codeloom.streaming.refresh import latest_version, read_current, refresh_batch, start_refresh

TREE = [
    ("src/main.rs", "use std::fs;\n\n/// Entry\nfn main() {\n    run_server();\n}\n"),
    ("src/server.rs", "/// Serves requests\npub struct ServerConfig {\n    pub port: u16,\n}\n\nimpl ServerConfig {\n"
                      "    pub fn new(port: u16) -> Self {\n        ServerConfig { port }\n    }\n}\n\npub fn run_server() {}\n"),
    ("tests/server_test.rs", "fn test_it() {\n    let c = ServerConfig::new(80);\n    run_server();\n}\n"),
    ("docs/guide.md", "# Guide\nUse `run_server` with ServerConfig.\n## More\ntext\n"),
    ("Cargo.lock", "[[package]]\n"),
    ("app.toml", "port = 80\n"),
]


def _files(spark):
    return tree.as_files(spark.createDataFrame(TREE, "path string, content string"))


def test_build_write_read_and_ask(spark, tmp_path):
    pack = build_pack(_files(spark))
    write_pack(pack, str(tmp_path))
    stored = read_pack(spark, str(tmp_path))
    assert set(stored.tables) == set(pack.tables)
    kinds = {r.edge_type for r in stored.edges.select("edge_type").distinct().collect()}
    assert kinds >= {"symbol_to_chunk", "symbol_to_symbol", "semantic_symbol_similarity", "semantic_symbol_to_chunk"}
    assert stored.tables["doc_files"].count() == 5 and stored.tables["doc_overview"].first().total_files == 5
    m = manifest(stored).first()
    assert m.total_files == 5 and m.embedding_dim == 64 and m.total_symbols == stored.symbols.count()
    tools = PackTools(stored)
    assert tools.search_symbols("serverconfig").filter("score = 30.0").count() >= 1
    assert "pub fn new" in [r.content for r in tools.get_symbol_content("new").collect()][0]
    examples = tools.get_symbol_examples("run_server").orderBy("rank").collect()
    assert examples[0].example_type == "test" and {e.file for e in examples} == {"tests/server_test.rs", "docs/guide.md"}
    assert {r.node.split(":")[-1] for r in tools.get_impact("ServerConfig").collect()} >= {"port"}
    assert tools.get_quickstart().filter("section = 'entry_points'").count() >= 1
    assert tools.propose_refactor("port").first().symbols_affected == 7  # itself, its struct, its chunk and four near in meaning
    spots = tools.analyze_hotspots()
    assert spots["most_connected"].count() == 10 and spots["orphans"].count() > 0
    answer = tools.ask("How do I configure the server port?", 3)
    assert answer["symbols"].count() == 3 and answer["examples"].count() >= 1
    assert tools.list_subsystems().count() > 0
    assert tools.get_task_view("add_subsystem").first()[0] == "src/main.rs"
    assert tools.list_files().count() == 5
    assert search.symbol_table(stored.symbols, dedupe=True).groupBy("name").count().filter("count > 1").isEmpty()


def test_stream_refresh_keeps_tables_current(spark, tmp_path):
    inbox, folder, mark = (str(tmp_path / n) for n in ("inbox", "tables", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(inbox)

    def run():
        source = spark.readStream.schema("path string, content string").parquet(inbox)
        start_refresh(spark, source, folder, lambda f: {"chunks": chunking.by_lines(f, 1)}, mark).awaitTermination(120)

    arrive([("a.txt", "1\n2"), ("b.txt", "x")])
    run()
    assert read_current(spark, folder, "chunks").count() == 3
    arrive([("a.txt", "1\n2\n3"), ("b.txt", "x"), ("c.txt", "new")])
    run()
    got = {(r.path, r.text) for r in read_current(spark, folder, "chunks").collect()}
    assert got == {("a.txt", "1"), ("a.txt", "2"), ("a.txt", "3"), ("b.txt", "x"), ("c.txt", "new")}
    assert read_current(spark, folder, "file_hashes").select(F.countDistinct("path")).first()[0] == 3
    # another stream on the same folder goes on from the published version; a null content deletes, the later row counts
    inbox, mark = str(tmp_path / "later"), str(tmp_path / "fresh mark")
    rows = [("a.txt", None, 1), ("b.txt", "zzz", 1), ("b.txt", "y", 2), ("d.txt", "d", 1)]
    spark.createDataFrame(rows, "path string, content string, at int").coalesce(1).write.parquet(inbox)
    source = spark.readStream.schema("path string, content string, at int").parquet(inbox)
    start_refresh(spark, source, folder, lambda f: {"chunks": chunking.by_lines(f, 1)}, mark, "at").awaitTermination(120)
    got = {(r.path, r.text) for r in read_current(spark, folder, "chunks").collect()}
    assert got == {("b.txt", "y"), ("c.txt", "new"), ("d.txt", "d")}


def test_a_replayed_batch_writes_its_version_again(spark, tmp_path):
    folder, derive = str(tmp_path), lambda f: {"chunks": chunking.by_lines(f, 1)}
    batch = lambda text: spark.createDataFrame([("a.txt", text)], "path string, content string")
    for token, text in (("s:0", "one"), ("s:1", "two"), ("s:1", "two")):
        refresh_batch(spark, folder, batch(text), derive, token)
    assert latest_version(spark, folder) == 2 and [r.text for r in read_current(spark, folder, "chunks").collect()] == ["two"]


def test_answers_keep_a_symbol_of_each_file(spark):
    """A name that two files have is found in the file that was hit."""
    unit = [1.0] + [0.0] * 3
    questions = spark.createDataFrame([("q", unit)], "question_id string, embedding array<double>")
    chunks = spark.createDataFrame([("c1", "a.rs", "fn new() {}", unit), ("c2", "b.rs", "x", [0.0, 1.0, 0.0, 0.0])],
                                   "chunk_key string, file string, text string, embedding array<double>")
    table = spark.createDataFrame([("new", "function", "a.rs", "in a"), ("new", "function", "z.rs", "in z")],
                                  "name string, kind string, file string, summary string")
    answer = search.answer_questions(questions, chunks, table, 3)
    assert [(r.symbol, r.file, r.summary) for r in answer["symbols"].collect()] == [("new", "a.rs", "in a")]
    assert [r.code for r in answer["examples"].collect()] == ["fn new() {}"]


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    folder, derive = str(tmp_path), lambda f: {"chunks": chunking.by_lines(f, 1)}

    def batch(token, *rows):
        refresh_batch(spark, folder, spark.createDataFrame(rows, "path string, content string"), derive, token, buckets=64)

    def written(version):
        return {p.name for p in (tmp_path / "chunks" / f"version={version}").glob("path_bucket=*")}

    batch("s:0", *[(f"{n}.txt", f"text {n}") for n in range(300)])
    assert len(written(1)) > 50
    batch("s:1", ("7.txt", "new text"), ("8.txt", "text 8"), ("none.txt", None))  # one changed, one as it was, one unknown
    assert len(written(2)) == 1
    batch("s:2", ("7.txt", None))
    batch("s:3", ("8.txt", "text 8"))  # nothing changes
    assert not written(4) and latest_version(spark, folder) == 4
    got = {r.path: r.text for r in read_current(spark, folder, "chunks").collect()}
    assert got == {f"{n}.txt": f"text {n}" for n in range(300) if n != 7}
    # an earlier state can be read, and a bucket that lost all its rows reads as empty
    assert read_current(spark, folder, "chunks", before=3).filter("path = '7.txt'").first().text == "new text"
    batch("s:4", *[(f"{n}.txt", None) for n in range(300)])
    assert read_current(spark, folder, "chunks").count() == 0


def test_refreshed_pack_equals_a_new_build(spark, tmp_path):
    from codeloom.plans.build import file_tables, refreshed_pack

    code = {"src/a.rs": "/// Opens it.\npub fn open(path: &str) -> bool {\n    true\n}\n", "src/b.rs": "pub struct Store {\n    size: usize,\n}\n", "README.md": "# Title\n\nSome text.\n"}
    later = {"src/a.rs": "pub fn close() {}\n", "src/c.rs": "pub enum Mode {\n    On,\n}\n", "src/b.rs": None}
    make = lambda rows: spark.createDataFrame(list(rows.items()), "path string, content string")
    folder = str(tmp_path)
    refresh_batch(spark, folder, make(code), file_tables, "s:0", buckets=8)
    refresh_batch(spark, folder, make(later), file_tables, "s:1", buckets=8)
    got = refreshed_pack(spark, folder, with_communities=False)
    want = build_pack(tree.as_files(make({k: v for k, v in {**code, **later}.items() if v is not None})), with_communities=False)
    for name in ("files", "symbols", "chunks", "nodes", "edges"):
        rows = lambda p: sorted(str(r) for r in p.tables[name].select(sorted(want.tables[name].columns)).collect())
        assert rows(got) == rows(want), name
