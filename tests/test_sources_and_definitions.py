from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import paths
from codeloom.functions import text as tx
from codeloom.operators import chunking, definitions as defs, edges, files as fo, lines
from codeloom.sources import tree

CODE = '''\
/// Adds two numbers
pub fn add(x: i32, y: i32) -> i32 {
    x + y
}

async fn fetch_data() {}

/// A point
#[derive(Debug, Clone)]
pub struct Point {
    pub x: f64,
    pub y: f64,
}

pub enum Color {
    Red,
    Green,
    Blue,
}

pub struct Container<T> {
    value: T,
}

impl<T: Clone> Container<T> {
    pub fn new(value: T) -> Self {
        Container { value }
    }
}

pub fn identity<T>(x: T) -> T {
    x
}

pub const MAX_SIZE: usize = 10;
pub static mut COUNTER: u32 = 0;
pub mod utils {
    pub fn inner(
        a: i32,
        b: HashMap<String, Vec<u8>>,
    ) -> bool {
        let text = "} not a brace {";
        true
    }
}

trait Display {
    type Output;
    fn fmt(&self) -> String;
}

impl Display for Calculator {
    fn fmt(&self) -> String {
        String::new()
    }
}
'''


def _files(spark, rows):
    return tree.as_files(spark.createDataFrame(rows, "path string, content string"))


def _symbols(spark):
    return {(r.kind, r.name): r for r in defs.definitions(_files(spark, [("src/a.rs", CODE)])).collect()}


def test_definitions(spark):
    got = _symbols(spark)
    add = got["function", "add"]
    assert add.visibility == "pub" and add.docs == "/// Adds two numbers" and add.return_type == "i32"
    assert [(p.name, p.type) for p in add.parameters] == [("x", "i32"), ("y", "i32")]
    assert got["function", "fetch_data"].modifiers == ["async"]
    point = got["struct", "Point"]
    assert point.docs == "/// A point" and "derive" in point.attributes[0]
    assert got["field", "x"].parent == "Point" and got["field", "x"].field_type == "f64"
    assert got["variant", "Green"].parent == "Color"
    assert got["struct", "Container"].generics == "<T>"
    assert got["function", "new"].parent == "Container<T>"
    assert got["function", "identity"].generics == "<T>"
    assert got["const", "MAX_SIZE"].field_type == "usize"
    assert got["static", "COUNTER"].is_mutable
    inner = got["function", "inner"]
    assert [p.type for p in inner.parameters] == ["i32", "HashMap<String, Vec<u8>>"] and inner.return_type == "bool"
    assert ("mod", "utils") in got and inner.parent is None
    assert got["associated_type", "Output"].parent == "Display"
    assert got["impl", "Display for Calculator"].trait_impl == "Display"
    # a signature without a body is no definition; the impl's method is one
    assert got["function", "fmt"].parent == "Calculator"


def test_spans_cut_the_source(spark):
    for (kind, _), row in _symbols(spark).items():
        text = CODE.encode()[row.start:row.end].decode()
        assert CODE.count("\n", 0, row.start) == row.start_row
        assert kind in ("field", "variant") or text[-1] in "};", text


def test_definition_chunks(spark):
    files = _files(spark, [("a.rs", CODE), ("empty.rs", "// nothing here\n")])
    chunks = defs.definition_chunks(files, defs.definitions(files)).collect()
    by_id = {(c.path, c.chunk_id.split(":")[0]): c.text for c in chunks}
    assert by_id["empty.rs", "full"] == "// nothing here\n"
    assert any(c.chunk_id.startswith("impl Display for Calculator::fmt:") for c in chunks)
    assert any(c.chunk_id.startswith("trait Display:") for c in chunks)
    assert any(c.chunk_id.startswith("mod::utils:") for c in chunks)


def test_containment_over_many_bins(spark):
    symbols = spark.createDataFrame([("p", f"s{i}", i * 10, i * 10 + 5) for i in range(200)],
                                    "path string, name string, start bigint, end bigint")
    chunks = spark.createDataFrame([("p", 0, "a", 0, 999), ("p", 1, "b", 500, 2005)],
                                   "path string, chunk_ord bigint, chunk_id string, start bigint, end bigint")
    got = {(r.name, r.chunk_id) for r in edges.containment(symbols, chunks, bin_size=64).collect()}
    want = {(f"s{i}", c) for i in range(200) for c, lo, hi in (("a", 0, 999), ("b", 500, 2005))
            if i * 10 >= lo and i * 10 + 5 <= hi}
    assert got == want


def test_noise_and_plans(spark):
    noise = ["LICENSE", "COPYING", ".gitignore", "Cargo.lock", "package-lock.json", "image.png", "font.woff2", "README",
             "CHANGELOG.md", "CONTRIBUTING"]
    kept = ["README.md", "src/lib.rs", "main.rs", "notes.txt"]
    df = spark.createDataFrame([(p,) for p in noise + kept], "path string")
    got = {r.path: r.n for r in df.select("path", paths.is_noise(F.col("path")).alias("n")).collect()}
    assert all(got[p] for p in noise) and not any(got[p] for p in kept)
    plans = {r.kind: r for r in fo.plan_table(spark).collect()}
    assert set(plans) == {row[0] for row in rules.PLANS}
    assert plans["SourceCode"].symbol_parse and not plans["Config"].embed


def test_line_counts_match_a_plain_restatement(spark):
    import random

    rng = random.Random(7)
    pieces = ["", "   ", "x = 1;", "// c", "/* open", "close */", "/* both */", 's = "/*";', "code // tail"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(25)) for _ in range(60)]

    def plain(text):
        inside, code, comment, blank = False, 0, 0, 0
        for line in text.split("\n"):
            line = line.strip()
            if not line:
                blank += 1
            elif inside or "/*" in line:
                comment += 1
                inside = "*/" not in line
            elif line.startswith("//"):
                comment += 1
            else:
                code += 1
        return code, comment, blank

    files = _files(spark, [(f"f{i}.c", t + "\n") for i, t in enumerate(texts)])
    got = {r.path: (r.code, r.comment, r.blank) for r in lines.line_stats(files).collect()}
    assert got == {f"f{i}.c": plain(t) for i, t in enumerate(texts)}


def test_lines_follow_the_newline_rules(spark):
    cases = {"": [], "\n": [""], "a": ["a"], "a\n": ["a"], "a\r\nb\r\n": ["a", "b"], "a\n\n": ["a", ""]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.l for r in df.select("t", tx.lines(F.col("t")).alias("l")).collect()} == cases


def test_heading_sections(spark):
    files = _files(spark, [("a.md", "intro\n# One\nx\n  ## Two\ny")])
    out = chunking.by_heading(files).orderBy("chunk_ord").collect()
    assert [(c.chunk_id, c.text) for c in out] == [
        ("h-0-1", "intro\n"), ("h-0-3", "# One\nx\n"), ("h-0-tail", "  ## Two\ny\n")]


def test_scan_tree_drops_binary_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}\n")
    (tmp_path / "b.md").write_text("# T\n")
    (tmp_path / "c.txt").write_bytes(b"ab\x00cd")
    got = {r.path: (r.kind, r.module) for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.rs": ("SourceCode", "src"), "b.md": ("Documentation", None)}


def test_roles_and_signature(spark):
    df = spark.createDataFrame([("handle_request",), ("ServerConfig",)], "name string")
    rule = df.agg(F.min(tx.member_rule_number(F.col("name"))).alias("r"))
    assert rule.select(tx.role_of(F.lit(None).cast("string"), F.col("r")).alias("x")).first()[0] == "RPC/server layer"
    one = spark.createDataFrame([("test_func", "function", [("x", "i32")], "String", None)],
                                "name string, kind string, parameters array<struct<name:string,type:string>>, r string, g string")
    sig = one.select(tx.signature(F.col("kind"), F.col("name"), F.col("parameters"), F.col("r"), F.col("g"))).first()[0]
    assert sig == "fn test_func(x: i32) -> String"


def test_masked_sources_keep_their_shape():
    from codeloom.functions.code_mask import mask_source

    text = 'a "b\\"{" /* x /* y\n */ z */ r##"q"# {\n"## \'{\' \'a, /// doc {\n// gone }\nb"open {'
    shown = mask_source(text)
    assert len(shown) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(shown) if c == "\n"]
    assert "{" not in shown and "}" not in shown and "///" in shown and shown.startswith('a "') and "'a," in shown


def test_a_large_file_without_braces_stays_small(spark):
    """Rows carry their own line and the header of a definition, not the rest of the file."""
    from codeloom.operators import definitions as d

    text = "fn open(\n" + "/// notes\n" * 4000 + "x = 1\n" * 150_000
    rows = d._add_header(d._add_lead(d._starts(d._depth_table(spark.createDataFrame([("big.rs", text)], "path string, content string")))))
    sizes = rows.selectExpr("sum(length(coalesce(header, ''))) h", "sum(size(doc_lines)) n", "count(*) c").first()
    assert sizes.h < 100 and sizes.n == 4000 and sizes.c == 150_001


_ODD = ["", "\n", "fn a() {}\r\n}\r\n}\nfn b();", "impl<T: A> X<T> for Y<T>\nwhere T: B\n{\n  fn f(&self)\n    -> u8 {\n 1 }\n}\n",
        "struct S {\n  /// d\n\n  #[a]\n  pub x: i32, // {\n  y: \"}\",\n}\nenum E { A,\n  B(u8),\n  C = 1,\n}\n}}\nconst Z: u8 = 1;\n",
        "mod m {\n  trait T {\n    type N;\n    fn g(\n      &self);\n  }\n}\nfn open(\n/* { */ 'a'\nx = 1", "unsafe impl Send for é {}\n  pub(crate) const fn ü() {}\nmacro_rules! m {\n () => {};\n}\nuse a::{b,\n c};"]


def test_scan_equals_windows_over_lines(spark):
    from codeloom.operators import definitions as d

    files = spark.createDataFrame([(f"f{i}.rs", t) for i, t in enumerate([*_ODD, "\n".join(_ODD)])], "path string, content string")
    rows = d._starts(d._depth_table(files))
    names = [d._impl_names(r.shown) if r.kind == "impl" else (None, None) for r in rows.select("shown", "kind").distinct().collect()]
    assert any(n[1] for n in names)
    is_impl = F.col("kind") == "impl"
    bare = F.regexp_replace(F.regexp_replace("shown", r"^(?:unsafe\s+)?impl\s*(?:<[^{]*?>)?\s+", ""), r"\s*(?:where\b.*|\{.*)$", "")
    rows = rows.withColumn("impl_target", F.when(is_impl, tx.trim(F.regexp_replace(bare, r"^.*\bfor\s+", ""))))
    rows = d._add_nesting(d._add_header(d._add_lead(rows)))
    inside = (F.col("parent.level") == F.col("depth") - 1) & F.col("parent.kind").isin("struct", "enum")
    rows = rows.filter(F.col("kind").isNotNull() | inside)
    shown = ["path", "line_no", "line", "code", "shown", "offset", "depth", "kind", "name", "impl_target", "doc_lines", "attributes", "header", "parent", "stop"]
    assert sorted(map(str, d._lines(files).select(*shown).collect())) == sorted(map(str, rows.select(*shown).collect()))


def test_texts_are_never_broadcast(spark):
    """The planner knows the size of compressed tables, not of texts and lists made from them."""
    from codeloom.operators import definitions as d, search

    files = spark.createDataFrame([("a.rs", "fn a() {}")], "path string, content string")
    syms = d.definitions(files)
    plans = [d.definition_chunks(files, syms), search.symbol_sources(search.symbol_table(syms), files)]
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in plans)


def test_symbols_are_derived_once(spark):
    from codeloom.operators import definitions as d, docs, edges

    syms = d.definitions(spark.createDataFrame([("a.rs", "fn a() {}")], "path string, content string"))
    for df in (edges.symbol_edges(syms), docs.struct_members(syms)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
