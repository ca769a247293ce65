"""What files and symbols depend on: imports found as files, calls and type names found as symbols.

Everything is an equality join: a path of an import is cut into its prefixes and joined with the modules of its crate, the
longest wins; a name is looked up in its own file, then through the imports of the file, then among names that the corpus
has once. A name that many files define is never paired with all of them, so rows stay linear in the names written.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import text as tx
from codeloom.functions.code_mask import masked
from codeloom.operators.edges import file_id, symbol_id
from codeloom.session import cut_lineage

ROWS_PER_BIN = 64
HOT = 10_000  # rows that ask for one key
TYPE_KINDS = ("struct", "enum", "trait", "type_alias")
USE = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"
CALL = r"(?:\bfn\s+|\b(?:\w+::)+|\.)?\b[A-Za-z_]\w*(?:::<[^()]*>)?\("


def _root(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?:.*/)?src)/", 1)


def _module(path: Column) -> Column:
    inside = F.when(_root(path) != "", F.substr(path, F.length(_root(path)) + 2)).otherwise(path)
    return F.regexp_replace(F.regexp_replace(inside, r"^(?:lib|main)\.rs$|(?:^|/)mod\.rs$|\.rs$", ""), "/", "::")


def module_paths(files: DataFrame) -> DataFrame:
    """(path, root, module, crate) of each ``.rs`` file: ``x/src/a/b.rs`` is module ``a::b`` of crate ``x`` below ``x/src``."""
    path = F.col("path")
    crate = F.nullif(F.replace(F.regexp_extract(_root(path), r"([^/]+)/src$", 1), F.lit("-"), F.lit("_")), F.lit(""))
    return files.filter(path.endswith(".rs")).select("path", _root(path).alias("root"), _module(path).alias("module"), crate.alias("crate"))


def code_facts(files: DataFrame) -> DataFrame:
    """(path, uses, calls) of each ``.rs`` file: texts of its ``use`` items, and (row, call) with the qualifiers as written."""
    code = masked(files.filter(F.col("path").endswith(".rs")).select("path", "content"))
    written = lambda line: F.filter(F.regexp_extract_all(line, F.lit(CALL), F.lit(0)), lambda c: ~c.rlike(r"^fn\s"))
    calls = F.transform(F.split("masked", "\n"), lambda line, row: F.transform(written(line), lambda c: F.struct(row.alias("row"), c.alias("call"))))
    return code.select("path", F.array_distinct(F.regexp_extract_all("masked", F.lit(USE), F.lit(1))).alias("uses"), F.flatten(calls).alias("calls"))


def use_leaves(use: Column) -> Column:
    """Paths of one ``use`` item: ``a::{b, c::{d as e, self}, *}`` has the leaves a::b, a::c::d as e, a::c::self and a::*."""
    def step(acc: Column, token: Column) -> Column:
        around = F.element_at(acc["stack"], -1)
        ended = F.when(acc["name"] != "", F.concat(acc["leaves"], F.array(F.concat(around, acc["name"])))).otherwise(acc["leaves"])
        opens, closes = token == "{", token == "}"
        stack = (F.when(opens, F.concat(acc["stack"], F.array(F.concat(around, acc["name"]))))
                 .when(closes & (F.size(acc["stack"]) > 1), F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)).otherwise(acc["stack"]))
        name = F.when(opens | closes | (token == ","), "").otherwise(tx.trim(token))
        return F.struct(stack.alias("stack"), name.alias("name"), F.when(closes | (token == ","), ended).otherwise(acc["leaves"]).alias("leaves"))

    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("leaves"))
    tokens = F.regexp_extract_all(F.concat(use, F.lit(",")), F.lit(r"[{},]|[^{},\s][^{},]*"), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["leaves"])


def _find(rows: DataFrame, known: DataFrame, on: dict[str, str]) -> DataFrame:
    """Inner join of ``rows`` with ``known`` by ``on`` (column of rows: column of known) for keys that very many rows ask for.

    A key of more than ``HOT`` rows is looked up by broadcast, at most one for each ``HOT`` rows; so neither what all rows ask for nor
    what nothing is known of (``i32``, say) gathers in one task.
    """
    asked = rows.groupBy(*[F.col(a).alias(f"hot_{b}") for a, b in on.items()]).agg(F.count("*").alias("n"))
    hot = cut_lineage(asked.filter(F.col("n") > HOT).drop("n"))
    known_hot = known.join(F.broadcast(hot), [known[b] == hot[f"hot_{b}"] for b in on.values()], "left_semi")
    rest = rows.join(F.broadcast(hot), [rows[a] == hot[f"hot_{b}"] for a, b in on.items()], "left_anti")
    match = lambda left, right: left.join(right, [F.col(a) == F.col(b) for a, b in on.items()])
    return match(rows, F.broadcast(known_hot)).unionByName(match(rest, known))


def import_targets(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports that lead to a file of the corpus: (path, visible, target, item, is_glob).

    ``visible`` is the name the file then uses, ``item`` the first name behind the module, null if the module itself is meant.
    ``crate``, ``self`` and ``super`` fix where a path starts; others start below the file's own module, else at the root of
    its crate, else in the crate of that name. Of two files of one module the smaller path stands for it.
    """
    leaf = F.explode("uses")
    rows = facts.select("path", leaf.alias("use")).select("path", F.explode(use_leaves(F.col("use"))).alias("leaf")).distinct()
    alias = F.regexp_extract("leaf", r"\sas\s+(\w+)\s*$", 1)
    plain = F.regexp_replace(F.regexp_replace("leaf", r"\sas\s+\w+\s*$", ""), r"\s+|^::", "")
    rows = rows.select("path", F.nullif(alias, F.lit("")).alias("alias"), plain.endswith("::*").alias("is_glob"),
                       F.regexp_replace(F.regexp_replace(plain, r"::(?:\*|self)$", ""), r"^self::(?=super\b)", "").alias("name"))
    rows = rows.filter("name != ''").withColumn("parts", F.split("name", "::")).join(modules.select("path", "root", "module"), "path")
    crates = modules.filter("crate IS NOT NULL").groupBy("crate").agg(F.min("root").alias("crate_root"))
    rows = rows.join(crates, rows["parts"][0] == crates["crate"], "left")

    own = F.filter(F.split("module", "::"), lambda s: s != "")
    ups = F.size(F.filter("parts", lambda p: p == "super"))
    head, parts = F.col("parts")[0], F.col("parts")
    behind = lambda n: F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))

    def start(rank: int, root: Column, full: Column, least: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), root.alias("root"), full.alias("full"), least.alias("least"))

    none, root = F.lit(0), F.col("root")
    starts = (F.when(head == "crate", F.array(start(3, root, behind(F.lit(1)), none)))
              .when(head == "self", F.array(start(3, root, F.concat(own, behind(F.lit(1))), none)))
              .when(head == "super", F.array(start(3, root, F.concat(F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, none)), behind(ups)), none)))
              .otherwise(F.array(start(2, root, F.concat(own, parts), F.size(own) + 1), start(1, root, parts, F.lit(1)),
                                 start(0, F.col("crate_root"), behind(F.lit(1)), none))))
    rows = rows.select("path", "alias", "name", "is_glob", F.explode(starts).alias("s")).filter("s.root IS NOT NULL AND s.least <= size(s.full)")
    rows = rows.select("path", "alias", "name", "is_glob", "s.*")
    rows = rows.withColumn("n", F.explode(F.sequence("least", F.size("full"))))
    # rows without the list they were cut from
    rows = cut_lineage(rows.select("path", "alias", "name", "is_glob", "rank", "n", "root", F.get("full", F.col("n")).alias("item"),
                                   F.array_join(F.slice("full", F.lit(1), F.col("n")), "::").alias("module")))
    known = modules.groupBy(F.col("root").alias("known_root"), F.col("module").alias("known_module")).agg(F.min("path").alias("target"))
    found = _find(rows, known, {"root": "known_root", "module": "known_module"}).groupBy("path", "alias", "name", "is_glob").agg(
        F.max(F.struct("rank", "n", "target", "item")).alias("best"))
    return found.select("path", F.coalesce("alias", F.substring_index("name", "::", -1)).alias("visible"), "best.target", "best.item", "is_glob")


def callers(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by the innermost function around them: distinct (path, owner, qualifier, name); ``Self`` is the caller's type.

    Functions are spread over bins of rows, so a very long file is many small groups.
    """
    fns = symbols.filter("kind = 'function' AND end_row IS NOT NULL")
    spans = fns.select("path", F.explode(F.sequence(F.floor(F.col("start_row") / ROWS_PER_BIN), F.floor(F.col("end_row") / ROWS_PER_BIN))).alias("bin"),
                       "start_row", "end_row", F.col("name").alias("owner"), _bare("parent").alias("parent"))
    parts = F.split(F.regexp_replace("c.call", r"(?:::<[^()]*>)?\($", ""), "::")
    calls = facts.select("path", F.explode("calls").alias("c")).select(
        "path", F.col("c.row").alias("row"), F.floor(F.col("c.row") / ROWS_PER_BIN).alias("bin"),
        F.regexp_replace(F.element_at(parts, -1), r"^\.", "").alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("qualifier")).distinct()
    inside = calls.join(spans, ["path", "bin"]).filter("row BETWEEN start_row AND end_row")
    best = inside.groupBy("path", "row", "name", "qualifier").agg(F.max(F.struct("start_row", "owner", "parent")).alias("f"))
    return best.select("path", "f.owner", F.when(F.col("qualifier") == "Self", F.col("f.parent")).otherwise(F.col("qualifier")).alias("qualifier"),
                       "name").distinct()


def type_mentions(symbols: DataFrame) -> DataFrame:
    """Type names in parameters, results, fields and trait impls: distinct (path, owner, qualifier, name); fields belong to their struct."""
    shown = F.concat_ws(" ", F.transform("parameters", lambda p: p["type"]), "return_type", "field_type", "trait_impl")
    owner = F.when(F.col("kind") == "field", _bare("parent")).otherwise(F.col("name"))
    names = symbols.select("path", owner.alias("owner"), F.explode(F.array_distinct(F.regexp_extract_all(shown, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    return names.filter("owner IS NOT NULL AND owner != name").select("path", "owner", F.lit(None).cast("string").alias("qualifier"), "name").distinct()


def _bare(column: str) -> Column:
    return F.regexp_replace(column, r"\s*<.*$", "")


def resolve(wanted: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """Where the names of ``wanted`` (path, owner, qualifier, name) are defined: distinct (path, owner, dst_path, dst).

    ``known`` (path, name, parent) are the definitions. Own file first, then names imported one by one, then glob imports,
    then names (with their type or module, if one is written) that are defined once in the corpus.
    """
    keys = ["path", "owner", "qualifier", "name"]
    wanted = cut_lineage(wanted)
    defined = cut_lineage(known.select(F.col("path").alias("dst_path"), F.col("name").alias("dst"), _bare("parent").alias("parent")).distinct())
    fits = F.col("qualifier").isNull() | (F.col("qualifier") == F.col("parent"))
    take = lambda df, rank: df.select(*keys, F.struct(F.lit(rank).alias("rank"), "dst_path", "dst").alias("hit"))

    own = wanted.join(defined, (wanted["path"] == defined["dst_path"]) & (wanted["name"] == defined["dst"])).filter(fits)
    single, globs = targets.filter("NOT is_glob"), targets.filter("is_glob")
    named = wanted.withColumn("visible", F.coalesce("qualifier", "name")).join(single.select("path", "visible", "target", "item"), ["path", "visible"])
    named = named.withColumn("look_for", F.when(F.col("qualifier").isNull(), F.col("item")).otherwise(F.col("name")))
    named = _find(cut_lineage(named), defined, {"target": "dst_path", "look_for": "dst"}).filter(
        F.when(F.col("qualifier").isNull() | F.col("item").isNull(), F.col("parent").isNull()).otherwise(F.col("parent") == F.col("item")))
    starred = wanted.join(globs.select("path", "target"), "path")
    starred = _find(cut_lineage(starred), defined, {"target": "dst_path", "name": "dst"}).filter(
        F.col("qualifier").eqNullSafe(F.col("parent")))
    by_name = defined.groupBy("dst").agg(F.count("*").alias("n"), F.min("dst_path").alias("dst_path")).filter("n = 1")
    scope = F.coalesce("parent", F.substring_index(_module(F.col("dst_path")), "::", -1)).alias("scope")
    by_type = defined.groupBy(scope, "dst").agg(F.count("*").alias("n"), F.min("dst_path").alias("dst_path")).filter("n = 1")
    once = _find(wanted.filter("qualifier IS NULL"), by_name, {"name": "dst"})
    typed = _find(wanted.filter("qualifier IS NOT NULL"), by_type, {"name": "dst", "qualifier": "scope"})
    hits = take(own, 3).unionByName(take(named, 2)).unionByName(take(starred, 1)).unionByName(take(once, 0)).unionByName(take(typed, 0))
    return hits.groupBy(*keys).agg(F.max("hit").alias("hit")).select("path", "owner", "hit.dst_path", "hit.dst").distinct()


def dependency_edges(files: DataFrame, symbols: DataFrame, kinds=(rules.IMPORTS, rules.CALLS, rules.USES)) -> DataFrame:
    """Edges ``imports`` between files, ``calls`` between functions and ``uses`` from symbols to types, of the given kinds; no loops.

    Files without content, without ``use`` items or functions have no edges; an empty table gives an empty result.
    """
    facts, modules = cut_lineage(code_facts(files)), module_paths(files)
    targets = cut_lineage(import_targets(facts, modules))
    functions = symbols.filter(F.col("kind") == "function").select("path", "name", "parent")
    types = symbols.filter(F.col("kind").isin(*TYPE_KINDS)).select("path", "name", F.lit(None).cast("string").alias("parent"))
    as_edges = lambda df, kind: df.select(symbol_id(F.col("path"), F.col("owner")).alias("src"), symbol_id(F.col("dst_path"), F.col("dst")).alias("dst"),
                                          F.lit(kind).alias("edge_type"))
    of_kind = {
        rules.IMPORTS: lambda: targets.select(file_id(F.col("path")).alias("src"), file_id(F.col("target")).alias("dst"),
                                              F.lit(rules.IMPORTS).alias("edge_type")).distinct(),
        rules.CALLS: lambda: as_edges(resolve(callers(facts, symbols), functions, targets), rules.CALLS),
        rules.USES: lambda: as_edges(resolve(type_mentions(symbols), types, targets), rules.USES)}
    found = functools.reduce(DataFrame.unionByName, [of_kind[kind]() for kind in kinds])
    return found.filter("src != dst").withColumn("score", F.lit(None).cast("double"))
