"""Search and lookups over a symbol table.

A symbol table has the columns name, kind, file, subsystem, signature, summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import text as tx
from codeloom.functions.paths import any_of
from codeloom.operators import graph, retrieval
from codeloom.session import cut_lineage


def _filtered(table: DataFrame, subsystem: str | None, kind: str | None) -> DataFrame:
    if subsystem is not None:
        table = table.filter(F.col("subsystem") == subsystem)
    return table if kind is None else table.filter(F.col("kind") == kind)


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    """Top rows by score with the number of hits before the cut."""
    total = hits.agg(F.count("*").alias("total")).scalar()
    return (hits.orderBy(F.desc("score"), "symbol", "file").limit(limit).withColumn("total", total))


def _points(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def _keyword_score(query: str, name: Column, summary: Column) -> Column:
    needle = query.lower()
    return _points(F.lower(name).contains(needle), 10.0) + _points(F.lower(summary).contains(needle), 5.0)


def keyword_search(table: DataFrame, query: str, limit: int = 20, subsystem: str | None = None,
                   kind: str | None = None) -> DataFrame:
    """Name contains +10, summary contains +5, name equal +20; case-insensitive."""
    score = (_keyword_score(query, F.col("name"), F.col("summary"))
             + _points(F.lower("name") == query.lower(), 20.0))
    hits = _filtered(table, subsystem, kind).select(
        F.col("name").alias("symbol"), "kind", "file", "subsystem", "summary", score.alias("score"))
    return _ranked(hits.filter(F.col("score") > 0), limit)


def _query_words(query: str) -> list[str]:
    cleaned = "".join(c if c.isalnum() or c == "_" else " " for c in query)
    return [w for w in cleaned.split() if w not in rules.SIGNATURE_NOISE]


def signature_score(query: str, signature: Column) -> Column:
    """Equal 100, contained 50, else share of query words x 30; bonuses for return type and ``impl``.

    A query word has only word characters, so "some word of the signature
    contains it" is the same as "the signature contains it".
    """
    query, low = query.lower(), F.lower(signature)
    words = _query_words(query)
    share = F.lit(0.0)
    for word in words:
        share = share + _points(low.contains(word), 1.0)
    fuzzy = share / len(words) * 30.0 if words else F.lit(0.0)
    score = F.when(low == query, 100.0).when(low.contains(query), 50.0).otherwise(fuzzy)
    if "->" in query:
        wanted = query.split("->")[1].strip()
        score = score + _points(low.contains("->") & tx.trim(F.split(low, "->")[1]).contains(wanted), 20.0)
    if "impl" in query:
        score = score + _points(low.contains("impl"), 15.0)
    return score


def signature_search(table: DataFrame, query: str, limit: int = 20, subsystem: str | None = None,
                     kind: str | None = None) -> DataFrame:
    rows = _filtered(table, subsystem, kind).filter(F.col("signature").isNotNull())
    hits = rows.select(F.col("name").alias("symbol"), "kind", "file", "subsystem",
                       F.concat("summary", F.lit("\nSignature: "), "signature").alias("summary"),
                       signature_score(query, F.col("signature")).alias("score"))
    return _ranked(hits.filter(F.col("score") > 0), limit)


def get_symbol(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("name") == name)


def list_symbols(table: DataFrame, pattern: str | None = None, limit: int = 100) -> DataFrame:
    rows = table if pattern is None else table.filter(F.lower("name").contains(pattern.lower()))
    return rows.select("name").distinct().orderBy("name").limit(limit)


# --- questions ----------------------------------------------------------------
def chunk_hits(questions: DataFrame, chunks: DataFrame, n: int, question_id: str = "question_id",
               chunk_key: str = "chunk_key") -> DataFrame:
    """n best chunks of every question by vector: (question, chunk, score, rank); one scan of the chunks' vectors."""
    hits = retrieval.best_rows(questions, chunks, n, question_id, chunk_key)
    return hits.select(F.col("src").alias("question"), F.col("dst").alias("chunk"), "score", "rank")


def rank_symbols(hits: DataFrame, chunk_files: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """Symbols of the hit files, summed scores, n best per question.

    Scores are added up per question and file first, so the join with symbols
    sees at most one row per hit file.
    """
    per_file = (hits.join(chunk_files.select(F.col("chunk_key").alias("chunk"), "file"), "chunk")
                .groupBy("question", "file").agg(F.sum("score").alias("score")))
    rows = per_file.join(symbols.select("file", F.col("name").alias("symbol")).distinct(), "file").select(
        "question", "symbol", "file", F.round("score", 9).alias("score"))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "symbol", "file")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def answer_questions(questions: DataFrame, chunks: DataFrame, table: DataFrame, limit: int = 10, examples: int = 3,
                     vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Retrieval for a table of questions (question_id, embedding).

    chunks: chunk_key, file, text, embedding; the embedding may lie in a table ``vectors`` (chunk_key, embedding) instead,
    which is then read by the scan alone. Returns the ranked symbols, the distinct files and up to three code examples per question.
    """
    # a name stands for one symbol of each file that has it
    table = table.groupBy("name", "file").agg(F.min_by(F.struct("kind", "summary"), F.struct("kind", "summary")).alias("r")).select(
        "name", "file", "r.*")
    # three outputs read the hits
    hits = cut_lineage(chunk_hits(questions, chunks if vectors is None else vectors, limit * 2))
    ranked = rank_symbols(hits, chunks, table, limit)
    info = table.select(F.col("name").alias("symbol"), "kind", "file", "summary")
    symbols = cut_lineage(ranked.join(info, ["symbol", "file"]))
    located = hits.join(chunks.select(F.col("chunk_key").alias("chunk"), "file", "text"), "chunk")
    first = located.groupBy("question", "file").agg(
        F.min_by(F.struct("text"), F.struct(F.col("rank"))).alias("best"))
    shown = (symbols.filter(F.col("rank") <= examples).join(first, ["question", "file"])
             .select("question", "rank", "symbol", F.col("best.text").alias("code"),
                     F.col("summary").alias("explanation")))
    return {"symbols": symbols, "files": symbols.select("question", "file").distinct(), "examples": shown}


def answer_by_keyword(table: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """Fallback without vectors: 10 points for the name, 5 for the summary."""
    hits = table.select(F.col("name").alias("symbol"), "kind", "file", "summary",
                        _keyword_score(question, F.col("name"), F.col("summary")).alias("score"))
    return hits.filter(F.col("score") > 0).orderBy(F.desc("score"), "symbol", "file").limit(limit)


# --- tasks and quickstart -----------------------------------------------------
def task_views(table: DataFrame, files: DataFrame, tasks=None) -> DataFrame:
    """Entry points for common tasks as rows (task, reference); table needs ``chunk``."""
    name, low, file = F.col("name"), F.lower("name"), F.col("file")
    tests = []
    for task, kinds, exact, lower, in_file in tasks or rules.TASKS:
        hit = any_of([name.contains(t) for t in exact] + [low.contains(t) for t in lower]
                     + [file.contains(t) for t in in_file])
        if kinds:
            hit = hit & F.col("kind").isin(kinds)
        tests.append(F.when(hit, F.lit(task)))
    found = table.select(F.explode(F.array(*tests)).alias("task"), F.concat("file", F.lit(":"), "chunk").alias("reference"))
    entry = files.filter(any_of(F.col("path").contains(p) for p in rules.ENTRY_FILE_PARTS)).select(
        F.lit(rules.ENTRY_TASK).alias("task"), F.col("path").alias("reference"))
    return found.filter(F.col("task").isNotNull()).unionByName(entry)


def task_view(views: DataFrame, table: DataFrame, task: str, context: str | None = None) -> DataFrame:
    """References of a known task, else symbols whose name or summary holds the context words."""
    known = views.filter(F.col("task") == task).select("reference")
    if context is None or not known.isEmpty():
        return known
    low = context.lower()
    hit = F.lower("name").contains(low) | F.lower("summary").contains(low)
    return table.filter(hit).select(F.col("name").alias("reference")).distinct()


def task_types(views: DataFrame) -> DataFrame:
    return views.select("task").distinct()


def entry_points(table: DataFrame, n: int = 5) -> DataFrame:
    in_entry = (F.col("kind") == "function") & any_of(F.col("file").contains(p) for p in rules.ENTRY_FILE_PARTS)
    rows = table.filter((F.col("name") == "main") | in_entry)
    return (rows.select(F.concat("file", F.lit(":"), "name").alias("entry_point")).distinct()
            .orderBy("entry_point").limit(n))


def core_types(table: DataFrame, n: int = 10) -> DataFrame:
    rows = table.filter(F.col("kind").isin("struct", "enum") & ~F.col("file").contains("test")
                        & ~F.col("file").contains("example"))
    return rows.select("name").distinct().orderBy("name").limit(n)


def quickstart(table: DataFrame, edges: DataFrame, roles: DataFrame, edge_types=None) -> DataFrame:
    """Quickstart as rows (section, key, value); every section is a bounded list."""
    from codeloom.operators import hotspots

    def part(df: DataFrame, section: str, value: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(value).alias("key"), F.col(value).alias("value"))

    return (part(entry_points(table), "entry_points", "entry_point")
            .unionByName(part(core_types(table), "core_types", "name"))
            .unionByName(part(hotspots.most_impacting(edges, 10, edge_types), "most_connected", "symbol"))
            .unionByName(roles.select(F.lit("subsystem_map").alias("section"), F.col("intent").alias("key"),
                                      F.col("subsystem").alias("value"))))


# --- symbol table -------------------------------------------------------------
def symbol_table(symbols: DataFrame, communities: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """One row per symbol with signature, summary, span reference and community.

    communities: (symbol, subsystem). ``dedupe`` keeps one row per name, the one
    of the last file. Related symbols, references and examples stay relations of
    their own (``graph.neighbour_pairs``, ``mentions``), keyed by the name.
    """
    col = F.col
    rows = symbols.select(
        "name", "kind", col("path").alias("file"), "start",
        tx.span_reference(col("start"), col("end"), col("start_row"), col("end_row")).alias("chunk"),
        tx.signature(col("kind"), col("name"), col("parameters"), col("return_type"), col("generics")).alias("signature"),
        tx.symbol_summary(col("kind"), col("name"), col("docs")).alias("summary"))
    if communities is None:
        rows = rows.withColumn("subsystem", F.lit("unclustered"))
    else:
        rows = (rows.join(communities, rows["name"] == communities["symbol"], "left").drop("symbol")
                .withColumn("subsystem", F.coalesce("subsystem", F.lit("unclustered"))))
    if dedupe:
        other = [c for c in rows.columns if c != "name"]
        rows = rows.groupBy("name").agg(F.max_by(F.struct(*other), F.struct("file", "start")).alias("r")).select("name", "r.*")
    return rows


def related_symbols(edges: DataFrame) -> DataFrame:
    return graph.neighbour_pairs(edges, [rules.SYMBOL_TO_SYMBOL, rules.SYMBOL_SIMILARITY])


def symbol_sources(table: DataFrame, files: DataFrame) -> DataFrame:
    """Source text of every symbol by its byte span ``a-b``; the whole file otherwise."""
    span = F.split("chunk", "-")
    numeric = F.col("chunk").rlike("^[0-9]+-[0-9]+$")
    at = lambda i: F.when(numeric, span[i]).cast("bigint")
    text = F.when(numeric, tx.source_span(F.col("content"), at(0), at(1))).otherwise(F.col("content"))
    # the planner sees the size of compressed tables, not of texts made from them: never broadcast these
    return (table.join(files.select(F.col("path").alias("file"), "content").hint("merge"), "file")
            .select(F.col("name").alias("symbol"), "file", F.col("chunk").alias("chunk_range"), text.alias("content")))


def prompt_rows(table: DataFrame, sources: DataFrame, task: str = tx.PROMPT_TASK) -> DataFrame:
    """Input of an explanation model, one prompt per symbol; the model itself is the caller's."""
    rows = table.join(sources.select(F.col("symbol").alias("name"), "file", "content"), ["name", "file"], "left")
    return rows.select("name", "file", tx.explanation_prompt(
        F.col("kind"), F.col("name"), F.col("signature"), F.col("summary"), F.col("content"), task).alias("prompt"))
