"""Definitions of Rust sources.

Rules are regular expressions per kind; spans come from the running brace depth.
One scan of a file's lines inside its row finds headers, parents and ends, so
lines are never shuffled or sorted; names, parameters and the other parts are
columns over the definitions found.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.code_mask import mask_source, masked

VIS = r"(?:pub(?:\([^)]*\))?\s+)?"

# --- fixed values: kind, pattern on the trimmed line, group of the name -------
DEFINITION_RULES = [
    ("function", VIS + r"(?:(?:async|unsafe|const|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"),
    ("struct", VIS + r"struct\s+(\w+)"),
    ("enum", VIS + r"enum\s+(\w+)"),
    ("trait", VIS + r"(?:unsafe\s+)?trait\s+(\w+)"),
    ("impl", r"(?:unsafe\s+)?(impl)\b"),
    ("type_alias", VIS + r"type\s+(\w+)"),
    ("use", VIS + r"use\s+([^;{]+)"),
    ("const", VIS + r"const\s+(?!fn\b|unsafe\b|async\b|extern\b)(\w+)"),
    ("static", VIS + r"static\s+(?:mut\s+)?(\w+)"),
    ("mod", VIS + r"mod\s+(\w+)"),
    ("macro", r"macro_rules!\s*(\w+)"),
]
FIELD_RULE = VIS + r"(\w+)\s*:[^:]"
VARIANT_RULE = r"([A-Z]\w*)\s*(?:[({=,].*)?$"
CONTAINERS = ["struct", "enum", "trait", "impl"]

_FILE = ["path"]


def _match(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, "^" + pattern, 1), F.lit(""))


# --- one scan of a file's lines -------------------------------------------------
_RULES = [(kind, re.compile(pattern, re.A)) for kind, pattern in DEFINITION_RULES]
_ENDS_HEADER = re.compile(r"\{|;\s*$", re.A)
_CLOSES = re.compile(r"\}|;\s*$", re.A)
_IMPL_HEAD = re.compile(r"^(?:unsafe\s+)?impl\s*(?:<[^{]*?>)?\s+", re.A)
_IMPL_TAIL = re.compile(r"\s*(?:where\b.*|\{.*)$", re.A)
_IMPL_TRAIT = re.compile(r"^(.*)\s+for\s+", re.A)
_UPTO_FOR = re.compile(r"^.*\bfor\s+", re.A)
_NEWLINE = re.compile("\r?\n")

_LINE = pa.schema([
    ("path", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("code", pa.string()), ("shown", pa.string()),
    ("offset", pa.int64()), ("depth", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("impl_target", pa.string()),
    ("trait_impl", pa.string()), ("doc_lines", pa.list_(pa.string())), ("attributes", pa.list_(pa.string())), ("header", pa.string()),
    ("parent", pa.struct([("level", pa.int64()), ("name", pa.string()), ("kind", pa.string())])),
    ("stop", pa.struct([("row", pa.int32()), ("byte", pa.int64())]))])
_LINE_TYPE = ("path string, line_no int, line string, code string, shown string, offset bigint, depth bigint, kind string, name string, "
              "impl_target string, trait_impl string, doc_lines array<string>, attributes array<string>, header string, "
              "parent struct<level: bigint, name: string, kind: string>, stop struct<row: int, byte: bigint>")
BATCH_LINES = 20_000


def _split(text: str) -> list[str]:
    if text == "":
        return []
    return _NEWLINE.split(text[:-2] if text.endswith("\r\n") else text[:-1] if text.endswith("\n") else text)


def _start(shown: str) -> tuple[str | None, str | None]:
    """Kind and name of the definition a line opens, if any, by the plain rules."""
    for kind, rule in _RULES:
        if hit := rule.match(shown):
            return kind, hit[1].strip(tx.WHITE) or None
    return None, None


def _impl_names(shown: str) -> tuple[str, str | None]:
    bare = _IMPL_TAIL.sub("", _IMPL_HEAD.sub("", shown))
    trait = _IMPL_TRAIT.match(bare)
    return _UPTO_FOR.sub("", bare).strip(tx.WHITE), (trait[1].strip(tx.WHITE) or None) if trait else None


def _live_lines(content: str):
    """Lines that can define something, in order, with the doc and attribute lines directly above (blank lines skipped).

    ``code`` is the line without comments and what literals hold, ``shown`` the same trimmed: only they are matched and
    counted. ``depth`` and ``after`` are the open braces before and behind the line.
    """
    offset = after = 0
    docs, attributes = [], []
    for number, (line, code) in enumerate(zip(_split(content), _split(mask_source(content)))):
        shown, depth, begin = code.strip(tx.WHITE), after, offset
        opened = code.count("{")
        after += opened - code.count("}")
        offset += len(line.encode()) + 1
        if shown.startswith(("///", "//!")):
            docs.append(line.strip(tx.WHITE))
        elif shown.startswith("#["):
            attributes.append(line.strip(tx.WHITE))
        elif line.strip(tx.WHITE):
            yield {"line_no": number, "line": line, "code": code, "shown": shown, "offset": begin, "depth": depth, "after": after,
                   "opened": opened, "doc_lines": docs, "attributes": attributes}
            docs, attributes = [], []


def _scan(content: str) -> list[dict]:
    """Lines that open a definition or stand directly in a struct or enum, with header, parent and end.

    The header goes from the first line to the first ``{`` or ``;``; it is the first line alone if there is none. The parent
    is the container opened last at the deepest level around the line; the end is the first later line that returns to the
    depth and closes something.
    """
    rows = list(_live_lines(content))
    last, parts, around = None, [], {}
    for row in rows:
        shown, depth = row["shown"], row["depth"]
        row["kind"], row["name"] = kind, name = _start(shown)
        row["impl_target"], row["trait_impl"] = _impl_names(shown) if kind == "impl" else (None, None)
        row["header"] = row["parent"] = None
        if kind is not None:
            last, parts = row, []
            row["header"] = shown
        if last is not None:
            parts.append(shown)
            if _ENDS_HEADER.search(row["code"]):
                last["header"], last = " ".join(parts), None
        for level in range(depth - 1, -1, -1):
            if (found := around.get(level)) and found["kind"] in CONTAINERS:
                row["parent"] = found
                break
        if kind in CONTAINERS or row["opened"] > 0:
            name = row["impl_target"] if row["impl_target"] is not None else name
            around[depth] = {"level": depth, "name": name, "kind": kind if kind in CONTAINERS else "other"}
    ends, kept = {}, []
    for row in reversed(rows):
        if _CLOSES.search(row["code"]):
            code = row["code"].rstrip(" \t\n\x0b\f\r")
            ends[row["after"]] = {"row": row["line_no"], "byte": row["offset"] + len(row["line"][:len(code)].encode())}
        row["stop"] = ends.get(max(row["depth"], 0))
        parent = row["parent"]
        if row["kind"] is not None or (parent is not None and parent["level"] == row["depth"] - 1 and parent["kind"] in ("struct", "enum")):
            kept.append(row)
    return kept[::-1]


def _lines(files: DataFrame) -> DataFrame:
    """``_scan`` of every file (path, content): one pass over its lines inside the row, without a shuffle."""
    def table(found):
        return pa.RecordBatch.from_pylist(found, schema=_LINE)

    def run(batches):
        found = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in _scan(content) if content is not None else ():
                    found.append(row | {"path": path})
                    if len(found) >= BATCH_LINES:
                        yield table(found)
                        found = []
        if found:
            yield table(found)

    return files.mapInArrow(run, _LINE_TYPE)


# --- the same by windows over the line table: tests compare the scan with it --------
def _depth_table(files: DataFrame) -> DataFrame:
    """Line table with byte offsets, brace depth before and after, and line class.

    ``code`` is the line without comments and what literals hold, ``shown`` the same trimmed: only they are matched and
    counted. ``trimmed`` is the line as it stands.
    """
    pairs = F.arrays_zip(tx.lines(F.col("content")).alias("line"), tx.lines(F.col("masked")).alias("code"))
    lines = masked(files).select("path", F.posexplode(pairs).alias("line_no", "pair")).select("path", "line_no", "pair.line", "pair.code")
    order = Window.partitionBy("path").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    trimmed, shown = tx.trim(F.col("line")), tx.trim(F.col("code"))
    out = (lines.withColumn("trimmed", trimmed).withColumn("shown", shown)
           .withColumn("opened", tx.occurrences(F.col("code"), "{"))
           .withColumn("closed", tx.occurrences(F.col("code"), "}"))
           .withColumn("offset", F.coalesce(F.sum(F.octet_length("line").cast("bigint") + 1).over(before),
                                            F.lit(0).cast("bigint")))
           .withColumn("depth_after", F.sum(F.col("opened") - F.col("closed")).over(upto))
           .withColumn("depth", F.col("depth_after") - F.col("opened") + F.col("closed")))
    line_class = (F.when(shown.startswith("///") | shown.startswith("//!"), "doc")
                  .when(shown.startswith("#["), "attr").when(trimmed == "", "blank").otherwise("stop"))
    return out.withColumn("line_class", line_class)


def _starts(lines: DataFrame) -> DataFrame:
    """Kind and name of the definition a line opens, if any, by the plain rules."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_kind, pattern in reversed(DEFINITION_RULES):
        hit = F.col("shown").rlike("^" + pattern)
        kind = F.when(hit, rule_kind).otherwise(kind)
        name = F.when(hit, _match(F.col("shown"), pattern)).otherwise(name)
    live = F.col("line_class") == "stop"
    return lines.withColumn("kind", F.when(live, kind)).withColumn("name", F.when(live, tx.trim(name)))


def _add_lead(rows: DataFrame) -> DataFrame:
    """Lines that can stop a lead, each with the doc and attribute lines directly above it, blank lines skipped.

    A stopper and the lines between it and the one before are a group, which becomes one row, so every line is held once.
    """
    earlier = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stops", F.coalesce(F.count_if(F.col("line_class") == "stop").over(earlier), F.lit(0)))
    rest = [c for c in rows.columns if c not in ("path", "stops", "line_no")]

    def pick(wanted: str) -> Column:
        found = F.collect_list(F.when(F.col("line_class") == wanted, F.struct("line_no", "trimmed")))
        return F.transform(F.array_sort(found), lambda x: x["trimmed"])

    groups = rows.groupBy("path", "stops").agg(
        F.max(F.struct("line_no", *rest)).alias("last"), pick("doc").alias("doc_lines"), pick("attr").alias("attributes"))
    return groups.select("path", "last.*", "doc_lines", "attributes").filter(F.col("line_class") == "stop")


def _add_header(rows: DataFrame) -> DataFrame:
    """Text of each definition from its first line to the first ``{`` or ``;``; its first line alone if there is none.

    Only header lines are gathered, so rows do not carry the rest of their file.
    """
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_start = F.col("kind").isNotNull()
    rows = rows.withColumn("seq", F.count_if(is_start).over(upto))
    group = Window.partitionBy("path", "seq")
    ordered = group.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.min(F.when(F.col("code").rlike(r"\{|;\s*$"), F.col("line_no"))).over(group)
    rows = rows.withColumn("header_last", F.when(F.col("seq") > 0, last))
    part = F.when(is_start | (F.col("line_no") <= F.col("header_last")), F.col("shown"))
    header = F.array_join(F.collect_list(part).over(ordered), " ")
    return rows.withColumn("header", F.when(is_start, header))


def _add_nesting(rows: DataFrame) -> DataFrame:
    """End of each definition and the innermost container around each line.

    A line takes part in every depth up to its own and in the depth it leaves
    behind. Per file and depth, in line order: the end is the first later line
    that returns to the depth and closes something; the container is the last
    one opened there. The deepest container wins. All windows keep the file's
    partitioning, so none of them shuffles again.
    """
    depths = F.sequence(F.lit(0), F.greatest(F.col("depth"), F.lit(0)).cast("int"))
    wide = rows.withColumn("level", F.explode(F.array_distinct(
        F.concat(depths, F.array(F.greatest(F.col("depth_after"), F.lit(0)).cast("int"))))))
    here = F.col("level") == F.col("depth")
    is_container = F.coalesce(F.col("kind").isin(CONTAINERS), F.lit(False))
    opened = F.when(here & (is_container | (F.col("opened") > 0)), F.struct(
        "level", F.coalesce("impl_target", "name").alias("name"),
        F.when(is_container, F.col("kind")).otherwise("other").alias("kind")))
    closes = F.col("code").rlike(r"\}|;\s*$")
    closed = F.when((F.col("depth_after") == F.col("level")) & closes, F.struct(
        F.col("line_no").alias("row"), (F.col("offset") + _bytes_to(F.regexp_replace(F.col("code"), r"\s+$", ""))).alias("byte")))
    in_order = Window.partitionBy("path", "level").orderBy("line_no")
    wide = (wide.withColumn("around", F.last(opened, ignorenulls=True).over(
                in_order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("stop", F.first(closed, ignorenulls=True).over(
                in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    enclosing = F.when((F.col("level") < F.col("depth")) & F.col("around.kind").isin(CONTAINERS), F.col("around"))
    return (wide.withColumn("parent", F.max(enclosing).over(Window.partitionBy("path", "line_no")))
            .filter(here | ((F.col("depth") < 0) & (F.col("level") == 0))))


def _bytes_to(code: Column) -> Column:
    """Bytes of the line as far as ``code``, a beginning of its masked form, goes."""
    return F.octet_length(F.substr(F.col("line"), F.lit(1), F.length(code)))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _top_level_parts(text: Column) -> Column:
    """Split at commas that no bracket encloses: pieces join up while a bracket is open."""
    def step(acc: Column, piece: Column) -> Column:
        plain = F.replace(piece, F.lit("->"), F.lit(""))
        grown = F.concat(F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1),
                         F.array(F.concat(F.element_at(acc["parts"], -1), F.lit(","), piece)))
        return F.struct(
            F.when(acc["depth"] > 0, grown).otherwise(F.concat(acc["parts"], F.array(piece))).alias("parts"),
            (acc["depth"] + _count(plain, "<([{") - _count(plain, ">)]}")).alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("depth"))
    return F.aggregate(F.split(text, ","), start, step, lambda acc: acc["parts"])


def _parameters(header: Column) -> Column:
    inner = F.regexp_extract(header, r"fn\s+\w+\s*(?:<[^(]*>)?\s*\((.*?)\)\s*(?:->|where\b|\{|;|$)", 1)
    parts = F.filter(F.transform(_top_level_parts(inner), tx.trim), lambda p: p != "")
    one = lambda p: F.when(
        p.rlike(r"(^|[\s&])self$"), F.struct(p.alias("name"), p.alias("type"))).otherwise(
        F.struct(tx.trim(F.regexp_extract(p, r"^([^:]*):", 1)).alias("name"),
                 tx.trim(F.regexp_extract(p, r"^[^:]*:(.*)$", 1)).alias("type")))
    return F.when(F.size(parts) > 0, F.transform(parts, one))


def definitions(files: DataFrame) -> DataFrame:
    """Definition table of all ``.rs`` files: kind, name, span, docs, attributes, parent."""
    sources = files.filter(F.col("path").endswith(".rs")).select("path", "content")
    rows = _lines(sources)
    is_impl = F.col("kind") == "impl"
    member_of = lambda kind: (F.col("parent.kind") == kind) & (F.col("parent.level") == F.col("depth") - 1)
    is_field = F.col("kind").isNull() & member_of("struct") & F.col("shown").rlike("^" + FIELD_RULE)
    is_variant = F.col("kind").isNull() & member_of("enum") & F.col("shown").rlike("^" + VARIANT_RULE)
    kind = (F.when(is_field, "field").when(is_variant, "variant")
            .when((F.col("kind") == "type_alias") & member_of("trait"), "associated_type").otherwise(F.col("kind")))
    name = (F.when(is_field, _match(F.col("shown"), FIELD_RULE))
            .when(is_variant, _match(F.col("shown"), VARIANT_RULE))
            .when(is_impl, F.concat_ws(" for ", "trait_impl", "impl_target")).otherwise(F.col("name")))
    rows = rows.withColumn("kind2", kind).withColumn("name", name).withColumn("kind", F.col("kind2")).drop("kind2")

    found = rows.filter(F.col("kind").isNotNull())
    header = F.when(F.col("kind").isin("field", "variant"), F.col("shown")).otherwise(F.col("header"))
    # a trait's function without a body is a signature, not a definition
    found = found.filter(~((F.col("kind") == "function") & tx.trim(header).endswith(";")))
    return found.select(
        "path", "name", "kind",
        (F.col("offset") + F.octet_length("line") - F.octet_length(tx.ltrim(F.col("line")))).alias("start"),
        F.when(F.col("kind").isin("field", "variant"),
               F.col("offset") + _bytes_to(F.regexp_replace(F.col("code"), r",?\s*$", "")))
        .otherwise(F.col("stop.byte")).alias("end"),
        F.col("line_no").cast("bigint").alias("start_row"),
        F.when(F.col("kind").isin("field", "variant"), F.col("line_no")).otherwise(F.col("stop.row"))
        .cast("bigint").alias("end_row"),
        F.col("parent.name").alias("parent"),
        F.nullif(F.array_join("doc_lines", "\n"), F.lit("")).alias("docs"),
        F.when(~F.col("kind").isin("impl", "variant", "macro", "associated_type"),
               F.nullif(F.regexp_extract("shown", r"^(pub(?:\([^)]*\))?)\s", 1), F.lit(""))).alias("visibility"),
        F.when(F.col("kind") == "function", _parameters(header)).alias("parameters"),
        F.when(F.col("kind") == "function",
               F.nullif(tx.trim(F.regexp_extract(header, r"\)\s*->\s*([^{;]*?)\s*(?:where\b.*)?[{;]", 1)), F.lit("")))
        .alias("return_type"),
        F.when(F.col("kind").isin("function", "struct", "enum", "trait", "type_alias"),
               F.nullif(F.regexp_extract(header, r"(?:fn|struct|enum|trait|type)\s+\w+\s*(<[^({]*>)", 1), F.lit("")))
        .when(F.col("kind") == "impl", F.nullif(F.regexp_extract(header, r"^(?:unsafe\s+)?impl\s*(<[^{]*?>)\s", 1),
                                                F.lit(""))).alias("generics"),
        F.col("trait_impl"),
        F.when(F.col("kind").isin("field", "const", "static"),
               F.nullif(tx.trim(F.regexp_extract("shown", r":\s*([^=;]*?)\s*(?:[,;=].*)?$", 1)), F.lit("")))
        .alias("field_type"),
        "attributes",
        ((F.col("kind") == "static") & F.col("shown").rlike(r"\bstatic\s+mut\b")).alias("is_mutable"),
        F.when(F.col("kind").isin("function", "trait", "impl"),
               F.filter(F.split(F.regexp_extract(header, r"^" + VIS + r"(.*?)\b(?:fn|trait|impl)\b", 1), r"\s+"),
                        lambda m: m.isin("async", "unsafe", "const", "extern")))
        .otherwise(F.array().cast("array<string>")).alias("modifiers"))


def definition_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks by definition: one per top-level item, impls and traits split per member.

    What lies deeper, as the items of an inline module or of a function body, is part of its item's chunk. Containers with
    members give way to them; a file without definitions is one chunk. The file text is joined once per file and cut inside the row.
    """
    is_block = F.col("kind").isin("impl", "trait")
    # items nest or follow each other: one that starts before an earlier end lies inside
    items = symbols.filter(~F.col("kind").isin("field", "variant"))
    order = Window.partitionBy("path").orderBy("start", F.desc("end"))
    before, upto = (order.rowsBetween(Window.unboundedPreceding, k) for k in (-1, Window.currentRow))
    rows = items.select("path", "kind", "name", "start", F.coalesce("end", "start").alias("end"))
    rows = rows.withColumn("top", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)))
    rows = rows.withColumn("block", F.last(F.when(F.col("top"), F.struct("start", "kind", "name")), ignorenulls=True).over(upto))
    within = (Window.partitionBy("path", "block.start").orderBy("start", F.desc("end"))
              .rowsBetween(Window.unboundedPreceding, -1))
    direct = F.coalesce(F.col("start") >= F.max(F.when(~F.col("top"), F.col("end"))).over(within), F.lit(True))
    is_member = (~F.col("top") & direct & F.col("block.kind").isin("impl", "trait")
                 & F.col("kind").isin("function", "const", "type_alias", "associated_type"))
    rows = rows.withColumn("is_member", is_member)
    rows = rows.withColumn("n_members", F.count_if("is_member").over(Window.partitionBy("path", "block.start")))
    top_kind = F.col("kind").isin("function", "mod", "struct", "enum", "const", "static", "type_alias", "macro", "use")
    plain = F.col("top") & top_kind
    is_block = is_block & F.col("top")
    prefix = (F.when(F.col("kind") == "function", "fn").when(F.col("kind") == "macro", "macro_definition")
              .when(F.col("kind") == "use", "use_declaration").when(F.col("kind") == "type_alias", "type")
              .otherwise(F.col("kind")))
    shown = F.when(F.col("kind") == "use", F.lit("use_declaration")).otherwise(F.col("name"))
    label = (F.when(F.col("is_member"), F.concat("block.kind", F.lit(" "), "block.name", F.lit("::"), "name"))
             .when(is_block, F.concat("kind", F.lit(" "), "name"))
             .otherwise(F.concat(prefix, F.lit("::"), shown)))
    kept = rows.filter(F.col("is_member") | (is_block & (F.col("n_members") == 0)) | plain)
    spans = kept.select("path", "start", "end",
                        F.concat(label, F.lit(":"), "start", F.lit("-"), "end").alias("chunk_id"))
    # spans of one file
    listed = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "chunk_id"))).alias("spans"))
    # the planner sees the size of compressed tables, not of texts or lists made from them: never broadcast these
    texts = files.filter(F.col("path").endswith(".rs")).select("path", "content").join(listed.hint("merge"), "path", "left")
    full = F.array(F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"),
                            F.lit("full").alias("chunk_id")))
    out = texts.select("path", "content", F.posexplode(F.coalesce("spans", full)).alias("ord", "s"))
    cut = F.when(F.col("s.start").isNull(), F.col("content")).otherwise(
        tx.source_span(F.col("content"), F.col("s.start"), F.col("s.end")))
    return out.select("path", F.col("ord").cast("bigint").alias("chunk_ord"), F.col("s.chunk_id").alias("chunk_id"),
                      F.col("s.start").alias("start"), F.col("s.end").alias("end"), cut.alias("text"))
