"""Files, lines, chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.catalog.derived import CODE_SQL, DOC_SQL, TEXT_PATH, code_files, doc_files, text_files
from codeloom.catalog.registry import query
from codeloom.functions import paths
from codeloom.functions import text as tx
from codeloom.operators import chunking, docs, files as fo, incremental, lines
from codeloom.session import checkpoint_dir
from codeloom.sources import tree
from codeloom.streaming import refresh

# lines of a text in the check's SQL: the empty piece after a final break is no line
SQL_LINES = """
SELECT {key}, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS line, len(l) AS n
FROM (SELECT {key}, string_split_regex({text}, '\\r?\\n') AS l FROM {table})"""


def sql_lines(table: str, key: str = "path", text: str = "content") -> str:
    inner = SQL_LINES.format(table=table, key=key, text=text)
    return f"SELECT {key}, line_no, line FROM ({inner}) WHERE NOT (line_no = n - 1 AND line = '')"


URL_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("classify_urls", rf"""
WITH p AS (SELECT page_id, regexp_replace({URL_PATH}, '^[^/]*/', '') AS path FROM pages),
e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p),
x AS (SELECT *, CASE WHEN name LIKE '_%.%' THEN regexp_extract(name, '.\.([^.]*)$', 1) ELSE '' END AS ext FROM e)
SELECT page_id, path, ext,
 CASE WHEN ext IN ('rs','ts','py','js','cpp','java') THEN 'SourceCode' WHEN ext IN ('md','rst','txt') THEN 'Documentation'
      WHEN ext IN ('toml','yml','json') THEN 'Config' ELSE 'Other' END AS kind,
 nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS module FROM x""")
def classify_urls(t):
    """Kind, extension and module of URL paths."""
    path = paths.drop_root(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""))
    rows = t.pages.select("page_id", path.alias("path"))
    ext = paths.extension(F.col("path"))
    return rows.select("page_id", "path", ext.alias("ext"), paths.classify(ext).alias("kind"),
                       paths.parent_module(F.col("path")).alias("module"))


# --- fixed values: file names given to the parts in turn ----------------------
NOISE_NAMES = ["LICENSE", "COPYING", ".gitignore", "Cargo.lock", "package-lock.json", "image.png", "font.woff2",
               "README", "CHANGELOG.md", "CONTRIBUTING", "README.md", "lib.rs", "main.rs", "notes.txt",
               "Code-of-Conduct.md", ".eslintrc.json", "pnpm-lock.yaml", "a.tar.GZ", "my.PDF", "config.toml"]
_PICK = "CASE " + " ".join(f"WHEN p_partkey % {len(NOISE_NAMES)} = {i} THEN '{n}'" for i, n in enumerate(NOISE_NAMES)) + " END"
NOISE_PATH = f"lower(p_type) || '/' || {_PICK}"


@query("noise_paths", f"""
WITH p AS (SELECT p_partkey, {NOISE_PATH} AS path FROM part)
SELECT p_partkey, path, regexp_matches(lower(path),
 '/(license|copying|\\.gitignore|cargo\\.lock|package-lock\\.json|image\\.png|font\\.woff2|readme|changelog\\.md|contributing|code-of-conduct\\.md|\\.eslintrc\\.json|pnpm-lock\\.yaml|my\\.pdf)$') AS is_noise FROM p""")
def noise_paths(t):
    """Licence, lock, media and dot files."""
    rows = t.part.selectExpr("p_partkey", f"{NOISE_PATH} AS path")
    return rows.select("p_partkey", "path", paths.is_noise(F.col("path")).alias("is_noise"))


@query("file_plans", f"""
WITH p AS (SELECT p_partkey, {NOISE_PATH} AS path FROM part),
k AS (SELECT *, CASE WHEN path LIKE '%.rs' THEN 'SourceCode' WHEN path LIKE '%.md' OR path LIKE '%.txt' THEN 'Documentation'
 WHEN path LIKE '%.json' OR path LIKE '%.toml' THEN 'Config' ELSE 'Other' END AS kind FROM p)
SELECT path, kind, count(*) AS n_files,
 CASE kind WHEN 'SourceCode' THEN 'CodeAware' WHEN 'Documentation' THEN 'HeadingSections' ELSE 'None' END AS chunking,
 kind = 'SourceCode' AS symbol_parse, kind IN ('SourceCode', 'Documentation') AS embed,
 CASE kind WHEN 'SourceCode' THEN 'SymbolLinkedChunks' WHEN 'Documentation' THEN 'NodePerChunk' ELSE 'OneNodePerFile' END AS assembly
FROM k GROUP BY path, kind""")
def file_plans(t):
    """Processing plan by kind, joined from the rule table."""
    rows = tree.as_files(t.part.selectExpr(f"{NOISE_PATH} AS path", "p_name AS content"))
    plan = fo.plan_files(rows)
    return plan.groupBy("path", "kind", "chunking", "symbol_parse", "embed", "assembly").agg(F.count("*").alias("n_files"))


@query("binary_probe", """
SELECT lang, count(*) AS n_docs, count(*) FILTER (lang = 'de' OR octet_length(encode(text)) < 1024) AS n_binary
FROM documents GROUP BY lang""")
def binary_probe(t):
    """A zero byte early in German texts, at the end of the others."""
    nul = F.lit(bytearray(b"\x00"))
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "de", F.concat(nul, body)).otherwise(F.concat(body, nul))
    rows = t.documents.select("lang", tree.looks_binary(content).alias("b"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("b").alias("n_binary"))


@query("file_metadata", f"""
WITH d AS ({DOC_SQL}), l AS ({sql_lines('d')})
SELECT path, max(CASE WHEN line_no = 0 THEN line END) AS title,
 CAST(count(*) FILTER (line LIKE '%#%') AS VARCHAR) AS anchors, 'md' AS filetype FROM l GROUP BY path""")
def file_metadata(t):
    """Metadata map of documentation files, read back as columns."""
    m = fo.metadata(fo.plan_files(doc_files(t)))
    return m.select("path", *[F.col("metadata")[k].alias(k) for k in ("title", "anchors", "filetype")])


@query("extractions", f"""
WITH d AS ({DOC_SQL}), l AS ({sql_lines('d')}),
h AS (SELECT path, 0 AS extract_ord, 'Headings' AS extract, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (ltrim(line) LIKE '#%'), '') AS text FROM l GROUP BY path),
a AS (SELECT path, 2 AS extract_ord, 'Anchors' AS extract, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line LIKE '%#%'), '') AS text FROM l GROUP BY path)
SELECT path, extract_ord, extract, sha256(text) AS digest FROM
 (SELECT * FROM h UNION ALL SELECT * FROM a UNION ALL SELECT path, 1, 'FullText', content FROM d)""")
def extractions(t):
    """Headings, full text and anchors of documentation files."""
    out = fo.extractions(fo.plan_files(doc_files(t)))
    return out.select("path", "extract_ord", "extract", F.sha2("text", 256).alias("digest"))


_TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query("line_stats", f"""
WITH c AS ({CODE_SQL}), l AS (SELECT path, line_no, {_TRIMMED} AS line FROM ({sql_lines('c')})),
e AS (SELECT *, CASE WHEN line LIKE '%*/%' THEN 0 WHEN line LIKE '%/*%' THEN 1 END AS ev FROM l),
s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM e),
k AS (SELECT path, line = '' AS b, line <> '' AND (open = 1 OR line LIKE '%/*%' OR line LIKE '//%') AS c FROM s)
SELECT path, count(*) AS total, count(*) FILTER (NOT b AND NOT c) AS code, count(*) FILTER (c) AS comment, count(*) FILTER (b) AS blank
FROM k GROUP BY path""")
def line_stats(t):
    """Code, comment and blank lines; folded inside each row."""
    return lines.line_stats(code_files(t))


@query("document_line_stats", f"""
WITH c AS (SELECT {TEXT_PATH} AS path, text AS content FROM documents), l AS ({sql_lines('c')})
SELECT path, count(*) AS total, count(*) FILTER ({_TRIMMED} <> '') AS code, CAST(0 AS BIGINT) AS comment,
 count(*) FILTER ({_TRIMMED} = '') AS blank FROM l GROUP BY path""")
def document_line_stats(t):
    """Documentation variant over the plain texts."""
    return lines.document_line_stats(text_files(t))


@query("block_state", f"""
WITH c AS ({CODE_SQL}), l AS ({sql_lines('c')}),
e AS (SELECT *, CASE WHEN line LIKE '%*/%' THEN 0 WHEN line LIKE '%/*%' THEN 1 END AS ev FROM l),
s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM e)
SELECT path, CAST(count(*) FILTER (open = 1) AS BIGINT) AS n_in_block, CAST(sum(line_no * open) AS BIGINT) AS weighted FROM s GROUP BY path""")
def block_state(t):
    """Running block-comment state over the line table."""
    rows = lines.block_state(lines.line_table(code_files(t)))
    return rows.groupBy("path").agg(F.count_if("in_block").alias("n_in_block"),
                                    F.sum(F.col("line_no") * F.col("in_block").cast("int")).alias("weighted"))


@query("imports", f"""
WITH c AS ({CODE_SQL}), l AS ({sql_lines('c')}),
f AS (SELECT path, line_no, {_TRIMMED} AS import FROM l WHERE {_TRIMMED} LIKE 'use %' OR {_TRIMMED} LIKE 'import %'),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS import_ord FROM f)
SELECT path, import_ord, import FROM r WHERE import_ord < 20""")
def imports(t):
    """P10: first import lines of each file."""
    return lines.imports(code_files(t))


@query("path_flags", f"""
WITH c AS ({CODE_SQL}), p AS (SELECT path FROM c UNION ALL SELECT path FROM ({DOC_SQL}))
SELECT path, contains(path, 'test') AS is_test, (path LIKE '%.md' OR path LIKE '%.txt' OR contains(path, 'README')
 OR contains(path, 'doc/') OR contains(path, 'docs/')) AS is_doc FROM p""")
def path_flags(t):
    """Test and documentation paths."""
    p = code_files(t).select("path").unionByName(doc_files(t).select("path"))
    return p.select("path", paths.is_test_path(F.col("path")).alias("is_test"),
                    paths.is_doc_path(F.col("path")).alias("is_doc"))


@query("content_validation", f"""
WITH c AS ({CODE_SQL}), v AS (SELECT path, content FROM c UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN '{{' || props ELSE props END FROM events),
n AS (SELECT path, content, length(content) - length(replace(content, '{{', '')) AS o, length(content) - length(replace(content, '}}', '')) AS k FROM v)
SELECT path, o = k AS valid, CASE WHEN o <> k THEN 'Unbalanced braces: ' || o || ' open, ' || k || ' close' ELSE '' END AS error,
 CASE WHEN content = '' THEN 'File content is empty' ELSE '' END AS warning FROM n""")
def content_validation(t):
    """Brace balance and empty files."""
    props = (F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", F.concat(F.lit("{"), "props"))
             .otherwise(F.col("props")))
    rows = code_files(t).select("path", "content").unionByName(
        t.events.select(F.col("event_id").cast("string").alias("path"), props.alias("content")))
    return fo.validate(rows).select("path", "valid", F.array_join("errors", "").alias("error"),
                                    F.array_join("warnings", "").alias("warning"))


PATCH = ("'--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') "
         "|| chr(10) || '-' || source || chr(10) || ' same' || chr(10) || '@@ -9 +9 @@' || chr(10) || '-' || lang")


@query("patch_stats", f"""
WITH p AS (SELECT doc_id AS patch_id, {PATCH} AS patch FROM documents), l AS ({sql_lines('p', 'patch_id', 'patch')})
SELECT patch_id, count(*) FILTER (line LIKE '@@%') AS hunks, count(*) FILTER (line LIKE '+%' AND line NOT LIKE '+++%') AS lines_added,
 count(*) FILTER (line LIKE '-%' AND line NOT LIKE '---%') AS lines_removed FROM l GROUP BY patch_id""")
def patch_stats(t):
    """Hunks, added and removed lines."""
    return fo.patch_statistics(t.documents.selectExpr("doc_id AS patch_id", f"{PATCH} AS patch"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(t):
    """Fingerprint per text."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


_NEW_DOCS = "SELECT doc_id + CASE WHEN lang = 'es' THEN 10000000 ELSE 0 END AS doc_id, text || CASE WHEN lang = 'fr' THEN '!' ELSE '' END AS text FROM documents"


@query("changed_docs", f"""
WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents), b AS (SELECT doc_id AS path, sha256(text) AS h FROM ({_NEW_DOCS}))
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS status
FROM a FULL OUTER JOIN b ON a.path = b.path""")
def changed_docs(t):
    """New, modified, deleted and unchanged files by hash."""
    digest = F.sha2("text", 256).alias("sha256")
    old = t.documents.select(F.col("doc_id").alias("path"), digest)
    new = t.documents.select(
        F.when(F.col("lang") == "es", F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("path"),
        F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return incremental.changed_files(old, new.select("path", digest))


@query("merged_chunks", f"""
WITH b AS ({_NEW_DOCS})
SELECT doc_id AS path, count(*) AS n_chunks, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS c FROM b) GROUP BY doc_id""")
def merged_chunks(t):
    """Stored chunks of unchanged files merged with recomputed ones of changed files."""
    old = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    new = t.documents.select(
        F.when(F.col("lang") == "es", F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("path"),
        F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    digest = lambda df: df.select("path", F.sha2("content", 256).alias("sha256"))
    status = incremental.changed_files(digest(old), digest(new))
    cut = lambda df: chunking.by_delimiter(df, ". ")
    merged = incremental.merge_table(cut(old), cut(incremental.to_process(new, status)), status)
    return merged.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query("refreshed_chunks", f"""
WITH b AS ({_NEW_DOCS})
SELECT doc_id || '.txt' AS path, count(*) AS n_chunks, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS c FROM b) GROUP BY doc_id""")
def refreshed_chunks(t):
    """ST1: all texts as one batch, then new, changed, deleted and unchanged ones as a second; the stored chunks after it."""
    path, moved = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang") == "es"
    first = t.documents.select(path, F.col("text").alias("content"))
    renamed = t.documents.filter(moved).select(F.concat((F.col("doc_id") + 10_000_000).cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    second = t.documents.select(path, F.when(~moved, F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content"))
    folder = f"{checkpoint_dir(t.spark)}/refresh/{uuid.uuid4().hex}"
    derive = lambda files: {"chunks": chunking.by_delimiter(files, ". ")}
    for token, batch in (("first", first), ("second", second.unionByName(renamed))):
        refresh.refresh_batch(t.spark, folder, batch, derive, token, buckets=32)
    stored = refresh.read_current(t.spark, folder, "chunks")
    return stored.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query("file_structure", """
SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 'file' AS node_type, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents""")
def file_structure(t):
    """Flat file list with sizes."""
    return tree.file_structure(text_files(t))


@query("chunk_whole", "SELECT doc_id, 'full' AS chunk_id, length(text) AS n, sha256(text) AS digest FROM documents")
def chunk_whole(t):
    """One chunk per text."""
    out = chunking.whole(t.documents, "text", ("doc_id",))
    return out.select("doc_id", "chunk_id", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("digest"))


@query("chunk_lines", f"""
WITH l AS ({sql_lines('documents', 'doc_id', 'text')})
SELECT doc_id, 'l-' || (line_no // 3) AS chunk_id, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM l GROUP BY doc_id, line_no // 3""")
def chunk_lines(t):
    """Chunks of three lines."""
    out = chunking.by_lines(t.documents, 3, "text", ("doc_id",))
    return out.select("doc_id", "chunk_id", F.sha2("text", 256).alias("digest"))


@query("chunk_delimiter", """
SELECT doc_id, 'd-' || i AS chunk_id, sha256(c) AS digest FROM
 (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS c FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents))""")
def chunk_delimiter(t):
    """C4: chunks between delimiters."""
    out = chunking.by_delimiter(t.documents, ". ", "text", ("doc_id",))
    return out.select("doc_id", "chunk_id", F.sha2("text", 256).alias("digest"))


_PARAGRAPHS = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || chr(10))"


@query("chunk_paragraphs", f"""
WITH p AS (SELECT doc_id, string_split({_PARAGRAPHS}, chr(10) || chr(10)) AS l FROM documents),
r AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS i, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS c FROM p)
SELECT doc_id, 'c-' || i AS chunk_id, sha256(c) AS digest FROM r WHERE c <> ''""")
def chunk_paragraphs(t):
    """Blank-line paragraphs."""
    rows = t.documents.selectExpr("doc_id", f"{_PARAGRAPHS} AS text")
    out = chunking.by_paragraph(rows, "text", ("doc_id",))
    return out.select("doc_id", "chunk_id", F.sha2("text", 256).alias("digest"))


_HEADING_SQL = """
l AS (SELECT path, e, unnest(generate_series(0, len(l) - 1)) AS j, unnest(l) AS line, len(l) AS n FROM (SELECT path, e, string_split(content, chr(10)) AS l FROM x)),
s AS (SELECT *, sum(CASE WHEN ltrim(line, ' ' || chr(9)) LIKE '#%' AND j > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path, e ORDER BY j) AS sec FROM l),
g AS (SELECT path, e, sec, max(j) AS last, max(n) AS n, string_agg(line, chr(10) ORDER BY j) || chr(10) AS text FROM s GROUP BY path, e, sec)
SELECT path, 'h-' || e || '-' || CASE WHEN last = n - 1 THEN 'tail' ELSE CAST(last + 1 AS VARCHAR) END AS chunk_id, sha256(text) AS digest FROM g"""


@query("chunk_headings", f"WITH x AS (SELECT path, 1 AS e, content FROM ({DOC_SQL})), {_HEADING_SQL}")
def chunk_headings(t):
    """Heading sections of the full text."""
    out = chunking.documentation_chunks(fo.plan_files(doc_files(t)))
    return out.select("path", "chunk_id", F.sha2("text", 256).alias("digest"))


@query("chunk_all_extractions", f"""
WITH d AS ({DOC_SQL}), q AS ({sql_lines('d')}),
x AS (SELECT path, 1 AS e, content FROM d
 UNION ALL SELECT path, 0, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (ltrim(line) LIKE '#%'), '') FROM q GROUP BY path
 UNION ALL SELECT path, 2, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line LIKE '%#%'), '') FROM q GROUP BY path), {_HEADING_SQL}""")
def chunk_all_extractions(t):
    """Heading chunks of every extraction of the plan."""
    out = chunking.documentation_chunks(fo.plan_files(doc_files(t)), all_extractions=True)
    return out.select("path", "chunk_id", F.sha2("text", 256).alias("digest"))


@query("language_histogram", "SELECT 'txt' AS language, count(*) AS n_files FROM documents UNION ALL SELECT 'rs', count(*) FROM part")
def language_histogram(t):
    """Files per language."""
    return docs.language_histogram(text_files(t).select("ext").unionByName(code_files(t).select("ext")))
