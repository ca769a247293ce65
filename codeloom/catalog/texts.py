"""Tokens, labels, mentions, blocks and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import rules
from codeloom.catalog.derived import CODE_SQL, SYMBOL_SQL, code_files, symbol_table
from codeloom.catalog.registry import query
from codeloom.catalog.vectors import sql_embedding
from codeloom.functions import text as tx
from codeloom.functions import vectors as vx
from codeloom.operators import blocks, communities, embedding, mentions, search

_WORD = "[^\\p{L}\\p{M}\\p{N}_]+"
_IDENT = "regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
_BANNED = ", ".join(f"'{w}'" for w in rules.LABEL_STOPWORDS + rules.LABEL_VERBS)


def sql_ident(col: str) -> str:
    return f"list_filter(string_split_regex({_IDENT.format(c=col)}, '[^A-Za-z0-9]+'), lambda w: w <> '')"


def sql_label(col: str) -> str:
    return (f"list_transform(list_filter({sql_ident(col)}, lambda w: length(w) >= 3 AND lower(w) NOT IN ({_BANNED}) AND "
            "length(regexp_replace(w, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(w, '[^0-9]', '', 'g')) <= "
            "length(regexp_replace(w, '[^A-Za-z]', '', 'g'))), lambda w: lower(w))")


_MIXED = "'getHTTPServer_' || replace(source, ' ', '') || 'V' || doc_id || '::' || text"


@query("identifier_tokens", f"WITH d AS (SELECT doc_id, {_MIXED} AS s FROM documents) SELECT doc_id, array_to_string({sql_ident('s')}, ' ') AS tokens FROM d")
def identifier_tokens(t):
    """Tokens of identifiers and text."""
    s = F.expr(_MIXED)
    return t.documents.select("doc_id", F.array_join(tx.identifier_tokens(s), " ").alias("tokens"))


@query("label_tokens", f"WITH d AS (SELECT doc_id, {_MIXED} AS s FROM documents) SELECT doc_id, array_to_string({sql_label('s')}, ' ') AS tokens FROM d")
def label_tokens(t):
    """Tokens fit for labels."""
    return t.documents.select("doc_id", F.array_join(tx.label_tokens(F.expr(_MIXED)), " ").alias("tokens"))


@query("bigrams", f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '') AS l FROM conversations),
b AS (SELECT conv_id, turn, unnest(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1])) AS bigram FROM w)
SELECT bigram, count(*) AS n FROM b GROUP BY bigram""")
def bigrams(t):
    """Bigrams over the words of each turn."""
    b = t.conversations.select(F.explode(tx.bigrams(tx.words(F.col("text")))).alias("bigram"))
    return b.groupBy("bigram").agg(F.count("*").alias("n"))


@query("token_df", f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{_WORD}'), lambda x: x <> ''))) AS token FROM documents)
SELECT token, count(*) AS df FROM w GROUP BY token""")
def token_df(t):
    """Document frequency; repetition is removed inside the row."""
    w = t.documents.select(F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("df"))


_PHRASES = f"p AS (SELECT doc_id, source AS community, unnest({sql_label('text')}) AS phrase FROM documents)"
_SCORES = f"""{_PHRASES}, df AS (SELECT phrase, count(DISTINCT doc_id) AS df FROM p GROUP BY phrase), n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT community, phrase, count(*) AS tf FROM p GROUP BY community, phrase),
sc AS (SELECT community, phrase, tf, df, tf * ln(1 + n / (1 + df)) AS score FROM tf JOIN df USING (phrase), n)"""


def _scores(t):
    phrases = t.documents.select("doc_id", tx.label_tokens(F.col("text")).alias("phrases"))
    central = t.documents.select("doc_id", F.col("source").alias("community"))
    return communities.phrase_scores(phrases, central, ["doc_id"])


@query("tfidf", f"WITH {_SCORES} SELECT community, phrase, tf, df, round(score, 5) AS score FROM sc")
def tfidf(t):
    """TF-IDF of phrases per source."""
    return _scores(t).withColumn("score", F.round("score", 5))


@query("community_labels", f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(score, 9) DESC, phrase) AS k FROM sc)
SELECT community, string_agg(upper(phrase[1]) || substr(phrase, 2), ' + ' ORDER BY k) AS label FROM r WHERE k <= 3 GROUP BY community""")
def community_labels(t):
    """Labels from the best phrases of each source."""
    return communities.pick_labels(_scores(t))


@query("fallback_labels", f"""WITH s AS (SELECT p_type AS community, p_name || 'Part' AS symbol FROM part),
w AS (SELECT community, lower(unnest({sql_ident('symbol')})) AS token FROM s), c AS (SELECT community, token, count(*) AS n FROM w WHERE length(token) >= 3 GROUP BY community, token),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, token) AS k FROM c WHERE n >= 2)
SELECT community, token AS label FROM r WHERE k = 1 UNION ALL SELECT DISTINCT 'brand ' || p_brand, 'parse' FROM part""")
def fallback_labels(t):
    """Common prefix, else the most frequent token."""
    by_type = t.part.select(F.col("p_type").alias("community"), F.concat("p_name", F.lit("Part")).alias("symbol"))
    # every brand has one name on either side of the prefix's end
    by_brand = t.part.select(F.concat(F.lit("brand "), "p_brand").alias("community"), F.explode(F.array(
        F.concat(F.lit("parse_a"), "p_partkey"), F.concat(F.lit("parse_z"), "p_partkey"))).alias("symbol"))
    return communities.fallback_labels(by_type.unionByName(by_brand))


@query("comment_texts", f"""WITH c AS ({CODE_SQL})
SELECT path, '! ' || p_name || ' A ' || p_name || ' in stock [derive(Debug, Clone)]' || CASE WHEN p_size % 2 = 0 THEN ' price rules' ELSE '' END || ' Builds a ' || p_name AS comments FROM c""")
def comment_texts(t):
    """Comment text of each file."""
    return communities.comment_texts(code_files(t), ["path"], "content")


_NOUN_TEXT = "'the ' || p_type || ' Part ' || p_brand || ' is a HttpServer of max_size and v' || p_size || ' ' || upper(p_name) || ' with ' || p_name"


@query("noun_phrases", """SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS phrases FROM (SELECT p_partkey,
 [p_type || ' Part ' || string_split(p_brand, '#')[1]] || ['HttpServer'] || [CASE WHEN p_size >= 10 THEN 'max_size' ELSE 'max_size' END] ||
 [CASE WHEN p_size >= 10 THEN 'v' || p_size || ' ' || upper(p_name) ELSE upper(p_name) END] AS list_distinct_ordered FROM part)""")
def noun_phrases(t):
    """T4: runs of capitalised, mixed-case, snake_case and alphanumeric words."""
    return t.part.select("p_partkey", F.array_join(tx.noun_phrases(F.expr(_NOUN_TEXT)), "|").alias("phrases"))


@query("candidate_phrases", f"""WITH d AS (SELECT conv_id, turn, {sql_label('text')} || {sql_label("role || '_turnNumber' || turn")} || {sql_label("role || 'Message'")} AS s FROM conversations)
SELECT conv_id, turn, array_to_string(s || list_transform(generate_series(1, greatest(len(s) - 1, 0)), lambda i: s[i] || ' ' || s[i + 1]), ',') AS phrases FROM d""")
def candidate_phrases(t):
    """T5: candidate phrases of each turn with bigrams."""
    chunks = t.conversations.select("conv_id", "turn", F.concat("role", F.lit("_turnNumber"), "turn").alias("chunk_id"),
                                    F.array(F.concat("role", F.lit("Message"))).alias("containing_symbols"))
    comments = t.conversations.select("conv_id", "turn", F.col("text").alias("comments"))
    out = communities.candidate_phrases(chunks, ["conv_id", "turn"], comments, noun_phrases=False)
    return out.select("conv_id", "turn", F.array_join("phrases", ",").alias("phrases"))


_ROLE_CASE = """CASE WHEN has('server') OR has('rpc') OR has('handler') THEN 'RPC/server layer' WHEN has('cli') OR has('command') OR has('arg') THEN 'CLI interface'
 WHEN has('parse') OR has('syntax') THEN 'parsing and analysis' WHEN has('embed') OR has('model') OR has('inference') THEN 'embedding and ML inference'
 WHEN has('archive') OR has('zip') THEN 'archive I/O and packaging' WHEN has('graph') OR has('edge') OR has('node') THEN 'graph structures and algorithms'
 WHEN has('doc') OR has('generate') THEN 'documentation generation' WHEN has('ingest') OR has('process') OR has('extract') THEN 'source code ingestion' END"""


def _case(col: str, text: str) -> str:
    return text.replace("has(", f"contains(lower({col}), ")


_MEMBER_CASE = """CASE WHEN has('server') OR has('handler') OR has('request') THEN 0 WHEN has('cli') OR has('command') OR has('args') THEN 1
 WHEN has('read') OR has('write') OR has('file') OR has('path') THEN 2 WHEN has('parse') OR has('token') OR has('syntax') THEN 3
 WHEN has('embed') OR has('model') OR has('infer') THEN 4 WHEN has('graph') OR has('edge') OR has('node') THEN 5 END"""
# communities are sources, members the words of their texts
_DESCRIBED = f"""m AS (SELECT DISTINCT source AS community, unnest(list_filter(string_split_regex(lower(text), '{_WORD}'), lambda x: x <> '')) AS symbol, 'f' || (doc_id % 7) AS file FROM documents),
c AS (SELECT community, count(DISTINCT symbol) AS n_symbols, count(DISTINCT file) AS n_files, min({_case('symbol', _MEMBER_CASE)}) AS rule FROM m GROUP BY community),
lab AS (SELECT community, CASE WHEN right(community, 1) IN ('1', '2') THEN 'Node' WHEN right(community, 1) = '3' THEN 'ArgParser' WHEN right(community, 1) IN ('4', '5') THEN 'Plain' END AS label FROM c),
des AS (SELECT community, coalesce(label, 'subsystem_' || community) AS name, label, n_symbols, n_files, n_symbols / 100000.0::DOUBLE AS confidence,
 coalesce({_case('label', _ROLE_CASE)}, CASE rule WHEN 0 THEN 'RPC/server layer' WHEN 1 THEN 'CLI interface' WHEN 2 THEN 'I/O operations' WHEN 3 THEN 'parsing and analysis'
 WHEN 4 THEN 'embedding and ML inference' WHEN 5 THEN 'graph structures and algorithms' ELSE 'core logic' END) AS role FROM c JOIN lab USING (community))"""


def _members(t):
    return t.documents.select(F.col("source").alias("community"), F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("symbol"),
                              F.concat(F.lit("f"), F.col("doc_id") % 7).alias("file")).distinct()


def _described(t, rows):
    tail = F.substring("community", -1, 1)
    label = F.when(tail.isin("1", "2"), "Node").when(tail == "3", "ArgParser").when(tail.isin("4", "5"), "Plain")
    c = communities.assemble(rows).withColumn("cohesion", F.col("n_symbols") / F.lit(100000.0))
    return communities.describe(c, rows, c.select("community", label.alias("label")))


@query("communities", f"WITH {_DESCRIBED} SELECT community, name, n_symbols, n_files, confidence, role, 'Subsystem ''' || coalesce(label, 'unnamed') || ''' (' || n_symbols || ' symbols): ' || role AS summary FROM des")
def community_table(t):
    """Communities with size, role and summary."""
    return _described(t, _members(t))


@query("extraction_suggestions", f"WITH {_DESCRIBED} SELECT community, n_symbols, n_files FROM c WHERE n_files > 1 AND n_symbols >= 3 ORDER BY n_symbols DESC, community LIMIT 5")
def extraction_suggestions(t):
    """Communities worth a module."""
    return communities.extraction_suggestions(communities.assemble(_members(t)))


@query("list_communities", f"WITH {_DESCRIBED} SELECT name, confidence, role FROM des WHERE confidence >= 0.02 AND contains(name, 'o')")
def list_communities(t):
    """Q7: communities by name and confidence."""
    return communities.list_communities(_described(t, _members(t)), "o", 0.02).select("name", "confidence", "role")


@query("community_of_symbols", f"""WITH {_DESCRIBED}, r AS (SELECT m.symbol, d.name, row_number() OVER (PARTITION BY m.symbol ORDER BY d.confidence DESC, d.community) AS k FROM (SELECT DISTINCT community, symbol FROM m) m JOIN des d USING (community))
SELECT symbol, name AS subsystem FROM r WHERE k = 1""")
def community_of_symbols(t):
    """The most confident community of each symbol."""
    rows = _members(t)
    return communities.community_of_symbols(_described(t, rows), rows)


@query("community_detail", f"""WITH {_DESCRIBED}, s AS ({SYMBOL_SQL}), w AS (SELECT lower(split_part(name, ' ', 1)) AS w, kind, file, summary FROM s UNION ALL SELECT symbol, 'word', 'f0', 'w' FROM m WHERE length(symbol) = 2)
SELECT DISTINCT m.symbol, w.kind, w.file, w.summary FROM m JOIN des USING (community) JOIN w ON w.w = m.symbol WHERE des.name = 'ArgParser'""")
def community_detail(t):
    """Members of a community that are in the symbol table."""
    rows = _members(t)
    table = symbol_table(t).select(F.lower(F.substring_index("name", " ", 1)).alias("name"), "kind", "file", "summary")
    short = rows.filter(F.length("symbol") == 2).select(F.col("symbol").alias("name"), F.lit("word").alias("kind"),
                                                        F.lit("f0").alias("file"), F.lit("w").alias("summary"))
    return communities.community_detail(_described(t, rows), rows, table.unionByName(short), "ArgParser").distinct()


@query("communities_of_file", f"WITH {_DESCRIBED} SELECT community, name FROM des WHERE community IN (SELECT community FROM m WHERE file = 'f3')")
def communities_of_file(t):
    """Communities that touch a file."""
    rows = _members(t)
    return communities.communities_of_file(_described(t, rows), rows, "f3").select("community", "name")


@query("role_map", f"""WITH {_DESCRIBED}, i AS (SELECT *, unnest(list_filter([CASE WHEN contains(lower(role), 'cli') THEN 'if_adding_feature' END, CASE WHEN contains(lower(role), 'i/o') OR contains(lower(role), 'archive') THEN 'if_fixing_io' END,
 CASE WHEN contains(lower(role), 'server') OR contains(lower(role), 'rpc') THEN 'if_changing_server' END, CASE WHEN contains(lower(role), 'parsing') OR contains(lower(role), 'analysis') THEN 'if_modifying_parser' END,
 CASE WHEN contains(lower(role), 'embed') OR contains(lower(role), 'ml') THEN 'if_changing_embeddings' END, CASE WHEN contains(lower(role), 'graph') THEN 'if_modifying_graph' END], lambda x: x IS NOT NULL)) AS intent FROM des),
r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY confidence, community) AS k FROM i)
SELECT intent, name AS subsystem FROM r WHERE k = 1""")
def role_map(t):
    """Q10: intent to community by role."""
    return communities.role_map(_described(t, _members(t)))


# --- mentions -----------------------------------------------------------------
_NAMES = f"""nm AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '')) AS name FROM benchmark)"""
_MENTION_CHUNKS = """ch AS (SELECT CASE WHEN lang = 'en' THEN 'tests/' WHEN lang = 'de' THEN 'src/' ELSE 'guide/' END || source || '/d' || doc_id || CASE WHEN lang = 'fr' THEN '.md' WHEN lang = 'es' THEN '.py' ELSE '_test.rs' END AS path, doc_id, text FROM documents)"""
_REF_CHUNKS = f"{_MENTION_CHUNKS}, fl AS (SELECT *, contains(path, 'test') AS is_test, path LIKE '%.md' AS is_doc FROM ch WHERE contains(path, 'test') OR path LIKE '%.md')"


def _mention_chunks(t):
    c = F.col
    path = F.concat(F.when(c("lang") == "en", "tests/").when(c("lang") == "de", "src/").otherwise("guide/"), "source", F.lit("/d"),
                    "doc_id", F.when(c("lang") == "fr", ".md").when(c("lang") == "es", ".py").otherwise("_test.rs"))
    return t.documents.select(path.alias("path"), F.lit(0).cast("bigint").alias("chunk_ord"),
                              F.concat(c("doc_id"), F.lit("-"), c("doc_id") + 5).alias("chunk_id"), "text")


def _names(t):
    return t.benchmark.select(F.explode(tx.words(F.col("text"))).alias("name")).distinct()


@query("mentions", f"""WITH {_NAMES}, w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '')) AS name FROM documents)
SELECT name, count(*) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS checksum FROM w JOIN nm USING (name) GROUP BY name""")
def mention_counts(t):
    """Whole-word mentions of every name in every text, by an inverted-index join."""
    hits = mentions.mention_pairs(t.documents, _names(t), keys=("doc_id",))
    return hits.groupBy("name").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("checksum"))


_TWO_WORDS = f"""n2 AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS name FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM
 (SELECT list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '') AS w FROM benchmark)))"""


@query("phrase_mentions", f"""WITH {_TWO_WORDS}, tx AS (SELECT doc_id, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]', ' | ', 'g') || ' ' AS text FROM documents)
SELECT name, count(*) AS n_docs FROM n2 JOIN tx ON contains(text, ' ' || name || ' ') GROUP BY name""")
def phrase_mentions(t):
    """Names of two words, found by their longest word and then verified."""
    names = t.benchmark.select(F.explode(tx.bigrams(tx.words(F.col("text")))).alias("name")).distinct()
    hits = mentions.mention_pairs(t.documents, names, keys=("doc_id",))
    return hits.groupBy("name").agg(F.count("*").alias("n_docs"))


@query("cross_references", f"""WITH {_NAMES}, {_REF_CHUNKS}, w AS (SELECT DISTINCT path, doc_id, is_test, is_doc, unnest(list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '')) AS name FROM fl),
h AS (SELECT * FROM w JOIN nm USING (name))
SELECT name, ref_type, count(*) AS n, min(path || ':' || doc_id || '-' || (doc_id + 5)) AS first FROM (SELECT *, 'test' AS ref_type FROM h WHERE is_test UNION ALL SELECT *, 'doc' FROM h WHERE is_doc) GROUP BY name, ref_type""")
def cross_references(t):
    """Distinct locations in test and doc files."""
    refs = mentions.cross_references(_mention_chunks(t), _names(t))
    return refs.groupBy("name", "ref_type").agg(F.count("*").alias("n"), F.min("location").alias("first"))


_SNIPPET = """s1 AS (SELECT *, strpos(text, name) - 1 AS pos FROM k), s2 AS (SELECT *, greatest(pos - 75, 0) AS st, least(pos + length(name) + 75, length(text)) AS en FROM s1),
s3 AS (SELECT *, substr(text, st + 1, en - st) AS sn FROM s2), s4 AS (SELECT *, CASE WHEN st > 0 AND contains(sn, chr(10)) THEN substr(sn, strpos(sn, chr(10)) + 1) ELSE sn END AS sn2 FROM s3),
s5 AS (SELECT *, CASE WHEN en < length(text) THEN regexp_replace(sn2, '\\n[^\\n]*$', '') ELSE sn2 END AS sn3 FROM s4)"""


@query("usage_examples", f"""WITH {_NAMES}, {_REF_CHUNKS}, w AS (SELECT DISTINCT path, doc_id, is_test, unnest(list_filter(string_split_regex(text, '{_WORD}'), lambda x: x <> '')) AS name FROM fl),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_test DESC, path) AS rank FROM w JOIN nm USING (name)),
k AS (SELECT r.name, r.rank, r.path, r.doc_id, r.is_test, d.text FROM r JOIN documents d USING (doc_id) WHERE rank <= 5), {_SNIPPET}
SELECT name, rank, path AS file, CASE WHEN is_test THEN 'test' ELSE 'doc' END AS example_type, sha256(trim(sn3, ' ' || chr(9) || chr(10) || chr(13))) AS context, doc_id AS line_start, doc_id + 5 AS line_end FROM s5""")
def usage_examples(t):
    """Five examples per name with their context."""
    e = mentions.usage_examples(_mention_chunks(t), _names(t))
    return e.withColumn("context", F.sha2("context", 256))


# --- blocks -------------------------------------------------------------------
_SHARE = """w AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> '')) AS s FROM conversations),
g AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w),
sh AS (SELECT *, CASE WHEN b IS NULL OR least(len(s), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(s, b)) / least(len(s), len(b)) END AS share FROM g),
bl AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR share < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM sh)"""


def _turns(t):
    return t.conversations.select("conv_id", "turn", F.concat("role", F.lit("::turn"), "turn", F.lit(":x")).alias("chunk_id"),
                                  F.array_distinct(tx.words(F.lower("text"))).alias("containing_symbols"))


def _blocks(t):
    return blocks.semantic_blocks(_turns(t), ["conv_id"], "turn", share=0.3)


@query("overlap_share", f"WITH {_SHARE} SELECT conv_id, turn, round(share, 6)::DOUBLE AS share FROM sh WHERE b IS NOT NULL")
def overlap_share(t):
    """Shared words over the smaller set, for neighbouring turns."""
    from codeloom.functions.ordered import shift_value

    rows = shift_value(_turns(t), ["conv_id"], "turn", F.col("containing_symbols"), "b", back=True)
    return rows.filter(F.col("b").isNotNull()).select(
        "conv_id", "turn", F.round(vx.overlap_share(F.col("containing_symbols"), F.col("b")), 6).alias("share"))


@query("semantic_blocks", f"WITH {_SHARE} SELECT conv_id, turn, block FROM bl")
def semantic_blocks(t):
    """Runs of turns that share words."""
    return _blocks(t).select("conv_id", "turn", "block")


@query("block_representatives", f"""WITH {_SHARE}, f AS (SELECT conv_id, block, symbol, count(*) AS freq FROM (SELECT conv_id, block, unnest(s) AS symbol FROM bl) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY freq DESC, symbol) AS rank FROM f) SELECT conv_id, block, symbol, freq, rank FROM r WHERE rank <= 6""")
def block_representatives(t):
    """Most frequent words of each block."""
    return blocks.representatives(_blocks(t), ["conv_id"])


@query("block_names", f"WITH {_SHARE} SELECT conv_id, block, count(*) AS n_chunks, 'turn' || min(turn) AS name FROM bl GROUP BY conv_id, block")
def block_names(t):
    """Name of each block from its first chunk."""
    return blocks.block_names(_blocks(t), ["conv_id"], "turn")


@query("merged_blocks")
def merged_blocks(t):
    """Neighbouring blocks merged until stable; the fold is checked in the tests."""
    vec = embedding.hashing_embedding(t.conversations, "text", ["conv_id", "turn"])
    rows = _blocks(t).join(vec, ["conv_id", "turn"])
    ord_ = F.col("turn").cast("bigint")
    return blocks.merge_blocks(rows.select(
        F.col("conv_id").cast("string").alias("path"), ord_.alias("chunk_ord"), "chunk_id", "block", "containing_symbols",
        F.array(F.substring_index("chunk_id", "::", 1)).alias("kinds"), F.lit(None).cast("bigint").alias("community"),
        "embedding", F.array(ord_ - 1, ord_ + 1).alias("links")))


# --- search -------------------------------------------------------------------
_S = f"s AS ({SYMBOL_SQL})"


def _hits_sql(score: str, where: str = "true", summary: str = "summary", limit: int = 20) -> str:
    return f"""WITH {_S}, h AS (SELECT name AS symbol, kind, file, subsystem, {summary} AS summary, ({score})::DOUBLE AS score FROM s WHERE {where})
SELECT *, (SELECT count(*) FROM h WHERE score > 0) AS total FROM h WHERE score > 0 ORDER BY score DESC, symbol, file LIMIT {limit}"""


@query("keyword_search", _hits_sql("(contains(lower(name), 'red'))::INT * 10 + (contains(lower(summary), 'red'))::INT * 5 + (lower(name) = 'red')::INT * 20"))
def keyword_search(t):
    """Q1, K1: keyword search with the total before the cut."""
    return search.keyword_search(symbol_table(t), "Red")


@query("keyword_search_filtered", _hits_sql("(contains(lower(name), 'widget'))::INT * 10 + (contains(lower(summary), 'widget'))::INT * 5", "subsystem = 'PROMO' AND kind = 'struct'", limit=5))
def keyword_search_filtered(t):
    """Q1: search limited to a community and a kind."""
    return search.keyword_search(symbol_table(t), "widget", 5, "PROMO", "struct")


_SIG = "summary || chr(10) || 'Signature: ' || signature"


@query("signature_search", _hits_sql("""CASE WHEN lower(signature) = 'fn red_widget(size: i32) -> result' THEN 100 WHEN contains(lower(signature), 'fn red_widget(size: i32) -> result') THEN 50
 ELSE ((contains(lower(signature), 'red_widget'))::INT + (contains(lower(signature), 'size'))::INT + (contains(lower(signature), 'i32'))::INT + (contains(lower(signature), 'result'))::INT) / 4.0 * 30 END
 + CASE WHEN contains(split_part(lower(signature), '->', 2), 'result') THEN 20 ELSE 0 END""", "signature IS NOT NULL", _SIG))
def signature_search(t):
    """Q3: signature search with token share and return type bonus."""
    return search.signature_search(symbol_table(t), "fn red_widget(size: i32) -> Result")


@query("get_symbol", f"WITH {_S} SELECT * FROM s WHERE name = 'small ring 0'")
def get_symbol(t):
    """Q4, Q12: lookup by key."""
    return search.get_symbol(symbol_table(t), "small ring 0")


@query("list_symbols", f"WITH {_S} SELECT DISTINCT name FROM s WHERE contains(lower(name), 'ring') ORDER BY name LIMIT 100")
def list_symbols(t):
    """Q4: names by pattern."""
    return search.list_symbols(symbol_table(t), "RING")


@query("answer_by_keyword", f"""WITH {_S}, h AS (SELECT name AS symbol, kind, file, summary, ((contains(lower(name), 'blue'))::INT * 10 + (contains(lower(summary), 'blue'))::INT * 5)::DOUBLE AS score FROM s)
SELECT * FROM h WHERE score > 0 ORDER BY score DESC, symbol, file LIMIT 10""")
def answer_by_keyword(t):
    """Q6: keyword fallback for questions."""
    return search.answer_by_keyword(symbol_table(t), "Blue")


_ASK = f"""{sql_embedding('benchmark', 'item_id', 'text', 'q')}, {sql_embedding('documents', 'doc_id', 'text', 'd')},
sc AS (SELECT item_id AS question, doc_id AS chunk, round(sum(q.x * d.x), 9) AS score FROM q JOIN d USING (slot) GROUP BY item_id, doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) AS rank FROM sc)"""


def _ask_inputs(t):
    q = embedding.hashing_embedding(t.benchmark, "text", ["item_id"], hash_name="md5").withColumnRenamed("item_id", "question_id")
    d = embedding.hashing_embedding(t.documents, "text", ["doc_id"], hash_name="md5")
    return q, d.withColumnRenamed("doc_id", "chunk_key")


def _ask_chunks(t):
    return t.documents.select(F.col("doc_id").alias("chunk_key"), F.col("source").alias("file"), "text")


def _ask_symbols(t):
    return t.documents.select(F.concat(F.lit("sym_"), "lang", F.lit("_"), "source").alias("name"), F.col("source").alias("file")).distinct()


@query("semantic_hits", f"WITH {_ASK} SELECT question, chunk, rank FROM h WHERE rank <= 20")
def semantic_hits(t):
    """Q2, K2: best texts of every question by vector."""
    q, vectors = _ask_inputs(t)
    return search.chunk_hits(q, vectors, 20).select("question", "chunk", "rank")


_ASK_RANK = f"""{_ASK}, sy AS (SELECT DISTINCT 'sym_' || lang || '_' || source AS symbol, source AS file FROM documents),
f AS (SELECT question, source AS file, sum(score) AS score FROM h JOIN documents ON doc_id = chunk WHERE rank <= 20 GROUP BY question, source),
r AS (SELECT question, symbol, file, round(sum(score), 9) AS score FROM f JOIN sy USING (file) GROUP BY question, symbol, file),
k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, symbol, file) AS rank FROM r)"""


@query("ask_rank", f"WITH {_ASK_RANK} SELECT question, symbol, file, round(score, 5) AS score, rank FROM k WHERE rank <= 10")
def ask_rank(t):
    """Symbols of the files hit by each question, scores summed."""
    q, vectors = _ask_inputs(t)
    ranked = search.rank_symbols(search.chunk_hits(q, vectors, 20), _ask_chunks(t), _ask_symbols(t), 10)
    return ranked.withColumn("score", F.round("score", 5))


def _answers(t):
    q, vectors = _ask_inputs(t)
    table = _ask_symbols(t).select("name", "file", F.lit("struct").alias("kind"), F.concat(F.lit("in "), "file").alias("summary"))
    return search.answer_questions(q, _ask_chunks(t), table, 10, vectors=vectors)


@query("ask_files", f"WITH {_ASK_RANK} SELECT DISTINCT question, file FROM k WHERE rank <= 10")
def ask_files(t):
    """Q5: files of the answer to each question."""
    return _answers(t)["files"]


@query("ask_examples", f"""WITH {_ASK_RANK}, b AS (SELECT question, source AS file, arg_min(text, rank) AS text FROM h JOIN documents ON doc_id = chunk WHERE rank <= 20 GROUP BY question, source)
SELECT question, rank, symbol, sha256(text) AS digest, 'in ' || file AS explanation FROM k JOIN b USING (question, file) WHERE rank <= 3""")
def ask_examples(t):
    """Q5: code examples of the answer, the best text of each file by its digest."""
    shown = _answers(t)["examples"]
    return shown.select("question", "rank", "symbol", F.sha2("code", 256).alias("digest"), "explanation")


_TASK_SQL = f"""{_S}, tk AS (SELECT 'improve_search' AS task, file || ':' || chunk AS reference FROM s WHERE kind = 'function' AND (contains(name, 'search') OR contains(name, 'query') OR contains(name, 'find'))
UNION ALL SELECT 'add_cli_command', file || ':' || chunk FROM s WHERE kind IN ('enum', 'struct') AND (contains(lower(name), 'command') OR contains(lower(name), 'cli') OR contains(lower(name), 'args'))
UNION ALL SELECT 'modify_rpc_handler', file || ':' || chunk FROM s WHERE kind = 'function' AND (contains(name, 'handle_') OR contains(name, 'process_') OR contains(lower(name), 'server'))
UNION ALL SELECT 'change_pack_format', file || ':' || chunk FROM s WHERE contains(name, 'Manifest') OR contains(name, 'Builder')
UNION ALL SELECT 'modify_ml_inference', file || ':' || chunk FROM s WHERE contains(lower(name), 'embed') OR contains(lower(name), 'model') OR contains(lower(name), 'infer') OR contains(file, 'embedding') OR contains(file, 'nlp')
UNION ALL SELECT 'add_subsystem', file FROM (SELECT DISTINCT file FROM s) WHERE contains(file, 'main.rs') OR contains(file, 'lib.rs'))"""
_WORDY = ["search", "Builder", "handle_", "cli", "model", "plain"]
_WORDY_SQL = "CASE " + " ".join(f"WHEN p_partkey % 6 = {i} THEN '{w}'" for i, w in enumerate(_WORDY)) + " END || '_' || p_name"
_WORDY_TASKS = _TASK_SQL.replace(_S, "s AS (" + SYMBOL_SQL.replace("p_name || ' ' || CAST(p_partkey AS STRING) AS name", f"{_WORDY_SQL} AS name") + ")")


def _wordy(t):
    names = t.part.selectExpr(f"{_WORDY_SQL} AS wordy", "p_name || ' ' || CAST(p_partkey AS STRING) AS name")
    return symbol_table(t).join(names, "name").drop("name").withColumnRenamed("wordy", "name")


@query("task_views", f"WITH {_WORDY_TASKS} SELECT task, reference, count(*) AS n FROM tk GROUP BY task, reference")
def task_views(t):
    """Q8: references for common tasks."""
    table = _wordy(t)
    files = table.select(F.col("file").alias("path")).distinct()
    return search.task_views(table, files).groupBy("task", "reference").agg(F.count("*").alias("n"))


@query("task_types", f"WITH {_WORDY_TASKS} SELECT DISTINCT task FROM tk")
def task_types(t):
    """Q9: known task types."""
    table = _wordy(t)
    return search.task_types(search.task_views(table, table.select(F.col("file").alias("path")).distinct()))


@query("task_fallback", f"WITH {_S} SELECT DISTINCT name AS reference FROM s WHERE contains(lower(name), 'anvil') OR contains(lower(summary), 'anvil')")
def task_fallback(t):
    """Q9: keyword fallback for an unknown task."""
    table = symbol_table(t)
    return search.task_view(search.task_views(table, table.select(F.col("file").alias("path")).distinct()), table, "unknown", "Anvil")


@query("entry_points", f"WITH {_S} SELECT DISTINCT file || ':' || name AS entry_point FROM s WHERE name = 'main' OR (kind = 'function' AND (contains(file, 'main.rs') OR contains(file, 'lib.rs'))) ORDER BY 1 LIMIT 5")
def entry_points(t):
    """K3, Q10: entry points."""
    return search.entry_points(symbol_table(t))


@query("core_types", f"WITH {_S} SELECT DISTINCT name FROM s WHERE kind IN ('struct', 'enum') AND NOT contains(file, 'test') AND NOT contains(file, 'example') ORDER BY name LIMIT 10")
def core_types(t):
    """K3, Q10: core types."""
    return search.core_types(symbol_table(t))


@query("explanation_prompts", f"""WITH {_S} SELECT name, sha256('{tx.PROMPT_TASK}' || chr(10) || 'kind=' || kind || chr(10) || 'name=' || name
 || CASE WHEN signature IS NULL THEN '' ELSE chr(10) || 'signature=' || signature END || chr(10) || 'summary=' || summary || chr(10) || 'code:' || chr(10)
 || left(repeat(summary, 20), 500) || chr(10) || 'answer:') AS digest FROM s""")
def explanation_prompts(t):
    """Prompt rows for an explanation model."""
    c = F.col
    return symbol_table(t).select("name", F.sha2(tx.explanation_prompt(
        c("kind"), c("name"), c("signature"), c("summary"), F.repeat("summary", F.lit(20))), 256).alias("digest"))


@query("cleaned_responses", """WITH l AS (SELECT doc_id, list_filter(string_split(trim(text, ' ' || chr(10)), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l[1:3], ' ')) AS digest FROM l""")
def cleaned_responses(t):
    """First three non-blank lines of a response."""
    return t.documents.select("doc_id", F.sha2(tx.clean_response(F.col("text")), 256).alias("digest"))
