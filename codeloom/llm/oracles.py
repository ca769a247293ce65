"""Check SQL (DuckDB) of the operators' queries. Written from the contract of each, not from the operators' code paths."""

from __future__ import annotations

from codeloom.llm.url_filters import VARIABLE, Rule

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, struct_pack(a := -len, b := doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
"""

# all pairs that share a shingle, then components by the smallest id that spreads along links
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id),
classes AS (SELECT gs, min(doc_id) AS rep FROM sets GROUP BY gs),
member AS (SELECT sets.doc_id, rep FROM sets JOIN classes ON sets.gs = classes.gs),
rs AS (SELECT s.* FROM s JOIN member m ON s.doc_id = m.doc_id AND m.rep = m.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT DISTINCT x AS origin, x AS here FROM both_ways UNION SELECT origin, y FROM reach JOIN both_ways ON here = x),
comp AS (SELECT origin, min(here) AS c FROM reach GROUP BY origin)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, rep, w.doc_id) AS component_id,
       w.doc_id = coalesce(comp.c, rep, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN member m ON m.doc_id = w.doc_id LEFT JOIN comp ON comp.origin = m.rep
"""


def _best(shards: int) -> str:
    scores = ", ".join(f"struct_pack(u := ('0x' || md5(k || ':{s}')[:13])::BIGINT, s := {s})" for s in range(shards))
    return f"(list_max([{scores}])).s"


# CRC-32 with the reflected polynomial: a table of 256 steps, then one step for each byte
SHARDING = f"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, doc_id::VARCHAR AS k, strlen(coalesce(text, '')) + 1 AS size,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
r AS (SELECT *, {_best(8)} AS shard, {_best(9)} AS grown_shard, (('0x' || md5(k)[:8])::BIGINT % 1024) AS bucket FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard FROM r
"""


# Python's str.isspace, letters and digits of words, letters that may go on with a sentence
BLANK, LETTER, GOING_ON = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]", r"[\p{L}\p{N}_]", r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"


def quality_rules(rules: dict, boilerplate: tuple[str, ...], noise: str, separators: str, ends: tuple[str, ...], all_ends: frozenset[str]) -> str:
    """Lines keep their place in the text; their words are counted and compared as whole strings.

    ``pf`` doubles the characters between words, so that phrases next to each other do not share a border.
    """
    phrases = "|".join(boilerplate).replace(" ", "  ")
    marks = " OR ".join("ends_with(lw, '" + e.replace("'", "''") + "')" for e in ends)
    closing = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in sorted(all_ends)).replace("'", "''") + "]"
    item = rf"^(?:{BLANK}|[-*+•‣–—]{BLANK}|(?:\p{{Nd}}+|{LETTER})[.)]{BLANK})"
    border = LETTER.replace("[", "[^")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) t(k) GROUP BY 1),
l0 AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
l1 AS (SELECT *, regexp_extract_all(line, '{WORD}') AS lws FROM l0 WHERE line <> ''),
l2 AS (SELECT *, len(lws) AS n, lws[-1] AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AND len(lws) > 0 AS again,
       strlen(line) AS size, regexp_matches(line, '^{BLANK}*{GOING_ON}') AS going_on,
       regexp_extract_all('  ' || regexp_replace(line, '({border})', '\\1\\1', 'g') || '  ', '(?i){border}({phrases}){border}', 1) AS pf FROM l1),
l3 AS (SELECT *, coalesce(going_on AND lag(i) OVER near = i - 1, false) OR coalesce(lead(going_on) OVER near AND lead(i) OVER near = i + 1, false) AS wrapped,
       coalesce(list_sum(list_transform(pf, lambda p: len(regexp_extract_all(p, '{WORD}')))), 0) AS furniture
       FROM l2 WINDOW near AS (PARTITION BY doc_id ORDER BY i)),
l4 AS (SELECT *, len(regexp_extract_all(line, '{noise}')) > {rules['noise_share']} * size
       OR len(regexp_extract_all(line, '{separators}')) > {rules['separator_share']} * greatest(n, 1) OR again
       OR (furniture > 0 AND (furniture >= {rules['phrase_share']} * n OR (n <= {rules['short_words']} AND NOT wrapped))) AS clear FROM l3),
l5 AS (SELECT *, coalesce(lag(n > {rules['few_words']} AND NOT clear) OVER near, false) OR coalesce(lead(n > {rules['few_words']} AND NOT clear) OVER near, false) AS beside
       FROM l4 WINDOW near AS (PARTITION BY doc_id ORDER BY i)),
l6 AS (SELECT *, clear OR (n > {rules['open_end_words']} AND NOT ({marks}) AND n <= {rules['few_words']} AND NOT beside AND NOT wrapped AND NOT going_on
       AND NOT regexp_matches(line, '{closing}{BLANK}*$') AND NOT regexp_matches(line, '{item}')) AS bad FROM l5),
line AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_lost_words FROM l6 GROUP BY 1),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
         FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_lost_words <= {rules['max_loss']} * n_words AS kept FROM judged
"""


def url_filters(rules: list[Rule], depth: int = 4, max_children: int = 16, min_support: int = 8, z: float = 1.96,
                prior: float = 0.3, weight: float = 4.0, reject: float = 0.8) -> str:
    """The tree is built level by level in one chain of common table expressions."""
    longest = sorted(rules, key=lambda r: -len(r.text))
    fits = {r.text: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in longest}
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for t, f in fits.items()) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in longest) + " END"
    variable = VARIABLE.replace("'", "''")
    steps, tree = [], "t0"
    for k in range(depth + 1):
        steps.append(f"""
h{k} AS (SELECT *, segs[{k + 1}] AS seg FROM {tree}),
c{k} AS (SELECT host, template, seg, sum(n) AS n, sum(n_block) AS n_block, sum(labelled) AS labelled FROM h{k} WHERE seg IS NOT NULL GROUP BY 1, 2, 3),
s{k} AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY host, template) > {max_children} AND n < {min_support} THEN '*' ELSE seg END AS token,
         CASE WHEN labelled > 0 THEN round(4 * n_block / labelled)::INT ELSE -1 END AS share FROM c{k}),
p{k} AS (SELECT host, template, share, count(*) AS sisters, min(seg) AS first, sum(n_block) / nullif(sum(labelled), 0) AS pooled
         FROM s{k} WHERE NOT starts_with(token, '*') GROUP BY 1, 2, 3),
j{k} AS (SELECT host, template, seg, CASE WHEN NOT starts_with(token, '*') AND sisters > 1 AND (share < 0 OR abs(n_block / nullif(labelled, 0) - pooled)
         <= {z} * sqrt(greatest(pooled * (1 - pooled), 1e-6) / greatest(labelled, 1))) THEN '{{' || first || '+}}' ELSE token END AS token
         FROM s{k} LEFT JOIN p{k} USING (host, template, share)),
t{k + 1} AS (SELECT h.host, h.segs, h.n, h.n_block, h.labelled, h.template || coalesce('/' || token, '') AS template
         FROM h{k} h LEFT JOIN j{k} j ON h.host = j.host AND h.template = j.template AND h.seg = j.seg)""")
        tree = f"t{k + 1}"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, {rule} AS rule, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{variable}')
      THEN '*' WHEN regexp_matches(x, '^\\d+\\.[A-Za-z0-9]{{1,5}}$') THEN '*.' || split_part(x, '.', -1) ELSE x END) AS shaped FROM b),
v AS (SELECT *, {verdict} AS said, CASE WHEN len(shaped) > {depth} THEN list_append(shaped[:{depth}], '**') ELSE shaped END AS segs FROM r),
t0 AS (SELECT host, segs, count(*) AS n, count(*) FILTER (said = 'block') AS n_block, count(*) FILTER (said IS NOT NULL) AS labelled, '' AS template
       FROM v GROUP BY host, segs),{",".join(steps)},
f AS (SELECT host, segs, template, (sum(n_block) OVER (PARTITION BY host, template) + {weight} * {prior})
      / (sum(labelled) OVER (PARTITION BY host, template) + {weight}) AS purity FROM {tree})
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM v JOIN f ON v.host = f.host AND v.segs = f.segs
"""


def chat_format(probe: str) -> str:
    said = probe.replace("'", "''")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'),
e AS (SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || role END || ':' || chr(10)
      || replace(replace(replace(text, '\\', '\\b'), '### ', '\\h '), '</turn>', '\\t') || '</turn>' || chr(10) AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


# base32 of each five hexadecimal digits: four numbers of five bits
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT *, array_to_string(flatten(list_transform(range(8), lambda k: list_transform([15, 10, 5, 0], lambda s:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[5 * k + 1:5 * k + 5])::BIGINT >> s) & 31) + 1]))), '') AS payload_digest,
      max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to FROM b
"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Rounds one after the other; distances by components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT r, part, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best
         FROM p JOIN c{k} USING (part) GROUP BY r, part, v)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT part, e, list(q ORDER BY i) AS w FROM (SELECT part, e, i, (s - ((s % n) + n) % n) // n AS q FROM (
         SELECT part, best.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM d{k}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY ALL)) GROUP BY part, e),
c{k + 1} AS (SELECT part, e, coalesce(m{k}.w, c{k}.w) AS w FROM c{k} LEFT JOIN m{k} USING (part, e))""")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS vec FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, part, list_slice(vec, part * len(vec) // {parts} + 1, (part + 1) * len(vec) // {parts}) AS v FROM kept, unnest(range({parts})) AS t(part)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, e, v AS w FROM p JOIN f USING (r)),{",".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM d{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), s
"""
