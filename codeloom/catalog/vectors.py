"""Vectors: arithmetic, aggregates, similarity joins, embeddings of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog.registry import query
from codeloom.functions import vectors as vx
from codeloom.operators import communities, embedding, graph, similarity
from codeloom.session import cut_lineage

# the tables' vectors are nearly orthogonal, hence the low threshold
THRESHOLD = 0.3
EPS, MIN_POINTS = 0.68, 3

_D = "CAST(embedding AS DOUBLE[])"


def _sql_pairs(table: str) -> str:
    return f"""v AS (SELECT vec_id, {_D} AS e FROM {table}),
pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {THRESHOLD})"""


SQL_PAIRS = _sql_pairs("embeddings")


def pairs(t, threshold=THRESHOLD):
    return similarity.similar_pairs(t.embeddings, threshold)


@query("sim_pairs", f"WITH {SQL_PAIRS} SELECT src, dst, round(score, 6) AS score FROM pairs")
def sim_pairs(t):
    """All pairs above a threshold, exact."""
    return pairs(t).withColumn("score", F.round("score", 6))


def _knn_sql(k: int, condition: str, score: str = "") -> str:
    return f"""WITH v AS (SELECT vec_id, {_D} AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON {condition} {score}),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


@query("sim_pairs_copies", f"""WITH twice AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings),
{_sql_pairs('twice')} SELECT src, dst, round(score, 6) AS score FROM pairs""")
def sim_pairs_copies(t):
    """Every vector has an exact copy; pairs of copies and pairs across copies all count, and cells are small."""
    copies = t.embeddings.select((F.col("vec_id") + 1_000_000).alias("vec_id"), "embedding")
    twice = t.embeddings.select("vec_id", "embedding").unionByName(copies)
    return similarity.similar_pairs(twice, THRESHOLD, cell_rows=200).withColumn("score", F.round("score", 6))


@query("knn_cells", _knn_sql(5, "a.vec_id <> b.vec_id"))
def knn_cells(t):
    """Nearest neighbours again, by way of small pivot cells."""
    return similarity.top_k(t.embeddings, t.embeddings, 5, mode="full", cell_rows=100).withColumn("score", F.round("score", 6))


@query("sim_pairs_euclidean", """
SELECT a.vec_id AS src, b.vec_id AS dst, round(-sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= 1.44""")
def sim_pairs_euclidean(t):
    """U4: the same join by another distance."""
    return similarity.similar_pairs(t.embeddings, -1.2, metric="euclidean").withColumn("score", F.round("score", 5))


@query("knn_top5", _knn_sql(5, "a.vec_id <> b.vec_id"))
def knn_top5(t):
    """Five nearest neighbours of every vector, both directions."""
    return similarity.top_k(t.embeddings, t.embeddings, 5, mode="full").withColumn("score", F.round("score", 6))


@query("knn_upper", _knn_sql(5, "a.vec_id < b.vec_id", "WHERE list_dot_product(a.e, b.e) >= 0.3"))
def knn_upper(t):
    """Neighbours above a threshold among later vectors only."""
    out = similarity.top_k(t.embeddings, t.embeddings, 5, mode="upper", min_score=0.3)
    return out.withColumn("score", F.round("score", 6))


_SQL_SYMBOLS = f"""v AS (SELECT vec_id, 's' || label || '-' || (vec_id % 7) AS symbol, {_D} AS e FROM embeddings),
x AS (SELECT symbol, unnest(generate_series(1, len(e))) AS dim, unnest(e) AS val FROM v),
m AS (SELECT symbol, dim, avg(val) AS mean FROM x GROUP BY symbol, dim),
n AS (SELECT symbol, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY symbol),
c AS (SELECT symbol, list(mean / norm ORDER BY dim) AS u FROM m JOIN n USING (symbol) GROUP BY symbol)"""


def _symbol_vectors(t):
    rows = t.embeddings.select(F.concat(F.lit("s"), "label", F.lit("-"), F.col("vec_id") % 7).alias("symbol"), "embedding")
    return embedding.group_centroids(rows, ["symbol"], unit=True)


@query("symbol_top3", f"""WITH {_SQL_SYMBOLS}, s AS (SELECT a.symbol AS src, b.symbol AS dst, round(list_dot_product(a.u, b.u), 9) AS score FROM c a JOIN c b ON a.symbol <> b.symbol),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def symbol_top3(t):
    """Three nearest symbols of every symbol, by the mean of its vectors."""
    s = _symbol_vectors(t)
    return similarity.top_k(s, s, 3, query_id="symbol", base_id="symbol", vector="centroid", mode="full").withColumn(
        "score", F.round("score", 6))


@query("symbol_chunk_top3", f"""WITH {_SQL_SYMBOLS}, s AS (SELECT a.symbol AS src, b.vec_id AS dst, round(list_dot_product(a.u, b.e), 9) AS score FROM c a CROSS JOIN v b),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def symbol_chunk_top3(t):
    """Three nearest chunks of every symbol."""
    out = similarity.top_k(_symbol_vectors(t), t.embeddings, 3, query_id="symbol", query_vector="centroid")
    return out.withColumn("score", F.round("score", 6))


@query("vector_topk", f"""WITH q AS (SELECT {_D} AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity({_D}, q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity({_D}, q) DESC, vec_id LIMIT 10""")
def vector_topk(t):
    """K2: ten nearest to one query vector by full cosine."""
    q = t.embeddings.filter(F.col("vec_id") == 0).select("embedding").first()[0]
    return similarity.nearest_to(t.embeddings, q, 10).withColumn("score", F.round("score", 6))


@query("normalise", f"""WITH v AS (SELECT vec_id, list_transform({_D}, lambda x: x * 3.5) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS unit, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM v""")
def normalise(t):
    """V2: scaled vectors brought back to unit length."""
    scaled = F.transform(vx.as_double(F.col("embedding")), lambda x: x * 3.5)
    rows = t.embeddings.select("vec_id", scaled.alias("e"))
    rows = rows.select("vec_id", vx.l2_normalise(F.col("e")).alias("u"), vx.norm(F.col("e")).alias("norm"))
    return rows.select("vec_id", F.transform("u", lambda x: vx.rounded(x, 6)).alias("unit"), F.round("norm", 6).alias("norm"))


@query("dot_and_cosine", f"""WITH v AS (SELECT vec_id, {_D} AS e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, 0.0::DOUBLE AS other_length FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def dot_and_cosine(t):
    """V3: dot product and full cosine of neighbouring rows; different lengths give 0."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    rows = a.join(b, "vec_id")
    x, y = F.col("a"), F.col("b")
    return rows.select("vec_id", F.round(vx.dot(x, y), 6).alias("dot"), F.round(vx.cosine(x, y), 6).alias("cosine"),
                       vx.dot(x, F.slice(y, 1, 3)).alias("other_length"))


@query("mean_pool", f"""WITH x AS (SELECT label AS id, unnest(generate_series(0, len(e) - 1)) AS dim, unnest(e) AS val FROM (SELECT label, {_D} AS e FROM embeddings WHERE vec_id % 5 <> 0))
SELECT id, dim, round(avg(val), 6) AS value FROM x GROUP BY id, dim""")
def mean_pool(t):
    """V4: mean of token vectors under an attention mask."""
    tokens = t.embeddings.select(F.col("label").alias("id"), F.col("embedding").alias("vector"),
                                 (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))
    out = embedding.mean_pool(tokens, "id").select("id", F.posexplode("centroid").alias("dim", "value"))
    return out.withColumn("value", F.round("value", 6))


@query("clamp_and_pad", """WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x) * 4001) AS ids FROM documents),
m AS (SELECT max(len(ids)) AS size FROM w)
SELECT doc_id, CAST(list_sum(list_transform(ids, lambda i: CASE WHEN i > 30521 THEN 100 ELSE i END)) AS BIGINT) AS total, size AS padded, len(ids) AS real FROM w, m""")
def clamp_and_pad(t):
    """V5: token ids clamped to the vocabulary and padded to the longest text."""
    ids = F.transform(F.split("text", " "), lambda w: (F.length(w) * 4001).cast("bigint"))
    rows = t.documents.select("doc_id", vx.clamp_ids(ids).alias("ids"))
    longest = rows.agg(F.max(F.size("ids")).alias("m")).scalar()
    out = rows.select("doc_id", vx.pad(F.col("ids"), longest).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", total(F.col("p.input_ids")).alias("total"),
                      F.size("p.input_ids").cast("bigint").alias("padded"), total(F.col("p.attention_mask")).alias("real"))


@query("group_centroid", f"""WITH x AS (SELECT label, unnest(generate_series(0, len(e) - 1)) AS dim, unnest(e) AS val FROM (SELECT label, {_D} AS e FROM embeddings))
SELECT label, dim, round(avg(val), 6) AS value FROM x GROUP BY label, dim""")
def group_centroid(t):
    """V6: mean vector per group."""
    out = embedding.group_centroids(t.embeddings, ["label"]).select("label", F.posexplode("centroid").alias("dim", "value"))
    return out.withColumn("value", F.round("value", 6))


@query("cohesion", f"""WITH v AS (SELECT vec_id, label, {_D} AS e FROM embeddings)
SELECT a.label, (SELECT count(*) FROM v c WHERE c.label = a.label) AS n, round(avg(list_dot_product(a.e, b.e)), 6) AS cohesion FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def cohesion(t):
    """Mean pairwise similarity in closed form; the check sums all pairs."""
    return embedding.cohesion(t.embeddings, ["label"]).withColumn("cohesion", F.round("cohesion", 6))


@query("centrality", f"""WITH v AS (SELECT vec_id, label, {_D} AS e FROM embeddings)
SELECT a.label, a.vec_id, round(sum(list_dot_product(a.e, b.e)), 6) AS centrality FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id""")
def centrality(t):
    """Sum of similarities inside the group."""
    return embedding.centrality(t.embeddings, ["label"]).withColumn("centrality", F.round("centrality", 6))


@query("central_top5", f"""WITH v AS (SELECT vec_id, label, {_D} AS e FROM embeddings),
c AS (SELECT a.label, a.vec_id, round(sum(list_dot_product(a.e, b.e)), 9) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM c)
SELECT label, vec_id, rank FROM r WHERE rank <= 5""")
def central_top5(t):
    """Five most central members of each group."""
    out = communities.central_chunks(t.embeddings.select("vec_id", "embedding"), t.embeddings.select("vec_id", "label"),
                                     ["vec_id"], "label")
    return out.select("label", "vec_id", "rank")


# --- embedding of texts -------------------------------------------------------
def sql_embedding(table: str, key: str, text: str, name: str) -> str:
    """CTEs ``{name}`` (key, e): the same signed hashing in SQL."""
    return f"""{name}_t AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '')) AS tok FROM {table}),
{name}_h AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM {name}_t),
{name}_s AS (SELECT {key}, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_h GROUP BY {key}, h % 64),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY {key}),
{name} AS (SELECT {key}, slot, CASE WHEN norm > 1e-12 THEN CAST(CAST(v / norm AS FLOAT) AS DOUBLE) ELSE v END AS x FROM {name}_s JOIN {name}_n USING ({key}))"""


@query("embed_documents", f"WITH {sql_embedding('documents', 'doc_id', 'text', 'e')} SELECT doc_id, slot, round(x, 5) AS value FROM e WHERE x <> 0")
def embed_documents(t):
    """Hashing embedder over whole texts."""
    v = embedding.hashing_embedding(t.documents, "text", ["doc_id"], hash_name="md5")
    out = v.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter(F.col("value") != 0)
    return out.select("doc_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


# --- clusters over the similarity graph --------------------------------------
_LINKS = f"{SQL_PAIRS}, l AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs)"
_COMPONENTS = """walk(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.dst, w.root FROM walk w JOIN l ON l.src = w.node),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node)"""


@query("components", f"WITH RECURSIVE {_LINKS}, {_COMPONENTS} SELECT node, component FROM comp")
def components(t):
    """Connected components of the similarity graph."""
    return graph.connected_components(similarity.similar_forest(t.embeddings, THRESHOLD), t.embeddings.select(F.col("vec_id").alias("node")))


@query("dbscan", f"""WITH RECURSIVE v AS (SELECT vec_id, {_D} AS e FROM embeddings),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.e, b.e) < {EPS}),
core AS (SELECT vec_id AS id FROM embeddings LEFT JOIN (SELECT src, count(*) AS n FROM l GROUP BY src) ON src = vec_id WHERE coalesce(n, 0) + 1 >= {MIN_POINTS}),
cl AS (SELECT src, dst FROM l WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
walk(node, root) AS (SELECT id, id FROM core UNION SELECT cl.dst, w.root FROM walk w JOIN cl ON cl.src = w.node),
c AS (SELECT node, min(root) AS cluster FROM walk GROUP BY node),
b AS (SELECT l.src AS node, arg_min(c.cluster, l.dst) AS cluster FROM l JOIN c ON c.node = l.dst WHERE l.src NOT IN (SELECT id FROM core) GROUP BY l.src)
SELECT vec_id AS id, coalesce(c.cluster, b.cluster) AS cluster FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN b ON b.node = vec_id""")
def dbscan(t):
    """G1: density clusters by cosine distance; exact copies count but never meet pair by pair."""
    reps = cut_lineage(similarity.distinct_vectors(t.embeddings, "vec_id", "embedding"))
    clusters = graph.vector_clusters(reps, EPS, MIN_POINTS)
    members = similarity.copy_members(t.embeddings, reps, "vec_id", "embedding")
    return members.join(clusters, "id").select(F.col("member").alias("id"), "cluster")


@query("modularity", f"""WITH {SQL_PAIRS}, w AS (SELECT src, dst, score FROM pairs UNION ALL SELECT dst, src, score FROM pairs),
k AS (SELECT src AS node, sum(score) AS k FROM w GROUP BY src), m AS (SELECT sum(k) AS m2 FROM k),
i AS (SELECT a.label, sum(score) AS w_in FROM w JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label = b.label GROUP BY a.label),
tot AS (SELECT label, sum(k) AS w_tot FROM k JOIN embeddings ON vec_id = node GROUP BY label)
SELECT round(sum(coalesce(w_in, 0) / m2 - (w_tot / m2) * (w_tot / m2)), 6) AS modularity FROM tot LEFT JOIN i USING (label), m""")
def modularity(t):
    """Modularity of the labels as a partition."""
    q = graph.vector_modularity(t.embeddings, THRESHOLD)
    return q.withColumn("modularity", F.round("modularity", 6))


@query("modularity_copies", f"""WITH twice AS (SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 1000000 * c, embedding, label FROM embeddings, range(1, 3) AS t(c) WHERE vec_id % 3 < c),
{_sql_pairs('twice')}, w AS (SELECT src, dst, score FROM pairs UNION ALL SELECT dst, src, score FROM pairs),
k AS (SELECT src AS node, sum(score) AS k FROM w GROUP BY src), m AS (SELECT sum(k) AS m2 FROM k),
i AS (SELECT a.label, sum(score) AS w_in FROM w JOIN twice a ON a.vec_id = src JOIN twice b ON b.vec_id = dst WHERE a.label = b.label GROUP BY a.label),
tot AS (SELECT label, sum(k) AS w_tot FROM k JOIN twice ON vec_id = node GROUP BY label)
SELECT round(sum(coalesce(w_in, 0) / m2 - (w_tot / m2) * (w_tot / m2)), 6) AS modularity FROM tot LEFT JOIN i USING (label), m""")
def modularity_copies(t):
    """Modularity of the labels over vectors with up to two copies each, by the graph of distinct vectors."""
    extra = [t.embeddings.filter(F.col("vec_id") % 3 < c).withColumn("vec_id", F.col("vec_id") + 1_000_000 * c) for c in (1, 2)]
    rows = t.embeddings.unionByName(extra[0]).unionByName(extra[1])
    classes = similarity.distinct_vectors(rows, "vec_id", "embedding")
    # equal vectors have equal labels: the smallest copy speaks for its class
    classes = cut_lineage(classes.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id"))
    return graph.vector_modularity(classes, THRESHOLD, "id", copies="copies").withColumn("modularity", F.round("modularity", 6))


@query("modularity_adjacent", f"""WITH {SQL_PAIRS}, w AS (SELECT src, dst, score FROM pairs UNION ALL SELECT dst, src, score FROM pairs),
k AS (SELECT src AS node, sum(score) AS k FROM w GROUP BY src), m AS (SELECT sum(k) AS m2 FROM k)
SELECT round(sum(score - ka.k * kb.k / m2) / any_value(m2), 6) AS modularity FROM w JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst JOIN k ka ON ka.node = src JOIN k kb ON kb.node = dst, m WHERE a.label = b.label""")
def modularity_adjacent(t):
    """The form that sums the null model over adjacent pairs alone."""
    q = graph.vector_modularity(t.embeddings, THRESHOLD, adjacent_only=True)
    return q.withColumn("modularity", F.round("modularity", 6))


@query("louvain")
def louvain(t):
    """Communities of the similarity graph; checked by modularity and cliques in the tests."""
    return graph.louvain(pairs(t).withColumnRenamed("score", "weight"))


@query("majority_cluster", """WITH c AS (SELECT source AS symbol, quality AS cluster, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY source, quality)
SELECT symbol, arg_min(cluster, (-n) * 10 + cluster) AS cluster, round(max(n) / sum(n), 6) AS confidence FROM c GROUP BY symbol""")
def majority_cluster(t):
    """Majority vote per source; toxic documents play the noise."""
    cluster = F.when(F.col("toxic") == 0, F.col("quality"))
    rows = t.documents.select("doc_id", F.col("source").alias("symbol")).join(t.labels, "doc_id")
    out = communities.majority_cluster(rows.select("symbol", cluster.alias("cluster")))
    return out.withColumn("confidence", F.round("confidence", 6))
