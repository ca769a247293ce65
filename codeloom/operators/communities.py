"""Communities: assembly, labels, roles, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions import text as tx
from codeloom.operators import embedding
from codeloom.session import cut_lineage

LABEL_CANDIDATES, LABEL_WORDS, CENTRAL_CHUNKS = 10, 3, 5


def majority_cluster(assigned: DataFrame, key: str = "symbol", cluster: str = "cluster") -> DataFrame:
    """Most frequent cluster per key with its share; noise (NULL) ignored, ties to the smallest id."""
    counted = assigned.filter(F.col(cluster).isNotNull()).groupBy(key, cluster).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.sum("n").alias("total"),
                                    F.min(F.struct((-F.col("n")).alias("neg"), F.col(cluster).alias("c"))).alias("b"))
    return best.select(key, F.col("b.c").alias("cluster"), (-F.col("b.neg") / F.col("total")).alias("confidence"))


def members(membership: DataFrame, containing: DataFrame) -> DataFrame:
    """Distinct (community, symbol, file): communities of chunks (path, chunk_ord) with the symbols inside."""
    placed = containing.select("path", "chunk_ord", F.explode_outer("containing_symbols").alias("symbol"))
    return (membership.join(placed, ["path", "chunk_ord"], "left")
            .select("community", "symbol", F.col("path").alias("file")).distinct())


def assemble(member_rows: DataFrame) -> DataFrame:
    """Per community the number of distinct symbols and files, largest first.

    The lists stay rows in ``members``; each distinct count is taken over
    distinct rows.
    """
    symbols = (member_rows.filter(F.col("symbol").isNotNull()).select("community", "symbol").distinct()
               .groupBy("community").agg(F.count("*").alias("n_symbols")))
    files = (member_rows.select("community", "file").distinct().groupBy("community").agg(F.count("*").alias("n_files")))
    return files.join(symbols, "community", "left").select(
        "community", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), "n_files")


def extraction_suggestions(communities: DataFrame, n: int = 5) -> DataFrame:
    """Communities over several files with at least three symbols: candidates for a module."""
    return (communities.filter((F.col("n_files") > 1) & (F.col("n_symbols") >= 3))
            .orderBy(F.desc("n_symbols"), "community").limit(n))


# --- labels -------------------------------------------------------------------
def comment_texts(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Comment text per chunk: ``//`` and ``#`` lines and block comments.

    A block opens on a line starting with ``/*`` and closes on a later line
    ending with ``*/``. Lines of one chunk stay in one window partition.
    """
    rows = chunks.select(*keys, F.posexplode(tx.lines(F.col(text))).alias("line_no", "raw"))
    rows = rows.withColumn("line", tx.ltrim(F.col("raw")))
    line = F.col("line")
    plain = line.startswith("//") | line.startswith("#")
    opener = ~plain & line.startswith("/*")
    closer = ~plain & ~opener & F.rtrim(line).endswith("*/")
    event = F.when(opener, True).when(closer, False)
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))
    said = (F.when(plain, tx.trim(F.regexp_replace(F.regexp_replace(line, "^/+", ""), "^#+", "")))
            .when(opener, tx.trim(F.regexp_replace(line, r"^(/\*)+", "")))
            .when(F.col("open") & closer, tx.trim(F.regexp_replace(F.rtrim(line), r"(\*/)+$", "")))
            .when(F.col("open"), line))
    kept = rows.withColumn("said", said).filter(F.col("said").isNotNull())
    return kept.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda s: s["said"]), " ").alias("comments"))


def candidate_phrases(chunks: DataFrame, keys: list[str], comments: DataFrame, chunk_id: str = "chunk_id",
                      symbols: str = "containing_symbols", noun_phrases: bool = True) -> DataFrame:
    """Phrases per chunk with repetition: (keys, phrases).

    Noun phrases and words of comments, words of the chunk id and of the symbols
    inside, then bigrams over that sequence.
    """
    text = F.coalesce("comments", F.lit(""))
    listed = F.coalesce(F.col(symbols), F.array().cast("array<string>"))
    nouns = F.filter(F.transform(tx.noun_phrases(text), F.lower), lambda p: F.length(p) >= 3) if noun_phrases else (
        F.array().cast("array<string>"))
    sequence = F.concat(nouns, tx.label_tokens(text), tx.label_tokens(F.col(chunk_id)),
                        F.flatten(F.transform(listed, tx.label_tokens)))
    rows = chunks.join(comments, keys, "left").select(*keys, sequence.alias("__seq"))
    return rows.select(*keys, F.concat("__seq", tx.bigrams(F.col("__seq"))).alias("phrases"))


def phrase_scores(phrases: DataFrame, central: DataFrame, keys: list[str], group: str = "community") -> DataFrame:
    """TF-IDF of phrases per group: tf over its central chunks, idf over the corpus.

    Document frequency counts a phrase once per chunk without a distinct
    shuffle, since repetition is removed inside the row. Texts are taken apart
    once: the three counts read the written phrases.
    """
    phrases = cut_lineage(phrases)
    df = (phrases.select(F.explode(F.array_distinct("phrases")).alias("phrase")).groupBy("phrase")
          .agg(F.count("*").alias("df")))
    n = phrases.agg(F.count("*").alias("n")).scalar()
    tf = (central.select(group, *keys).join(phrases, keys).select(group, F.explode("phrases").alias("phrase"))
          .groupBy(group, "phrase").agg(F.count("*").alias("tf")))
    idf = F.ln(1 + n / (1 + F.col("df")))
    return tf.join(df, "phrase").select(group, "phrase", "tf", "df", (F.col("tf") * idf).alias("score"))


def central_chunks(vectors: DataFrame, membership: DataFrame, keys: list[str], group: str = "community",
                   n: int = CENTRAL_CHUNKS) -> DataFrame:
    """The n most central chunks of each group."""
    tagged = vectors.join(membership, keys).withColumn("__id", F.struct(*keys))
    scored = embedding.centrality(tagged, [group], "__id")
    best = Window.partitionBy(group).orderBy(F.desc(F.round("centrality", 9)), "__id")
    return (scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
            .select(group, "__id.*", "centrality", "rank"))


def pick_labels(scores: DataFrame, group: str = "community") -> DataFrame:
    """Up to three phrases of the ten best that share no word, title-cased and joined by `` + ``."""
    best = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "phrase")
    top = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= LABEL_CANDIDATES)
    listed = top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))),
                                                lambda s: s["phrase"]).alias("top"))
    none = F.array().cast("array<string>")

    def take(acc, phrase):
        parts = F.split(phrase, " +")
        fits = ((F.size(acc["picks"]) < LABEL_WORDS) & (F.octet_length(phrase) >= 3) & tx.mostly_letters(phrase)
                & ~F.arrays_overlap(acc["seen"], parts))
        return F.struct(
            F.when(fits, F.concat(acc["picks"], F.array(tx.title_words(phrase)))).otherwise(acc["picks"]).alias("picks"),
            F.when(fits, F.concat(acc["seen"], parts)).otherwise(acc["seen"]).alias("seen"))

    picked = F.aggregate("top", F.struct(none.alias("picks"), none.alias("seen")), take)
    return listed.select(group, F.nullif(F.array_join(picked["picks"], " + "), F.lit("")).alias("label"))


def fallback_labels(names: DataFrame, group: str = "community", name: str = "symbol") -> DataFrame:
    """Common name prefix, else the most frequent token seen at least twice (ties alphabetical)."""
    ends = names.groupBy(group).agg(F.min(name).alias("low"), F.max(name).alias("high"))
    tokens = names.select(group, F.explode(F.transform(tx.identifier_tokens(F.col(name)), F.lower)).alias("token"))
    counted = (tokens.filter(F.length("token") >= 3).groupBy(group, "token").agg(F.count("*").alias("n"))
               .filter(F.col("n") >= 2))
    common = counted.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("neg"), "token")).alias("b"))
    return ends.join(common, group, "left").select(
        group, F.coalesce(tx.prefix_label(F.col("low"), F.col("high")), F.col("b.token")).alias("label"))


def describe(communities: DataFrame, member_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add name, role and summary; communities (community, n_symbols, n_files, cohesion)."""
    rule = (member_rows.filter(F.col("symbol").isNotNull()).select("community", "symbol").distinct()
            .groupBy("community").agg(F.min(tx.member_rule_number(F.col("symbol"))).alias("rule")))
    rows = communities.join(labels, "community", "left").join(rule, "community", "left")
    role = tx.role_of(F.col("label"), F.col("rule"))
    return rows.select("community", F.coalesce("label", F.concat(F.lit("subsystem_"), "community")).alias("name"),
                       "n_symbols", "n_files", F.col("cohesion").alias("confidence"), role.alias("role"),
                       tx.community_summary(F.col("label"), F.col("n_symbols"), role).alias("summary"))


# --- lookups ------------------------------------------------------------------
def list_communities(described: DataFrame, name: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    rows = described.filter(F.col("confidence") >= min_confidence)
    rows = rows if name is None else rows.filter(F.col("name").contains(name))
    return rows.orderBy(F.desc("confidence"), "community")


def community_detail(described: DataFrame, member_rows: DataFrame, symbol_table: DataFrame, name: str) -> DataFrame:
    """Members of one community with kind, file and summary; unknown members are dropped."""
    one = described.filter(F.col("name") == name).select("community", "name")
    symbols = member_rows.join(one, "community").select(F.col("symbol").alias("symbol")).distinct()
    table = symbol_table.select(F.col("name").alias("symbol"), "kind", "file", "summary")
    return symbols.join(table, "symbol")


def communities_of_file(described: DataFrame, member_rows: DataFrame, path: str) -> DataFrame:
    hit = member_rows.filter(F.col("file") == path).select("community").distinct()
    return described.join(hit, "community", "left_semi")


def community_of_symbols(described: DataFrame, member_rows: DataFrame, most_confident: bool = True) -> DataFrame:
    """(symbol, subsystem): one community per name, the most confident unless told otherwise."""
    rows = (member_rows.filter(F.col("symbol").isNotNull()).select("community", "symbol").distinct()
            .join(described.select("community", "name", "confidence"), "community"))
    rank = F.struct((-F.col("confidence") if most_confident else F.col("confidence")).alias("c"), "community", "name")
    return rows.groupBy("symbol").agg(F.min(rank).alias("b")).select("symbol", F.col("b.name").alias("subsystem"))


def role_map(described: DataFrame, intents=None) -> DataFrame:
    """(intent, subsystem): the least confident matching community wins, as later entries overwrite."""
    rows = []
    role = F.lower("role")
    for intent, terms in intents or rules.ROLE_INTENTS:
        test = F.lit(False)
        for term in terms:
            test = test | role.contains(term)
        rows.append(F.when(test, F.lit(intent)))
    found = described.select("name", "community", "confidence", F.explode(F.array(*rows)).alias("intent")).filter(
        F.col("intent").isNotNull())
    return found.groupBy("intent").agg(F.min(F.struct("confidence", "community", "name")).alias("b")).select(
        "intent", F.col("b.name").alias("subsystem"))
