"""Order MinHash fingerprints of whole texts, with built-in functions only.

A text is the sequence of its k-mers of code points. The j-th time that a k-mer occurs counts as a k-mer of its own, so a
text is a set of occurrence-numbered k-mers. A hash of (k-mer, j) deals them to ``PAIRS`` pairs of cells and orders each
cell; a cell's minimum is kept with its place. The two minima of a pair in the order in which the text has them are
hashed: texts of small edit distance share k-mers *and* their order, and so most of these hashes.

K-mers are hashed from UTF-32, where a k-mer is found by its index. All hashes of a text are sorted as (hash, place) in its
row, where occurrences of a k-mer lie together in text order. The number of an occurrence is how far back the k-mer still
is the same, found by halving steps. K-mers then go as rows straight into the partial aggregate of the cells, inside one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import prepare, text_of

KMER = 8
PAIRS = 64
PLACE_BITS = 29  # a text of 2 GB in UTF-32 has fewer code points
ROWS_PER_RANGE = 256
MAX_RANGES = 1 << 20
NO_TUPLE = "-" * 8


def sorted_kmers(text: str, k: int) -> Column:
    """(hash, place) of all k-mers as sorted numbers; a text shorter than k is one k-mer."""
    hashed = f"(xxhash64(substring(u, i * 4 + 1, {4 * k})) & {-1 << PLACE_BITS}L) | i"
    each = f"transform(sequence(0, greatest(cast(octet_length(u) div 4 as int) - {k}, 0)), i -> {hashed})"
    # the array of one element names the encoded text, so that it is encoded once
    return F.expr(f"sort_array(transform(array(encode({text}, 'UTF-32')), u -> {each})[0])")


def numbered_kmers(rows: DataFrame, text: str, k: int, longest: int) -> DataFrame:
    """``rows`` once for each k-mer of their text, with the number of its occurrence and its place; ``longest``: a bound of code points."""
    held = rows.withColumn("s", sorted_kmers(text, k)).drop(text)
    # coalesce: exploding a bare column would infer a filter that builds the array twice
    out = held.select("*", F.expr("posexplode(coalesce(s, array(0L))) as (at, x)")).select(
        "*", F.shiftright("x", PLACE_BITS).alias("kmer"),
        F.expr(f"coalesce(shiftright(get(s, at - 1), {PLACE_BITS}) = shiftright(x, {PLACE_BITS}), false)").alias("again"), F.lit(0).alias("number"))
    for b in reversed(range(max(longest, 1).bit_length())):
        same = f"shiftright(get(s, at - number - {1 << b}), {PLACE_BITS}) = kmer"
        out = out.withColumn("number", F.expr(f"case when again and {same} then number + {1 << b} else number end"))
    return out.withColumn("place", F.col("x").bitwiseAND((1 << PLACE_BITS) - 1)).drop("s", "at", "x", "again")


def order_tuples(rows: DataFrame, keys: list[str], text: str, *, k: int, pairs: int, longest: int) -> DataFrame:
    """(keys, pair, token): the hash of the least k-mers of each pair of cells, in text order; pairs without a k-mer have no row."""
    if pairs & (pairs - 1) or not pairs:
        raise ValueError("the number of pairs must be a power of two")
    bits = pairs.bit_length()
    hashed = numbered_kmers(rows, text, k, longest).select(*keys, F.xxhash64("kmer", "number").alias("h"), "place")
    cell = F.shiftrightunsigned("h", 64 - bits)
    least = hashed.select(*keys, F.shiftright(cell, 1).cast("int").alias("pair"), (cell % 2 == 0).alias("even"),
                          F.col("h").bitwiseAND(-1 << PLACE_BITS).bitwiseOR(F.col("place")).alias("v"))
    least = least.groupBy(*keys, "pair").agg(F.min(F.when(F.col("even"), F.col("v"))).alias("a"), F.min(F.when(~F.col("even"), F.col("v"))).alias("b"))
    place, low = [F.col(c).bitwiseAND((1 << PLACE_BITS) - 1) for c in "ab"], [F.shiftright(c, PLACE_BITS) for c in "ab"]
    joined = (F.when(F.col("a").isNull(), F.xxhash64(low[1])).when(F.col("b").isNull(), F.xxhash64(low[0]))
              .when(place[0] < place[1], F.xxhash64(*low)).otherwise(F.xxhash64(low[1], low[0])))
    return least.select(*keys, "pair", F.lower(F.lpad(F.hex(joined.bitwiseAND(0xFFFFFFFF)), 8, "0")).alias("token"))


def _string(tokens: str, first: int, pairs: int) -> Column:
    return F.expr(f"array_join(transform(sequence({first}, {first + pairs - 1}), n -> coalesce(try_element_at({tokens}, n), '{NO_TUPLE}')), '')")


def likeness(a: Column, b: Column, pairs: int = PAIRS) -> Column:
    """The share of pairs with the same hash, of those that one of two fingerprints has; empty texts are like each other only.
    Null if one is null."""
    def tokens(c: Column) -> list[Column]:
        return [F.substring(c, 8 * n + 1, 8) for n in range(pairs)]

    both = list(zip(tokens(a), tokens(b), strict=True))
    same = sum((F.when((x == y) & (x != NO_TUPLE), 1).otherwise(0) for x, y in both), F.lit(0))
    used = sum((F.when((x != NO_TUPLE) | (y != NO_TUPLE), 1).otherwise(0) for x, y in both), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a.isNotNull() & b.isNotNull(), same / used)


def _longest(docs: DataFrame, text: str) -> int:
    return docs.agg(F.max(F.octet_length(text_of(text)))).first()[0] or 1


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = KMER, pairs: int = PAIRS) -> DataFrame:
    """(key, fingerprint) for every distinct (key, text). Null and empty texts have the empty fingerprint, rows without key
    one each for their texts. An empty table gives an empty result; other columns are not read."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text")).withColumn("of_text", F.xxhash64("text")).withColumn("empty", F.col("text") == "")
    tuples = order_tuples(rows, ["id", "of_text", "empty"], "text", k=k, pairs=pairs, longest=_longest(docs, text))
    made = tuples.groupBy("id", "of_text", "empty").agg(F.map_from_entries(F.collect_list(F.struct("pair", "token"))).alias("tokens"))
    return made.select(F.col("id").alias(key), F.when(F.col("empty"), "").otherwise(_string("tokens", 0, pairs)).alias("fingerprint"))


def _neighbours(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """``docs`` (doc_id, text) by ranges of descending ids: (range, last, nth, doc_id, text, next_text).

    A range is followed by a copy of the first row of the next one (the last by that of the first), flagged ``last``, so
    that each row meets its next row inside its range. There are ``MAX_RANGES`` ranges at most, whose first ids are broadcast.
    Rows without id have no next row; they are dealt by their text to ranges of their own.
    """
    spark = docs.sparkSession
    n, low, high = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(n // rows_per_range, MAX_RANGES))
    # doubles round, but keep the order of ids
    at = F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) * F.lit(ranges / (float((high or 0) - (low or 0)) + 1.0)))
    dealt = docs.withColumn("range", F.coalesce(at, -1 - F.pmod(F.xxhash64("text"), F.lit(ranges))))
    down = Window.orderBy(F.col("range").desc())  # a row for each range
    tops = dealt.filter("doc_id is not null").groupBy("range").agg(F.max("doc_id").alias("top"))
    tops = tops.select("top", F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy())).alias("before"))
    copies = dealt.join(F.broadcast(tops), F.col("doc_id") == F.col("top"), "left")
    copies = copies.select("doc_id", "text", F.explode(F.array_compact(F.array(
        F.struct("range", F.lit(False).alias("last")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("last")))))).alias("p"))
    # a given number of partitions, as one task for few bytes would be one for much work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = copies.select("p.*", "doc_id", "text").repartition(parts, "range")
    order = Window.partitionBy("range").orderBy("last", F.col("doc_id").desc(), "text")
    return placed.select("*", F.row_number().over(order).alias("nth"), F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)).alias("next_text"))


def edited_likeness(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = KMER, pairs: int = PAIRS,
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next row's, by
    descending key, then rising text; after the last row comes the first, so a single row is its own next. Rows without key
    are in no order: nothing replaces their last third and ``near_next`` is null. Null texts are empty; empty texts have
    empty fingerprints, are like each other with 1 and like others with 0. A text shorter than ``k`` is one k-mer. Keys
    far apart in a few dense clusters make ranges of uneven size; rows that repeat a key share a range. An empty table gives
    an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = _neighbours(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")), rows_per_range)
    third = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.select("range", "nth", "last", "doc_id", "text", F.char_length("text").alias("n_chars"), edited.alias("edited"))
    keys = ["range", "nth", "last", "doc_id", "n_chars", "digest"]
    texts = rows.select("*", F.unhex(F.sha2("edited", 256)).alias("digest")).select(*keys, F.expr("stack(2, 0, text, 1, edited) as (which, text)"))
    tuples = order_tuples(texts.filter("which = 0 or not last"), [*keys, "which"], "text", k=k, pairs=pairs, longest=_longest(docs, text))
    made = tuples.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("which") * pairs + F.col("pair")).alias("n"), "token"))).alias("tokens"))
    made = made.select("range", "nth", "last", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("digest")).alias("edited_sha256"),
                       *[F.when(F.col("n_chars") == 0, "").otherwise(_string("tokens", w * pairs, pairs)).alias(name)
                         for w, name in enumerate(("fingerprint", "edited_fingerprint"))])
    following = F.when(F.col("doc_id").isNotNull(), F.lead("fingerprint").over(Window.partitionBy("range").orderBy("nth")))
    made = made.withColumn("following", following).filter("not last")
    return made.select(F.col("doc_id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint"), pairs).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("following"), pairs).alias("near_next"))
