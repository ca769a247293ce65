"""Names of several words in texts."""

import re

from codeloom.operators import mentions

TEXTS = ["a b c", "a  b c", "xa b", "a b, c", "a.b c d", "see f(x) and f(x)y", "f", "", "ä ö", "b c a b", "(a b) c-d", None, "c-d-e c-d", "v. a b c d e"]
NAMES = ["a b", "b c", "a b c", "a.b", "f(x)", "f(", "ä ö", "c-d", "c-d-e", "a", "(a b)", "a b c d e", "--"]


def _pairs(spark):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return mentions.mention_pairs(chunks, names, keys=("doc_id",))


def test_names_are_found_as_by_search(spark):
    found = [tuple(r) for r in _pairs(spark).collect()]
    want = {(n, i) for i, t in enumerate(TEXTS) for n in NAMES if t and re.search(r"\w", n) and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", t)}
    assert len(found) == len(set(found)) and set(found) == want


def test_two_words_are_not_found_by_one_of_them(spark):
    """A text with one common word of a name is no candidate of it."""
    chunks = spark.createDataFrame([(i, "common other") for i in range(50)], "doc_id long, text string")
    names = spark.createDataFrame([(f"common w{i}",) for i in range(50)], "name string")
    from codeloom.functions import text as tx

    anchors = names.select(tx.word_pairs(names["name"])[0].alias("a"))
    windows = chunks.select(tx.word_pairs(chunks["text"])[0].alias("a"))
    assert windows.join(anchors, "a").count() == 0 and mentions.mention_pairs(chunks, names, keys=("doc_id",)).count() == 0
