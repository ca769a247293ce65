import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import DOCUMENTS, ODD  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Documents of odd texts: nulls in any column, repeated rows, ties, a row without key, columns of clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, "same text here"), (101, "same  text\nhere"), (102, "sametexthere"), (102, "sametexthere"),
                                                 (None, "no key at all"), (None, None), (7, ODD[7])]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    names = ["key", "digest", "norm", "rank", "salt", "keep_id", "rep", "label", "node", "ids", "shard", "slot", "row", "copy", "kept", "score", "block"]
    folder = str(tmp_path_factory.mktemp("odd") / "documents")
    frame.selectExpr("*", *[f"'clash' AS {n}" for n in names]).coalesce(2).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
