"""The pipeline: each stage against its operator or brute force on the stage's own input."""

import pytest
from pyspark.sql import functions as F
from test_dedup import components, norm

import corpus_pipeline
from codeloom.llm import quality_model, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(folder)
        out.append((docs, spark.read.parquet(folder)))
        docs = out[-1][1]
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    for given, out in stages[:-1]:
        assert out.columns == given.columns and out.dtypes == given.dtypes
    given, out = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_model.score(given, quality_model.train(given, labels)).filter("predicted = 1")
    assert set(texts(out)) == {r.doc_id for r in good.collect()}
    given, out = stages[1]
    assert set(texts(out)) == {r.doc_id for r in quality_rules.quality_verdicts(given).filter("kept").collect()}
    assert out.filter(F.col("n_chars") != F.char_length("text")).isEmpty()
    given, out = stages[2]
    best = {}
    for i, t in texts(given).items():
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t), i))
    assert set(texts(out)) == {i for _, i in best.values()}
    given, out = stages[3]
    assert set(texts(out)) == {i for i, (_, c) in components(list(texts(given).items())).items() if i == c}
    given, out = stages[4]
    sums = {r.doc_id: (r.n, r.total) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert set(sums) == set(texts(given)) and all(n == total for n, total in sums.values())


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, rows.drop("sequence_id", "offset").collect())) == sorted(map(str, stages[4][1].drop("sequence_id", "offset").collect()))
