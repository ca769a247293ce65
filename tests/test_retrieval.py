"""Best rows of questions: by one scan and by cells, against brute force."""

import numpy as np
import pytest

from codeloom.operators import retrieval

SCHEMA = "id {}, embedding array<float>"


def brute(questions, base, k):
    out = set()
    for q, v in questions:
        if v is None:
            continue
        scored = sorted((-round(float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), 9), b)
                        for b, w in base if w is not None)
        out |= {(q, b, -s, place + 1) for place, (s, b) in enumerate(scored[:k])}
    return out


def rows_of(df):
    return {(r.src, r.dst, r.score, r.rank) for r in df.collect()}


@pytest.fixture
def tables():
    rng = np.random.default_rng(5)
    base = [(f"b{i:04d}", rng.normal(size=8).round(1).tolist()) for i in range(600)]
    base += [(f"c{i:04d}", base[0][1]) for i in range(300)] + [("none", None)]  # many equal vectors, one without
    questions = [(i, rng.normal(size=8).round(1).tolist()) for i in range(7)] + [(7, base[0][1]), (8, None)]
    return questions, base


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_scan_is_brute_force(spark, tables, k, monkeypatch):
    questions, base = tables
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", 256)  # candidates are cut down many times
    got = retrieval.best_rows(spark.createDataFrame(questions, SCHEMA.format("long")),
                              spark.createDataFrame(base, SCHEMA.format("string")).repartition(3), k, "id", "id")
    assert rows_of(got) == brute(questions, base, k)


def test_more_questions_than_the_bound_give_the_same_rows(spark, tables):
    questions, base = tables
    q, b = spark.createDataFrame(questions, SCHEMA.format("long")), spark.createDataFrame(base, SCHEMA.format("string"))
    for bound in ({"max_bytes": 100}, {"max_candidates": 10}):
        assert rows_of(retrieval.best_rows(q, b, 5, "id", "id", **bound)) == brute(questions, base, 5)


def test_vectors_are_not_shuffled(spark, tables):
    questions, base = tables
    got = retrieval.best_rows(spark.createDataFrame(questions, SCHEMA.format("long")),
                              spark.createDataFrame(base, SCHEMA.format("string")), 5, "id", "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(src" in plan


def test_empty_tables(spark, tables):
    questions, base = (spark.createDataFrame(rows, SCHEMA.format(kind)) for rows, kind in zip(tables, ("long", "string")))
    assert retrieval.best_rows(questions.limit(0), base, 3, "id", "id").count() == 0
    assert retrieval.best_rows(questions, base.limit(0), 3, "id", "id").count() == 0
