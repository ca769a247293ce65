"""Best rows for a table of questions by one scan of the vectors.

Questions of a measured, bounded size go to every task. A task keeps the k best
rows of each question while it reads, so the corpus' vectors are never shuffled
and a task sends at most questions x k candidates. More questions than the bound
go through the cells of ``similarity.top_k``, which gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import similarity
from codeloom.operators.similarity import SCORE_DIGITS, _matrix
from codeloom.session import cut_lineage

MAX_QUESTION_BYTES = 16 << 20  # vectors and ids sent to a task
MAX_TASK_CANDIDATES = 100_000  # questions x k, the rows a task may send on
BLOCK_SCORES = 1 << 20  # scores held at once


def best_rows(questions: DataFrame, base: DataFrame, k: int, question_id: str, base_id: str, vector: str = "embedding",
              max_bytes: int = MAX_QUESTION_BYTES, max_candidates: int = MAX_TASK_CANDIDATES) -> DataFrame:
    """k best rows of ``base`` for every question by dot product: (src, dst, score, rank).

    Ties go to the smaller id. Rows and questions without a vector have no hits;
    all vectors are of one length.
    """
    asked = cut_lineage(similarity._plain(questions, question_id, vector).filter("vec IS NOT NULL"))
    rows = similarity._plain(base, base_id, vector).filter("vec IS NOT NULL")
    if not _fits(asked, k, max_bytes, max_candidates):
        return similarity.top_k(asked, rows, k, "id", "id", "vec")
    return similarity._rank(_scan(asked, rows, k), k)


def _fits(asked: DataFrame, k: int, max_bytes: int, max_candidates: int) -> bool:
    size = F.size("vec") * 8 + F.octet_length(F.col("id").cast("string"))
    n, total = asked.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n * k <= max_candidates and total <= max_bytes


def _scan(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    table = asked.toArrow()
    ids, matrix = table["id"].combine_chunks(), _matrix(table["vec"])
    n = len(ids)
    step = max(1, BLOCK_SCORES // max(1, n))
    waiting_limit = BLOCK_SCORES // 16 + 4 * n * k

    def best(found: list[pa.Table]) -> pa.Table:
        """The k best of each question, in order of (question, score, id)."""
        found = pa.concat_tables(found).sort_by([("q", "ascending"), ("score", "descending"), ("dst", "ascending")])
        q = found["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return found.append_column("place", pa.array(place)).filter(pa.array(place < k))

    def scan(batches):
        floor = np.full(n, -np.inf)  # k-th best score so far
        found, waiting = [], 0
        for batch in batches if n else ():
            x = _matrix(batch.column("vec"))
            for at in range(0, len(x), step):
                scores = np.round(matrix @ x[at:at + step].T, SCORE_DIGITS)
                q, row = np.nonzero(scores >= floor[:, None])
                found.append(pa.table({"q": q, "dst": batch.column("id").take(pa.array(row + at)), "score": scores[q, row]}))
                waiting += len(q)
                if waiting > waiting_limit:
                    kept = best(found)
                    last = kept["place"].to_numpy() == k - 1
                    floor[kept["q"].to_numpy()[last]] = kept["score"].to_numpy()[last]
                    found, waiting = [kept.drop_columns("place")], len(kept)
        if found:
            kept = best(found)
            yield from pa.table({"src": ids.take(kept["q"]), "dst": kept["dst"], "score": kept["score"]}).to_batches()

    types = [df.schema["id"].dataType.simpleString() for df in (asked, rows)]
    return rows.mapInArrow(scan, f"src {types[0]}, dst {types[1]}, score double")
