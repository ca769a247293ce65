import hashlib

import numpy as np
import pytest

from codeloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, part string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", "clash", "clash", "clash") for i, v, k in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """Python integers and plain loops."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in np.array(v, np.float32)], k) for i, v, k in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max([len(v) for _, v, _ in kept] + [1]) // parts)
    cut = [[(v + [0] * (size * parts))[j * size:(j + 1) * size] for j in range(parts)] for _, v, _ in kept]
    first = {}
    for (i, *_), c in zip(kept, cut):
        if i is not None and (i not in first or c < first[i]):
            first[i] = c
    books = [[first[i][j] for i in sorted(first)[:entries]] for j in range(parts)]

    def best(j, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[j]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for j in range(parts):
            held = {}
            for c in cut:
                held.setdefault(best(j, c[j])[1], []).append(c[j])
            for n, xs in held.items():
                new[j][n] = [sum(col) // len(xs) for col in zip(*xs)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(j, c[j]) for j in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, k), e in zip(kept, errors):
        labels[k] = labels.get(k, 0) + e
    return sorted(((i, "".join(f"{n:02x}" for _, n in f), e, labels[k], sha) for (i, _, k), f, e in zip(kept, found, errors)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("m", [1, 2, 4, 8, 16])
def test_transform_has_rising_sign_changes_and_keeps_distances(m):
    rows = vc.walsh(np.eye(m, dtype=np.int64)).T  # row s: the weights of coefficient s
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(m))
    assert (rows @ rows.T == m * np.eye(m)).all()


@pytest.mark.parametrize("part", [1, 3, 4, 5])
def test_nearest_is_exact_with_ties(part):
    rng = np.random.default_rng(part)
    x, entries = rng.integers(-4, 5, (400, part)), rng.integers(-4, 5, (30, part))
    entries[20:] = entries[:10]
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    index, distance = vc.nearest(x, entries)
    assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, .2, 32).tolist(), int(i) % 5 if i % 7 else None) for i in rng.permutation(150)]
    rows += rows[:5] + [(3, rows[9][1], 1), (None, rows[8][1], None), (500, None, 1), (501, [], 2), (502, [0.5] * 7, 2), (503, [float("nan")] * 32, 2),
                        (504, [float("inf")] + [0.0] * 31, 2), (505, [None] + [0.0] * 31, None), (-9, [0.25] * 32, 3), (-8, [0.25] * 32, 3),
                        (506, [1e6] * 32, 4), (507, [-3e8, 2.0] * 16, 4)]
    assert result(vc.compress(frame(spark, rows))) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(2, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.5, 3.0], 1), (None, [0.0], None)]
    assert result(vc.compress(frame(spark, rows))) == brute(rows)
    assert vc.compress(frame(spark, [])).collect() == []
    no_key = vc.compress(frame(spark, [(None, [1.0] * 16, None)])).collect()
    assert [(r.code, r.error) for r in no_key] == [("00" * 16, 16 * 256 * 256)]
    huge = vc.compress(frame(spark, [(1, [0.0] * 16, 1), (2, [3e38] * 16, 1), (3, [1e30] * 16, 1)]), entries=1).collect()
    assert max(r.error for r in huge) == (1 << 63) - 1 == max(r.label_error for r in huge)
