"""The merge of blocks against a plain fold over lists."""

import random

from pyspark.sql import functions as F

from codeloom.operators import blocks

SCHEMA = ("path string, chunk_ord bigint, chunk_id string, block bigint, containing_symbols array<string>, kinds array<string>, "
          "community bigint, embedding array<float>, links array<bigint>")


def folded(rows):
    """(path, chunk_ord) -> unit, chunk by chunk and pair by pair."""
    out = {}
    for path in {r[0] for r in rows}:
        groups = {}
        for r in sorted((r for r in rows if r[0] == path), key=lambda r: r[1]):
            groups.setdefault(r[3], []).append(r)
        units = [groups[b] for b in sorted(groups)]

        def union(unit, at):
            return {x for r in unit for x in (r[at] if isinstance(r[at], list) else [r[at]]) if x is not None}

        def joins(a, b):
            heads = [u[0][2].split("::")[0] for u in (a, b)]
            if heads[0] != heads[1] and all(h in blocks.TOP_LEVEL_KINDS for h in heads):
                return False
            sa, sb = union(a, 4), union(b, 4)
            linked = union(a, 8) & {r[1] for r in b} or union(b, 8) & {r[1] for r in a}
            if len(sa & sb) < blocks.MIN_SHARED and not linked:
                return False
            small = min(len(sa), len(sb))
            if union(a, 6) & union(b, 6) or small and len(sa & sb) / small >= blocks.MERGE_SHARE:
                return True
            if union(a, 5) and union(a, 5) == union(b, 5):
                return True
            va, vb = ([r[7] for r in u if r[7]] for u in (a, b))
            if not va or not vb:
                return False
            mean = lambda v: [sum(x) / len(v) for x in zip(*v)]
            limit = blocks.SAME_PARENT_SIM if heads[0] == heads[1] and heads[0] else blocks.SAME_FILE_SIM
            return sum(x * y for x, y in zip(mean(va), mean(vb))) >= limit

        changed = True
        while changed:
            changed, n, new = False, 0, []
            while n < len(units):
                if n + 1 < len(units) and joins(units[n], units[n + 1]):
                    new.append(units[n] + units[n + 1])
                    changed, n = True, n + 2
                else:
                    new.append(units[n])
                    n += 1
            units = new
        out |= {(path, r[1]): k for k, unit in enumerate(units) for r in unit}
    return out


def rows_of(seed, n):
    rng, rows, block = random.Random(seed), [], 0
    for path in ("a.rs", "b.rs", "one.rs"):
        for k in range(1 if path == "one.rs" else n):
            block += rng.random() < .8
            head = rng.choice(["fn", "fn", "fn", "struct", "text", ""])
            vector = [rng.uniform(-1, 1) for _ in range(3)] if rng.random() < .7 else None
            rows.append((path, 3 * k, f"{head}::x{k}:0-1" if head else f"x{k}", block, rng.sample([f"s{i}" for i in range(9)], rng.randint(0, 5)),
                         rng.choice([["function"], ["struct"], ["function", "struct"], []]), rng.choice([None, None, 1, 2]), vector,
                         [3 * k + d for d in rng.sample([-300, -6, -3, -1, 1, 3, 6], rng.randint(0, 3))]))
    return rows


def test_merge_equals_the_fold_in_tasks_and_in_passes(spark):
    rows = rows_of(4, 120)
    want = folded(rows)
    assert 2 < len({u for (p, _), u in want.items() if p == "a.rs"}) < 80
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for options in ({}, {"task_blocks": 40, "width": 50}):  # in one task a file, and in passes over ranges until files are small
        got = {(r.path, r.chunk_ord): r.unit for r in blocks.merge_blocks(df, **options).collect()}
        assert got == want
    assert blocks.merge_blocks(df.limit(0)).collect() == []


def test_a_file_that_never_shrinks_is_left_as_it_is(spark):
    df = spark.range(60).select(F.lit("a.rs").alias("path"), F.col("id").alias("chunk_ord"), F.concat(F.lit("x"), "id").alias("chunk_id"), F.col("id").alias("block"),
                                F.expr("array('only')").alias("containing_symbols"), F.expr("cast(array() as array<string>)").alias("kinds"),
                                F.lit(None).cast("bigint").alias("community"), F.lit(None).cast("array<float>").alias("embedding"), F.expr("cast(array() as array<bigint>)").alias("links"))
    got = {r.chunk_ord: r.unit for r in blocks.merge_blocks(df, task_blocks=10, width=16).collect()}
    assert got == {n: n for n in range(60)}
