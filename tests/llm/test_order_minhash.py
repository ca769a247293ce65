import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import order_minhash as om


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def longs(*values):
    seed = 42
    for v in values:
        seed = h64((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def brute(text, k=om.KMER, pairs=om.PAIRS):
    if not text:
        return ""
    seen, cells = {}, {}
    for i in range(max(len(text) - k + 1, 1)):
        kmer = signed(h64(text[i:i + k].encode("utf-32-be"))) >> om.PLACE_BITS
        seen[kmer] = seen.get(kmer, -1) + 1
        h = h64(seen[kmer].to_bytes(4, "little"), longs(kmer))
        cell = h >> 64 - pairs.bit_length()
        v = signed(h) >> om.PLACE_BITS
        cells[cell] = min(cells.get(cell, (v, i)), (v, i))
    out = []
    for p in range(pairs):
        held = sorted((cells[c] for c in (2 * p, 2 * p + 1) if c in cells), key=lambda x: x[1])
        out.append(f"{longs(*[v for v, _ in held]) & 0xFFFFFFFF:08x}" if held else om.NO_TUPLE)
    return "".join(out)


def near(a, b):
    if not a or not b:
        return float(a == b)
    both = [(a[i:i + 8], b[i:i + 8]) for i in range(0, len(a), 8)]
    used = [x for x in both if x != (om.NO_TUPLE, om.NO_TUPLE)]
    return sum(x == y for x, y in used) / len(used)


def report(rows):
    keyed = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda r: (-r[0], r[1].encode()))
    out = []
    for n, (i, t) in enumerate(keyed):
        following, m = keyed[(n + 1) % len(keyed)][1], len(t) // 3
        edited = t[:len(t) - m] + following[:m]
        a, b, c = brute(t), brute(edited), brute(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    for t in [t or "" for i, t in rows if i is None]:
        edited = t[:len(t) - len(t) // 3]
        a, b = brute(t), brute(edited)
        out.append((None, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows_per_range", [1, 3, 1000])
def test_odd_rows_equal_brute_force(spark, odd, rows_per_range):
    docs = odd.filter("text is null or length(text) < 100000")
    found = result(om.edited_likeness(docs, rows_per_range=rows_per_range))
    assert found == report([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_small_table_and_none(spark, small, none):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert result(om.edited_likeness(small, rows_per_range=16)) == report(rows)
    assert om.edited_likeness(none).collect() == []
    one = om.edited_likeness(small.limit(1)).first()
    assert one.near_next == 1.0
    prints = {r.doc_id: r.fingerprint for r in om.fingerprint_documents(small).collect()}
    assert prints == {i: brute(t) for i, t in rows}


def test_long_and_repetitive_texts(spark):
    rows = [(1, "ab" * 30_000), (2, "ab" * 29_990 + "x" * 20), (3, "".join(f"word{i % 977} and{i % 31}, more " for i in range(9_000)))]
    found = {r.doc_id: r for r in om.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].fingerprint == brute(t) for i, t in rows)
    assert found[2].near_next > .9 > .3 > found[3].near_next


def test_sees_edits_and_order(spark):
    words = [f"w{(i * 7919) % 1000}" for i in range(600)]
    text, moved = " ".join(words), " ".join(words[300:] + words[:300])
    few = text[:900] + "!!" + text[900:1800] + text[1803:]
    docs = spark.createDataFrame([(1, text), (2, moved), (3, few), (4, " ".join(f"v{(i * 7907) % 1000}" for i in range(600)))], "id long, text string")
    prints = {r.id: r.fingerprint for r in om.fingerprint_documents(docs, key="id").collect()}
    same = docs.sparkSession.createDataFrame([(prints[1], prints[n]) for n in (1, 2, 3, 4)], "a string, b string").select(om.likeness(F.col("a"), F.col("b")).alias("x"))
    own, moved, few, other = [r.x for r in same.collect()]
    # moved halves keep nearly all k-mers, but half of all pairs change their order
    assert own == 1.0 and few > .9 and .25 < moved < .75 and other < .1


def test_no_python_workers(spark, small):
    plan = om.edited_likeness(small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
