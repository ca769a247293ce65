import hashlib

import numpy as np
import pytest

from codeloom.llm import alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(paths, rows):
    """Sets of end offsets and dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in printable)}
    found, uses = [], {}
    for key, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(byte_of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        ends = []
        for side in (a, b):
            at, e = 0, []
            for _, x in side:
                at += len(x)
                e.append(at)
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        at_a, at_b = {e: i for (i, _), e in zip(a, ends[0])}, {e: i for (i, _), e in zip(b, ends[1])}
        links = [(at_b[e], at_a[e]) for e in common]
        for p in links:
            uses[p] = uses.get(p, 0) + 1
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for (i, _), x in zip(side, es) if low < x <= e) for side, es in zip((a, b), ends)))
            low = e
        shown = ";".join(groups)
        found.append((key, len(a), len(b), len(common), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    most = {}
    for (b, _), n in uses.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(((k, na, nb, g, len(ls), sum(uses[p] == most[p[0]] for p in ls), sum(uses[p] for p in ls), sha) for k, na, nb, g, ls, sha in found), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_texts_equal_brute_force(spark, odd, paths):
    more = spark.createDataFrame([(200, "a▁b"), (201, "nul \x00 here"), (202, "<s> </s> <0x41> <unk>"), (203, " lead  and trail  "), (204, "﻿​́")],
                                 "doc_id long, text string")
    docs = odd.select("doc_id", "text", "node", "row", "block").unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 100_000]
    docs = docs.filter("text is null or length(text) < 100000")
    # tiny buffers and parts: many runs, many tasks for a part
    assert result(alignment.align_documents(docs, *paths, run_links=300, part_bytes=2000)) == brute(paths, rows)
    assert result(alignment.align_documents(docs, *paths)) == brute(paths, rows)


def test_whole_small_table_and_none(spark, small, none, paths):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert result(alignment.align_documents(small, *paths, run_links=20_000)) == brute(paths, rows)
    assert alignment.align_documents(none, *paths).collect() == []


def test_many_small_runs_are_many_shares(spark, small, paths):
    """A run of few bytes still has an unpacked frame: a task merges a bounded number of runs, whatever their bytes."""
    runs = spark.range(3000).selectExpr("cast(id % 2 as int) as part", "id as run", "10L as size", "array(cast('x' as binary)) as frames")
    shares, share = alignment.share_of(runs)
    placed = runs.select("part", "run", share.alias("share"), shares.alias("n")).groupBy("part", "share").agg({"run": "count", "n": "max"}).collect()
    assert max(r["count(run)"] for r in placed) < 2 * alignment.MERGED_RUNS
    assert sum(r["count(run)"] for r in placed) == 3000 and all(r["share"] < r["max(n)"] for r in placed)
    # runs of many frames are bounded by these
    long = runs.limit(64).selectExpr("0 as part", "run", "size", "array_repeat(cast('x' as binary), 128) as frames")
    assert long.select(alignment.share_of(long)[0].alias("n")).first()["n"] == 8
    rows = [(r.doc_id, r.text) for r in small.limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(alignment.align_documents(docs, *paths, run_links=2000, merged_runs=2)) == brute(paths, rows)


def test_long_text_is_whole(spark, odd, paths):
    long = odd.filter("length(text) > 100000")
    got, = alignment.align_documents(long, *paths).collect()
    assert got.n_a > 400_000 and got.n_links == got.n_groups > 0 and got.count_sum >= got.n_links


@pytest.mark.parametrize("frame", [1, 3, 1 << 13])
def test_merge_counts_runs_of_a_hot_pair(monkeypatch, frame):
    rng = np.random.default_rng(frame)
    monkeypatch.setattr(alignment, "FRAME_RECORDS", frame)
    pair = np.where(rng.random(3000) < .4, 5 << 32 | 7, rng.integers(0, 40, 3000) << 32 | rng.integers(0, 9, 3000))
    row = rng.integers(0, 50, 3000)
    runs = {}
    for low in range(0, 3000, 700):
        for part, frames in alignment.spill(pair[low:low + 700], row[low:low + 700], 4):
            runs.setdefault(part, []).append(frames)
    wanted = dict(zip(*np.unique(pair, return_counts=True)))
    sums = np.zeros((50, 2), np.int64)
    for part, held in runs.items():
        found = [np.concatenate(c) for c in zip(*alignment.count_runs(held))]
        assert (np.diff(found[0]) > 0).all() and all(p >> 32 & 3 == part and wanted.pop(p) == n for p, n in zip(*found))
        for r, best, count in alignment.pay_back(held, *found, limit=64):
            np.add.at(sums, r, np.stack([best, count], axis=1))
    assert not wanted
    uses = dict(zip(*np.unique(pair, return_counts=True)))
    most = {}
    for p, n in uses.items():
        most[p >> 32] = max(n, most.get(p >> 32, 0))
    again = np.zeros((50, 2), np.int64)
    for p, r in zip(pair, row):
        again[r] += [uses[p] == most[p >> 32], uses[p]]
    assert (sums == again).all()
