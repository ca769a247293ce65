"""Encoding, decoding and packing against the tokenizers library."""

import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    return Tokenizer.from_file(vocabulary)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block_bytes", [1, 1 << 24])
def test_encode_and_decode(odd, small, vocabulary, tokenizer, block_bytes):
    for docs in (odd, small) if block_bytes > 1 else (odd,):
        got = tokens.decode_documents(tokens.encode_documents(docs, vocabulary, block_bytes=block_bytes), vocabulary).collect()
        want = sorted((repr(r.doc_id), struct.pack(f"<{len(i)}I", *i), tokenizer.decode(i, skip_special_tokens=False))
                      for r in docs.collect() for i in [ids_of(tokenizer, r.text)])
        assert sorted((repr(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want


def test_every_place_of_a_word_gets_its_ids(spark, vocabulary):
    places = spark.createDataFrame([(w, (b << 24) + n) for n, w in enumerate(["a", "b", "c"]) for b in range(900)], "word string, place long")
    rows = tokens.encode_distinct(places, vocabulary, held_rows=100).collect()
    assert sum(len(tokens._from_planes(tokens.zstandard.ZstdDecompressor().decompress(r.numbers))) for r in rows) == 2700


def test_many_partitions(spark, vocabulary, tokenizer):
    docs = spark.range(0, 140, 1, 140).selectExpr("id AS doc_id", "concat('word ', id, ' of many.') AS text")
    got = {r.doc_id: bytes(r.ids) for r in tokens.encode_documents(docs, vocabulary).collect()}
    assert got == {k: struct.pack(f"<{len(i)}I", *i) for k in range(140) for i in [ids_of(tokenizer, f"word {k} of many.")]}


def test_limits_of_places():
    import numpy as np

    last = tokens.block_id((1 << tokens.PARTITION_BITS) - 1, (1 << tokens.BLOCK_BITS) - 1)
    most = 1 << tokens.NUMBER_BITS
    place = tokens.first_place(last, most) + np.array([0, most - 1], np.int64)
    assert (place > 0).all() and (place >> tokens.NUMBER_BITS == last).all() and most > 1 << 24
    assert tokens.first_place(tokens.block_id(128, 1), most) + most == tokens.first_place(tokens.block_id(128, 2), most)
    for call in (lambda: tokens.first_place(1, most + 1), lambda: tokens.block_id(1 << tokens.PARTITION_BITS, 0), lambda: tokens.block_id(0, 1 << tokens.BLOCK_BITS)):
        with pytest.raises(ValueError):
            call()


def test_a_changed_input_is_noticed(spark, vocabulary):
    import pyarrow as pa

    texts = pa.table({"block": [1], "keys": [[1]], "counts": [[1]], "ranks": [b""], "by_rank": [b""], "n_distinct": pa.array([1], pa.int32())})
    words = pa.table({"numbers": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    with pytest.raises(RuntimeError):
        tokens._assemble(texts, words)


def test_empty_tables(none, vocabulary):
    assert tokens.decode_documents(tokens.encode_documents(none, vocabulary), vocabulary).count() == 0
    assert packing.pack_documents(none, vocabulary).count() == 0


def test_cache_stays_bounded(vocabulary, tokenizer):
    import pyarrow as pa

    from codeloom.llm.common import byte_view

    cache = tokens.WordCache(vocabulary, limit=20)
    for k in range(6):
        texts = [f"hello{k} wor{k}ld some{k}thing", None, " ".join(f"t{k}x{i}" for i in range(15))]
        ids, counts = cache.encode(*byte_view(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in ids_of(tokenizer, t)]
        assert len(cache.known) <= 20 + 33


@pytest.mark.parametrize("window, n_open, parts", [(64, 4, 40), (4096, 64, 2)])
def test_packing(odd, small, vocabulary, tokenizer, window, n_open, parts):
    docs = small.select("doc_id", "text").union(odd.filter("doc_id is not null").selectExpr("doc_id + 1000", "text")).dropDuplicates(["doc_id"])
    docs = docs.repartition(parts, "doc_id")
    rows = packing.pack_documents(docs, vocabulary, window=window, n_open=n_open, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total, padding = total + at, padding + window - at
    assert padding <= 0.05 * total
    for r in docs.collect():
        want, at = [*ids_of(tokenizer, r.text), 2], 0
        for p in sorted(pieces.pop(r.doc_id), key=lambda p: p.start):
            data = struct.pack(f"<{p.length}I", *want[at:at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(want), zlib.crc32(data), data)
            at += p.length
        assert at == len(want)
    assert not pieces


def test_packing_of_odd_rows(odd, vocabulary):
    rows = packing.pack_documents(odd, vocabulary).collect()
    assert sum(r.length == r.doc_tokens == 1 for r in rows) == 4  # null, empty, white space, and null without key
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
