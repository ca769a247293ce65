"""BPE encoding and decoding by a table of distinct words.

The tokenizer's pre-tokenizer never joins two words that white space parts, so the ids of a text are those of its words in
order. Words are split block by block (about ``BLOCK_BYTES`` of text); a block's distinct words are shuffled by word, each
distinct word of the corpus is encoded once, and its ids go back to the places (block, number in the block) that hold it.
A text's words are kept as numbers into its block's words, so that the join by position is an array lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import byte_view, flat, groups_of, prepare, ranges
from codeloom.llm.words import IS_SPACE, Words, mix, runs_of

BLOCK_BYTES = 10 << 20

# the pre-tokenizer's pattern, with spaces kept as marks between words
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
# words for which Unicode tables of any age agree: printable ASCII, Latin-1 and Latin Extended-A without the dotted capital I
PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ſ]*")

# letters and digits that a comma or full stop after them does not join
_BEFORE_STOP = np.zeros(256, bool)
_BEFORE_STOP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[0x2C, 0x2E]] = True


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of words by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def pieces(self) -> list[str]:
        """The piece of each id."""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(k) or "" for k in range(size)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has)."""
        plain = [bool(PLAIN.fullmatch(w)) and not ("<" in w and any(t in w for t in self.special)) for w in words]
        shown = self.normalizer.normalize_str(" ".join(w for w, p in zip(words, plain, strict=True) if p))
        known: dict[str, list[int]] = {}
        found: list[list[int]] = [[]]
        for piece in PIECES.findall(shown):
            if piece == " ":
                found.append([])
                continue
            ids = known.get(piece)
            if ids is None:
                letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = known[piece] = [t.id for t in self.model.tokenize(letters)]
            found[-1].extend(ids)
        rest = iter(found)
        out = [next(rest) if p else self.tokenizer.encode(w, add_special_tokens=False).ids for w, p in zip(words, plain, strict=True)]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.uint32, int(counts.sum())), counts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path)


def _split_stops(chunk: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut a last comma or full stop off words that end with a letter or digit before it."""
    before = np.maximum(ends - 2, 0)
    letter = _BEFORE_STOP[chunk[before]]
    second = chunk[before]
    letter |= (second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7) & (chunk[np.maximum(ends - 3, 0)] == 0xC3) & (ends - starts >= 3)
    cut = ends[(ends - starts >= 2) & _STOPS[chunk[ends - 1]] & letter] - 1
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def encoding_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The units that are encoded one by one. A-Z counts as a-z, as the tokenizer lowers it, but for words with a ``<``,
    which may hold a special token."""
    words = runs_of(data, offsets, (IS_SPACE,), lower=True, split=_split_stops)[0]
    at = np.flatnonzero(data == 0x3C)
    if len(at):
        exact = runs_of(data, offsets, (IS_SPACE,), split=_split_stops)[0]
        odd = np.unique(np.searchsorted(words.start, at, "right") - 1)
        words.hash[odd] = mix(exact.hash[odd] + np.uint64(1))
    return words


def slices_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow string for each byte range."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, lengths)])).cast(pa.string())


class WordCache:
    """Ids of the words a Python worker has seen, by hash; emptied when it holds ``limit`` words, so its size is bounded."""

    def __init__(self, path: str, limit: int = 1_500_000):
        self.path, self.limit = path, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, how many each row has)."""
        words = encoding_words(data, offsets)
        if not len(words.hash):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._clear()
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        if new.any():
            place = first[new]
            ids, counts = encoder(self.path).encode(slices_of(data, words.start[place], words.end[place]).to_pylist())
            self.slot = np.insert(self.slot, at[new], len(self.count) + np.arange(len(counts)))
            self.known = np.insert(self.known, at[new], keys[new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, keys)
        slot = self.slot[at][inverse]
        counts = self.count[slot]
        return self.ids[ranges(self.start[slot], counts)], np.bincount(words.row, counts, len(offsets) - 1).astype(np.int64)


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


# a place is a block's id and a word's number in it, and a block's id is a partition and a number in it: 63 bits together
PARTITION_BITS, BLOCK_BITS, NUMBER_BITS = 20, 15, 28


def block_id(partition: int, number: int) -> int:
    if partition >> PARTITION_BITS or number >> BLOCK_BITS:
        raise ValueError(f"block {number} of partition {partition}: up to {1 << PARTITION_BITS} partitions of {1 << BLOCK_BITS} blocks have ids; "
                         "read the input in other partitions or set larger block_bytes")
    return partition << BLOCK_BITS | number


def first_place(block: int, n_distinct: int) -> int:
    """The place of a block's first word."""
    if n_distinct > 1 << NUMBER_BITS:
        raise ValueError(f"a block has {n_distinct} distinct words, over {1 << NUMBER_BITS}; read fewer rows a batch")
    return block << NUMBER_BITS


def _blocks(batches, block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """(block id, rows) in the order of a partition; the same for each run over the same partition."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.get_total_buffer_size()
        if size >= block_bytes:
            yield block_id(part, number), pa.Table.from_batches(held)
            number, held, size = number + 1, [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield block_id(part, number), pa.Table.from_batches(held)


def _unique_words(texts) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]:
    data, offsets = byte_view(texts)
    words = encoding_words(data, offsets)
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return data, offsets, words, first, inverse


def block_words(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(word, place): the distinct words of each block."""
    def run(batches):
        for block, table in _blocks(batches, block_bytes):
            data, _, words, first, _ = _unique_words(flat(table.column("text")))
            start = first_place(block, len(first))
            for low in range(0, len(first), 50_000):
                at = first[low:low + 50_000]
                place = start + low + np.arange(len(at), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([slices_of(data, words.start[at], words.end[at]), pa.array(place)], names=["word", "place"])

    return rows.mapInArrow(run, "word string, place long")


def block_texts(rows: DataFrame, block_bytes: int, kind: str) -> DataFrame:
    """(block, keys, counts, numbers, n_distinct): texts of a block as packed word numbers, a thousand texts at a time."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for block, table in _blocks(batches, block_bytes):
            _, offsets, words, first, inverse = _unique_words(flat(table.column("text")))
            counts = np.bincount(words.row, minlength=len(offsets) - 1)
            keys = flat(table.column("key"))
            # frequent words get small ranks, whose high bytes pack to nothing
            uses = np.bincount(inverse, minlength=len(first))
            by_use = np.argsort(-uses, kind="stable")
            rank = np.empty(len(first), np.int64)
            rank[by_use] = np.arange(len(first))
            ends = np.concatenate([[0], np.cumsum(counts)])
            for low in range(0, len(counts), 1000):
                high = min(low + 1000, len(counts))
                packed = pack.compress(_planes(rank[inverse[ends[low]:ends[high]]]))
                order = pack.compress(_planes(by_use)) if low == 0 else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([keys.slice(low, high - low).to_pylist()], pa.list_(keys.type)),
                    pa.array([counts[low:high].astype(np.int32)], pa.list_(pa.int32())), pa.array([packed], pa.binary()),
                    pa.array([order], pa.binary()), pa.array([len(first)], pa.int32())],
                    names=["block", "keys", "counts", "ranks", "by_rank", "n_distinct"])

    return rows.mapInArrow(run, f"block long, keys array<{kind}>, counts array<int>, ranks binary, by_rank binary, n_distinct int")


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encode_distinct(places: DataFrame, path: str, held_rows: int = 200_000) -> DataFrame:
    """(block, numbers, counts, ids): each distinct word is encoded once, in the partition where all its places lie together."""
    def run(batches):
        held, size, last = [], 0, ("", np.zeros(0, np.uint32))
        for batch in batches:
            if not batch.num_rows:
                continue
            table = flat(batch.column("word")).dictionary_encode()  # rows of a word follow each other
            words = table.dictionary.to_pylist()
            seen = words[0] == last[0]
            ids, counts = encoder(path).encode(words[seen:])
            if seen:
                ids, counts = np.concatenate([last[1], ids]), np.concatenate([[len(last[1])], counts])
            ends = np.cumsum(counts)
            last = (words[-1], ids[ends[-1] - counts[-1]:])
            at = table.indices.to_numpy()
            held.append((batch.column("place").to_numpy(), counts[at], ids[ranges((ends - counts)[at], counts[at])]))
            size += len(at)
            if size >= held_rows:
                yield from _by_block(held)
                held, size = [], 0
        if held:
            yield from _by_block(held)

    by_word = places.repartition("word").sortWithinPartitions("word")
    return by_word.mapInArrow(run, "block long, numbers binary, counts binary, ids binary")


def _by_block(held) -> Iterator[pa.RecordBatch]:
    """One row for each block, packed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    place, counts, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.argsort(place)
    starts = (np.cumsum(counts) - counts)[order]
    place, counts = place[order], counts[order]
    ids = ids[ranges(starts, counts)]
    block = place >> NUMBER_BITS
    edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    id_edges = np.concatenate([[0], np.cumsum(counts)])
    rows = [[], [], [], []]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        number = place[a:b] & ((1 << NUMBER_BITS) - 1)
        for column, value in zip(rows, (int(block[a]), pack(_planes(np.diff(number, prepend=0))), pack(_planes(counts[a:b])),
                                        pack(_planes(ids[id_edges[a]:id_edges[b]]))), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]],
                                     names=["block", "numbers", "counts", "ids"])


def _assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """(key, ids) of the texts of a block from the ids of its words."""
    if not texts.num_rows:
        return pa.table({"key": pa.array([], texts.schema.field("keys").type.value_type), "ids": pa.array([], pa.binary())})
    unpack = zstandard.ZstdDecompressor().decompress
    n = texts.column("n_distinct")[0].as_py()
    start, count = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    all_ids, size = [], 0
    for numbers, counts, ids in zip(*(words.column(c).to_pylist() for c in ("numbers", "counts", "ids")), strict=True):
        at, lengths, some = np.cumsum(_from_planes(unpack(numbers))), _from_planes(unpack(counts)), _from_planes(unpack(ids))
        count[at] = lengths
        start[at] = size + np.cumsum(lengths) - lengths
        all_ids.append(some.astype("<u4"))
        size += len(some)
    if (count < 0).any():
        raise RuntimeError("a block's words changed between two reads of the input; write it to a table first")
    all_ids = np.concatenate(all_ids) if all_ids else np.zeros(0, "<u4")
    by_rank = next(_from_planes(unpack(x)) for x in texts.column("by_rank").to_pylist() if x is not None)
    out = []
    for keys, counts, ranks in zip(texts.column("keys"), texts.column("counts"), texts.column("ranks").to_pylist(), strict=True):
        number = by_rank[_from_planes(unpack(ranks))]
        ids = all_ids[ranges(start[number], count[number])]
        ends = np.concatenate([[0], np.cumsum(count[number])])[np.concatenate([[0], np.cumsum(counts.values.to_numpy())])] * 4
        out.append(pa.table({"key": keys.values, "ids": pa.BinaryArray.from_buffers(
            pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.view(np.uint8))])}))
    return pa.concat_tables(out)


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ids) for every row: the token ids as little-endian unsigned 32-bit integers, special tokens added nowhere.

    ``docs`` is read twice and must give the same rows in the same order both times, as a table does; otherwise the job
    fails. Null and empty texts have no ids. Repeated rows are encoded alike, each in its row; an empty table gives an empty
    result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    texts = block_texts(rows, block_bytes, kind)
    words = encode_distinct(block_words(rows, block_bytes), path)
    joined = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assemble, f"key {kind}, ids binary")
    return joined.withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns and the decoded text: the join of each id with the table of pieces, which has a row for each id of the
    vocabulary and is held by each task, joined with spaces as the tokenizer does without a decoder. Ids that the vocabulary
    lacks have no piece; a null list of ids decodes to the empty text."""
    prepare(encoded.sparkSession)
    place = encoded.drop(to).columns.index(ids)
    schema = encoded.drop(to).withColumn(to, F.lit("")).schema

    def run(batches):
        pieces = [p.encode() + b" " if p else b"" for p in encoder(path).pieces()]
        lengths = np.array([*map(len, pieces), 0], np.int64)
        starts = np.cumsum(lengths) - lengths
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            data, offsets = byte_view(batch.column(place))
            number = np.minimum(np.frombuffer(data.tobytes(), "<u4"), len(pieces)).astype(np.int64)
            size = np.concatenate([[0], np.cumsum(lengths[number])])[offsets // 4]
            shown = letters[ranges(starts[number], lengths[number])]
            texts = [shown[a:max(a, b - 1)].tobytes().decode() for a, b in zip(size[:-1], size[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return encoded.drop(to).mapInArrow(run, schema)
