"""Alignment of two tokenizers over a corpus, with link counts by external spill counting.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups, and the two tokens that end
there are linked. How often a pair of ids is linked in the corpus is counted outside memory:

1. Each task encodes its texts once. Its (pair, row) records fill a buffer; a full buffer is dealt by the B id into
   ``RADIX`` parts, each sorted by (B id, A id, row) and written as a run of small zstd frames.
2. A task holds the packed runs of a share of a part and merges them through a heap, a frame of each run unpacked at a time.
   Records come in side-major order, so that the count of a pair is complete when the next pair comes. Shares of a part
   are sized by its bytes, runs and frames (runs pack to a fifth of a byte a link, but each has a frame open), so a B id with a
   third of all links is counted by many tasks; their counts are added up.
3. The same merge runs again beside the counts of the part, where all pairs of a B id lie together and give its maximum.
   Each record then pays its row back: links, links with the maximum, counts. These sums go back to rows by an aggregate.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import byte_view, flat, prepare, ranges
from codeloom.llm.tokens import BYTE_LETTERS
from codeloom.session import cut_lineage

RADIX = 16
CHUNK_BYTES = 1 << 20  # of text that is encoded at once
RUN_LINKS = 1 << 20  # of a buffer
FRAME_RECORDS = 1 << 13
PART_BYTES = 64 << 20  # packed runs of one task
MERGED_RUNS, MERGED_FRAMES = 128, 1 << 10  # of one task; an unpacked frame has 24 bytes a record
HELD_SUMS = 1 << 20
ROW_BITS = 40  # of a row's number in its partition


class Pieces:
    """The bytes of each id, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.letters[ranges(self.starts[ids], self.lengths[ids])]


class ByteSide:
    """Side A: a byte-level tokenizers file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte_of = {letter: b for b, letter in BYTE_LETTERS.items()}
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.pieces = Pieces([bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide:
    """Side B: a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(size)]
        self.pieces = Pieces([bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    """One pair for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    return ByteSide(path_a), PieceSide(path_b)


def _ids(side, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = side.encode(texts)
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum())), counts


@lru_cache(maxsize=1)
def _decimals(size: int) -> Pieces:
    return Pieces([b"%d," % k for k in range(size)])


def align(side_a, side_b, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups as columns of rows; groups_sha256; row of each link; pair of each link as B id << 32 | A id)."""
    n = len(texts)
    data = np.frombuffer("".join(" " + t if t else "" for t in texts).encode(), np.uint8)
    size = np.array([len(t.encode()) + 1 if t else 0 for t in texts], np.int64)
    filled = [t or "" for t in texts]
    found = []
    good = size > 0
    for side in (side_a, side_b):
        ids, counts = _ids(side, filled)
        row = np.repeat(np.arange(n), counts)
        good &= np.bincount(row, side.pieces.lengths[ids], n).astype(np.int64) == size
        found.append((ids, row))
    kept, stays = [], np.repeat(good, size)
    wanted, wanted_row = data[stays], np.repeat(np.arange(n), size)[stays]
    differs = np.zeros(n, bool)
    for side, (ids, row) in zip((side_a, side_b), found, strict=True):
        ids, row = ids[good[row]], row[good[row]]
        differs[wanted_row[side.pieces.joined(ids) != wanted]] = True
        kept.append((ids, row))
    (a, row_a), (b, row_b) = [(ids[~differs[row]], row[~differs[row]]) for ids, row in kept]
    ends_a, ends_b = np.cumsum(side_a.pieces.lengths[a]), np.cumsum(side_b.pieces.lengths[b])
    cuts, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    link_row = row_a[at_a]
    stats = np.stack([np.bincount(r, minlength=n) for r in (row_a, row_b, link_row)], axis=1)
    return stats, _shown(n, a, b, row_a, ends_a, ends_b, cuts, at_a, at_b), link_row, b[at_b] << 32 | a[at_a]


def _shown(n, a, b, row_a, ends_a, ends_b, cuts, at_a, at_b) -> list[str]:
    """The digest of each row's groups, ``a1,a2|b1;a3|b2,b3``."""
    place = np.empty(len(a) + len(b), np.int64)
    ids = np.empty(len(place), np.int64)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    place_a = np.arange(len(a)) + np.concatenate([[0], at_b[:-1] + 1])[group_a] if len(a) else np.zeros(0, np.int64)
    place_b = np.arange(len(b)) + at_a[group_b] + 1 if len(b) else np.zeros(0, np.int64)
    ids[place_a], ids[place_b] = a, b
    decimals = _decimals(1 << 17) if not len(ids) or ids.max() < 1 << 17 else Pieces([b"%d," % k for k in range(int(ids.max()) + 1)])
    shown, ends = decimals.joined(ids), np.cumsum(decimals.lengths[ids])
    shown[ends[place_a[at_a]] - 1] = ord("|")
    shown[ends[place_b[at_b]] - 1] = ord(";")
    last = np.full(n, -1, np.int64)
    last[row_a[at_a]] = ends[place_b[at_b]]  # the last group of a row wins
    out, low = [], 0
    for high in last.tolist():
        out.append("" if high < 0 else hashlib.sha256(shown[low:high - 1].tobytes()).hexdigest())
        low = max(low, high)
    return out


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack_frame(pair: np.ndarray, row: np.ndarray, uses: np.ndarray) -> bytes:
    """Sorted records as steps, the bytes of equal weight side by side."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(_planes(x) for x in (np.diff(pair, prepend=0), np.diff(row, prepend=0), uses)))


def unpack_frame(frame: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    pair, row, uses = np.ascontiguousarray(raw.reshape(3, 8, -1).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return [np.cumsum(pair), np.cumsum(row), uses]


def radix_of(pair: np.ndarray, radix: int) -> np.ndarray:
    return (pair >> 32) % radix


def spill(pair: np.ndarray, row: np.ndarray, radix: int) -> Iterator[tuple[int, list[bytes]]]:
    """(part, frames) of a full buffer: sorted by part and (pair, row), equal records as one with their number."""
    part = radix_of(pair, radix)
    order = np.lexsort((row, pair, part))
    pair, row, part = pair[order], row[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(pair) else np.zeros(0, np.int64)
    uses = np.diff(np.append(first, len(pair)))
    pair, row, part = pair[first], row[first], part[first]
    edges = np.searchsorted(part, np.arange(radix + 1))
    for k in range(radix):
        lows = range(int(edges[k]), int(edges[k + 1]), FRAME_RECORDS)
        frames = [pack_frame(*(x[low:min(low + FRAME_RECORDS, edges[k + 1])] for x in (pair, row, uses))) for low in lows]
        if frames:
            yield k, frames


def merged(runs: list[list[bytes]]) -> Iterator[list[np.ndarray]]:
    """(pair, row, uses) of sorted runs in the order of pairs. The heap has the last pair of each run's open frame: what is
    not above the least of them is complete, but for frames of that run which go on with the same pair."""
    opened: dict[int, list[np.ndarray]] = {}
    waiting = {k: iter(frames) for k, frames in enumerate(runs)}
    heap: list[tuple[int, int]] = []

    def open_next(k: int) -> None:
        frame = next(waiting[k], None)
        if frame is None:
            opened.pop(k, None)
        else:
            opened[k] = unpack_frame(frame)
            heapq.heappush(heap, (int(opened[k][0][-1]), k))

    for k in waiting:
        open_next(k)
    while heap:
        limit = heap[0][0]
        taken = []
        for k, columns in opened.items():
            end = int(np.searchsorted(columns[0], limit, "right"))
            if end:
                taken.append([x[:end] for x in columns])
                opened[k] = [x[end:] for x in columns]
        columns = [np.concatenate([t[c] for t in taken]) for c in range(3)]
        order = np.argsort(columns[0], kind="stable")
        yield [x[order] for x in columns]
        used = []
        while heap and heap[0][0] == limit:
            used.append(heapq.heappop(heap)[1])
        for k in used:  # their next frames may go on with the same pair
            open_next(k)


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def count_runs(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, count): each pair once, when the next one comes."""
    held = [np.zeros(0, np.int64)] * 2
    for pair, _, uses in merged(runs):
        pairs, counts = _sums(np.concatenate([held[0], pair]), np.concatenate([held[1], uses]))
        yield pairs[:-1], counts[:-1]
        held = [pairs[-1:], counts[-1:]]
    yield tuple(held)


def pay_back(runs: list[list[bytes]], pairs: np.ndarray, counts: np.ndarray, limit: int = HELD_SUMS) -> Iterator[list[np.ndarray]]:
    """(row, n_best, count_sum) sums; a row may come several times. ``pairs`` is sorted, hence by B id."""
    side = pairs >> 32
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])) if len(side) else np.zeros(0, np.int64)
    best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side)))) if len(side) else np.zeros(0, bool)
    held, size = [], 0
    for pair, row, uses in merged(runs):
        at = np.searchsorted(pairs, pair)
        held.append([row, uses * best[at], uses * counts[at]])
        size += len(row)
        if size >= limit:
            sums = _sums(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if len(sums[0]) > limit // 2:
                yield sums
                held, size = [], 0
            else:
                held, size = [sums], len(sums[0])
    if held:
        yield _sums(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _chunks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    _, offsets = byte_view(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, len(texts))
        low = high


ENCODED = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("groups_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("size", pa.int64()), ("frames", pa.list_(pa.binary()))])


def encode_rows(docs: DataFrame, path_a: str, path_b: str, radix: int, run_links: int) -> DataFrame:
    """Rows of two kinds, from one pass: documents (row, key, numbers, digest) and runs (part, run, size, frames)."""
    def run(batches):
        side_a, side_b = sides(path_a, path_b)
        partition, seen, spilled, held, links = TaskContext.get().partitionId() << ROW_BITS, 0, 0, [], 0

        def out(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ENCODED], schema=ENCODED)

        def write():
            nonlocal spilled, held, links
            for part, frames in spill(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), radix):
                yield out(1, part=[part], run=[partition | spilled], size=[sum(map(len, frames))], frames=[frames])
            spilled, held, links = spilled + 1, [], 0

        for batch in batches:
            texts = flat(batch.column("text"))
            for low, high in _chunks(texts, CHUNK_BYTES):
                stats, shown, row, pair = align(side_a, side_b, texts.slice(low, high - low).to_pylist())
                yield out(high - low, row=partition + seen + np.arange(high - low), key=batch.column("key").slice(low, high - low), n_a=stats[:, 0],
                          n_b=stats[:, 1], n_groups=stats[:, 2], groups_sha256=shown)
                held.append((pair, partition + seen + row))
                seen, links = seen + high - low, links + len(pair)
                if links >= run_links:
                    yield from write()
        if links:
            yield from write()

    kinds = "row long, key long, n_a long, n_b long, n_groups long, groups_sha256 string, part int, run long, size long, frames array<binary>"
    return docs.mapInArrow(run, kinds)


def _table(found, schema: pa.Schema) -> pa.Table:
    """Tuples of arrays as one table."""
    return pa.concat_tables([pa.table(dict(zip(schema.names, columns, strict=True)), schema=schema) for columns in found] or [schema.empty_table()])


def _frames(table: pa.Table) -> list[list[bytes]]:
    return table.column("frames").to_pylist()


def share_of(runs: DataFrame, part_bytes: int = PART_BYTES, merged_runs: int = MERGED_RUNS, merged_frames: int = MERGED_FRAMES) -> tuple[Column, Column]:
    """(number of shares of a row's part, share of a run) by what one task may hold; the driver gets a row for each part."""
    found = runs.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("runs"), F.sum(F.size("frames")).alias("frames"))
    shares = F.lit(1)
    for r in found.collect():
        n = max(1, -(-r["bytes"] // part_bytes), -(-r["runs"] // merged_runs), -(-r["frames"] // merged_frames))
        shares = F.when(F.col("part") == r["part"], F.lit(n)).otherwise(shares)
    return shares, F.pmod(F.xxhash64("run"), shares)


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", radix: int = RADIX,
                    run_links: int = RUN_LINKS, part_bytes: int = PART_BYTES, merged_runs: int = MERGED_RUNS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Null and empty texts, and texts whose tokens do not join to the space and the text again, have zeros and an empty digest,
    and link nothing. Rows without key and repeated rows are rows like others, each counted. A pair of equal count to the
    highest of its B id is a best one too. An empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    made = cut_lineage(encode_rows(rows, path_a, path_b, radix, run_links))
    runs = made.filter("part is not null")
    shares, share = share_of(runs, part_bytes, merged_runs)
    runs = runs.select("part", share.alias("share"), "frames")
    of_pair = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    counted = runs.groupBy("part", "share").applyInArrow(lambda packed: _table(count_runs(_frames(packed)), of_pair), "pair long, n long")
    counts = cut_lineage(counted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("part", (F.shiftright("pair", 32) % radix).cast("int")))
    copies = counts.select("pair", "n", "part", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1)).alias("share"))

    of_row = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def back(packed: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        return _table(pay_back(_frames(packed), known.column("pair").to_numpy(), known.column("n").to_numpy()), of_row)

    paid = runs.groupBy("part", "share").cogroup(copies.groupBy("part", "share")).applyInArrow(back, "row long, n_best long, count_sum long")
    sums = paid.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return made.filter("row is not null").select("row", "key", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
