"""Packing of token ids into sequences of bounded length by bounded-space best fit.

Each partition holds a fixed number of open windows. A document's full windows go out at once; what is left is placed into
the open window it fits best, and if it fits none the fullest one is emitted. Windows still open at a partition's end are
merged in rounds of a bounded number of partitions, where pieces are cut at window ends, so that only the very last window
is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import byte_view, prepare
from codeloom.llm.tokens import word_cache
from codeloom.session import cut_lineage

WINDOW = 4096
OPEN_WINDOWS = 64
FAN_IN = 16
END_ID = 2

PIECES = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
SCHEMA = ("key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary")


class Packer:
    """Open windows of one partition; rows of emitted windows are gathered in ``rows``."""

    def __init__(self, part: int, round_: int, window: int, n_open: int, with_ids: bool):
        self.window, self.with_ids, self.part = window, with_ids, part
        self.next_id = (round_ << 56) | (part << 32)
        self.free = np.full(n_open, -1, np.int64)  # -1: not open
        self.held: list[list[tuple]] = [[] for _ in range(n_open)]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            data = ids.tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(data), total, self.next_id, offset, self.part, data if self.with_ids else None))
            offset += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray) -> None:
        """Place a document: full windows of their own, then the rest by best fit."""
        total, at = len(ids), 0
        while total - at >= self.window:
            self.emit([(key, at, ids[at:at + self.window], total)])
            at += self.window
        if at == total:
            return
        rest = total - at
        fits = np.flatnonzero(self.free >= rest)
        if len(fits):
            best = int(fits[self.free[fits].argmin()])
        else:
            shut = np.flatnonzero(self.free < 0)
            if len(shut):
                best = int(shut[0])
            else:
                best = int(self.free.argmin())
                self.emit(self.held[best])
            self.free[best], self.held[best] = self.window, []
        self.held[best].append((key, at, ids[at:].copy(), total))
        self.free[best] -= rest
        if not self.free[best]:
            self.emit(self.held[best])
            self.free[best], self.held[best] = -1, []

    def left_over(self) -> list[tuple]:
        """Rows of the windows that are still open, with their ids and without a sequence."""
        return [(key, start, len(ids), None, total, None, None, self.part, ids.tobytes())
                for slot in np.flatnonzero(self.free >= 0) for key, start, ids, total in self.held[slot]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def _pack_partition(path: str, window: int, n_open: int, end_id: int, with_ids: bool):
    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), 0, window, n_open, with_ids)
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            ids, counts = word_cache(path).encode(data, offsets)
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            at = 0
            for key, end in zip(batch.column("key").to_pylist(), ends.tolist(), strict=True):
                packer.add(key, whole[at:end])
                at = end
            yield _batch(packer.rows)
            packer.rows = []
        yield _batch(packer.left_over())

    return run


def _merge(round_: int, window: int, last: bool, with_ids: bool):
    """Pieces of a few partitions, large ones first, laid end to end and cut at window ends."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["key"] is None, r["key"] or 0, r["start"]))
        packer = Packer(table.column("part")[0].as_py() // FAN_IN, round_, window, 1, with_ids)
        held, free = [], window
        for row in rows:
            ids, start = np.frombuffer(row["ids"], "<u4"), row["start"]
            while len(ids):
                piece, ids = ids[:free], ids[free:]
                held.append((row["key"], start, piece, row["doc_tokens"]))
                start, free = start + len(piece), free - len(piece)
                if not free:
                    packer.emit(held)
                    held, free = [], window
        if last and held:
            packer.emit(held)
        elif held:
            packer.free[0], packer.held[0] = free, held
        return pa.Table.from_batches([_batch(packer.rows + packer.left_over())])

    return run


def pack_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, n_open: int = OPEN_WINDOWS,
                   end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece.

    Every document is its ids and ``end_id``, so null and empty texts are one id. ``ids`` is null unless ``with_ids``.
    Repeated rows are packed each for itself; null keys stay null; an empty table gives an empty result; other columns are
    not read. A partition holds ``n_open`` windows, a merge at most ``FAN_IN`` times that.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    packed = cut_lineage(rows.mapInArrow(_pack_partition(path, window, n_open, end_id, with_ids), SCHEMA))
    done, open_ = [packed.filter("sequence_id is not null")], packed.filter("sequence_id is null")
    round_ = 0
    while True:
        round_ += 1
        top = open_.agg(F.max("part")).first()[0]
        if top is None:
            break
        last = top < FAN_IN
        group = F.floor(F.col("part") / FAN_IN)
        merged = cut_lineage(open_.groupBy(group.alias("group")).applyInArrow(_merge(round_, window, last, with_ids), SCHEMA))
        done.append(merged.filter("sequence_id is not null"))
        open_ = merged.filter("sequence_id is null")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part").withColumnRenamed("key", key)
