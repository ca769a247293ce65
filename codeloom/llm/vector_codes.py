"""Vector compression by part codebooks, assigned exactly in integers through Walsh-Hadamard coefficients.

A vector of integers is cut into ``PARTS`` parts, and each part becomes the index of the nearest of the ``ENTRIES`` entries
that its position's codebook has. Parts and entries are padded with zeros to a power of two, m, and transformed by sums and
differences only; the squared differences of the coefficients add up to m times the squared distance. They are added in
sequency order, lowest first, where most of a distance lies, and an entry whose sum is over that of a known entry is out.

Codebooks are bounded (parts x entries x part length), so they travel with the tasks; sums of parts are added up in each task
before they are shuffled. All other tables are as long as the input and never leave the executors.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import flat, prepare
from codeloom.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BATCH_ROWS = 4096
# larger components count as this; no distance to one fits in 63 bits
LARGEST = 1 << 62
LAST = (1 << 63) - 1


def sequency_order(m: int) -> np.ndarray:
    """The places of the coefficients in the butterfly's result, by rising number of sign changes."""
    bits = m.bit_length() - 1
    gray = np.arange(m) ^ (np.arange(m) >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) if bits else gray


def walsh(x: np.ndarray) -> np.ndarray:
    """Coefficients of the rows of ``x``, padded with zeros, in sequency order; integers stay integers."""
    n, p = x.shape
    m = 1 << max(p - 1, 0).bit_length()
    out = np.zeros((n, m), x.dtype)
    out[:, :p] = x
    step = 1
    while step < m:
        pairs = out.reshape(n, m // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, m)
        step *= 2
    return out[:, sequency_order(m)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row; the lower index of equally near ones."""
    a, b = walsh(x), walsh(entries)
    n, m = a.shape
    some = (a[:, :1] - b[:, 0]) ** 2
    # the entry of the nearest mean bounds what the others may reach
    near = b[np.argmin(some, axis=1)]
    most = ((a - near) ** 2).sum(axis=1)
    row, entry = np.nonzero(some <= most[:, None])
    reached = some[row, entry]
    for s in range(1, m):
        reached = reached + (a[row, s] - b[entry, s]) ** 2
        stays = reached <= most[row]
        row, entry, reached = row[stays], entry[stays], reached[stays]
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(reached, starts)
    best = np.flatnonzero(reached == least[row])
    best = best[np.unique(row[best], return_index=True)[1]]
    return entry[best], least // m


def fits(largest: int, part: int) -> bool:
    """Whether distances of components up to ``largest`` stay inside 64 bits on the way."""
    return 64 * part * (2 * part) * largest * largest < 1 << 62


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of rows of parts x part length components; errors as Python integers where 64 bits may not do."""
    part, top = x.shape[2], max([0, *(abs(int(v)) for v in (books.min(initial=0), books.max(initial=0)))])
    tops = np.maximum(x.max(axis=(1, 2), initial=0), -x.min(axis=(1, 2), initial=0))
    safe = np.array([fits(max(top, int(t)), part) for t in np.unique(tops)], bool)[np.unique(tops, return_inverse=True)[1]]
    codes, errors = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), object)
    for which, kind in ((safe, np.int64), (~safe, object)):
        at = np.flatnonzero(which)
        for j in range(x.shape[1] if len(at) else 0):
            codes[at, j], far = nearest(x[at, j].astype(kind), books[j].astype(kind))
            errors[at] += far
    return codes, errors


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the rows (.., embedding) whose vectors hold finite numbers only."""
    def run(batches):
        for batch in batches:
            lists = flat(batch.column("embedding"))
            edges, n = lists.offsets.to_numpy() - lists.offsets[0].as_py(), len(lists)
            good = lists.is_valid().to_numpy(zero_copy_only=False).copy()
            size = np.where(good, np.diff(edges), 0)
            row = np.repeat(np.arange(n), size)
            values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            good[row[~np.isfinite(values)]] = False
            whole = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
            whole = np.clip(whole, -float(LARGEST), float(LARGEST)).astype(np.int64)[good[row]]
            ends = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(mask), batch.column("label").filter(mask),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(whole))], names=["vec_id", "label", "vector"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector array<long>")


def parts_of(column, parts: int, part: int) -> np.ndarray:
    """Rows x parts x part length; vectors end in zeros where they are shorter."""
    lists = flat(column)
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out = np.zeros((len(lists), parts * part), np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(edges))
    out[row, np.arange(len(row)) - edges[:-1][row]] = lists.flatten().to_numpy()
    return out.reshape(len(lists), parts, part)


def first_books(kept: DataFrame, parts: int, part: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids; of vectors that share an id, the smallest is taken."""
    ids = [r[0] for r in kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 0, part), np.int64)
    found = kept.filter(F.col("vec_id") <= F.lit(ids[-1])).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").toArrow()
    return parts_of(found.column("vector"), parts, part).transpose(1, 0, 2)


def part_sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, position, total, n): components of the parts nearest to each entry, added up task by task."""
    parts, entries, part = books.shape

    def run(batches):
        totals, n = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = parts_of(batch.column("vector"), parts, part)
            codes, _ = assign(x, books)
            small = not x.size or max(int(x.max()), -int(x.min())) < 1 << 40
            for j in range(parts):
                found = np.zeros((entries, part), np.int64 if small else object)
                np.add.at(found, codes[:, j], x[:, j] if small else x[:, j].astype(object))
                totals[j] += found
                n[j] += np.bincount(codes[:, j], minlength=entries)
        at = np.nonzero(np.repeat(n[:, :, None], part, axis=2))
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([
                *[pa.array(i, pa.int32()) for i in at], pa.array([Decimal(int(t)) for t in totals[at]], pa.decimal128(38, 0)),
                pa.array(n[at[0], at[1]])], names=["part", "entry", "position", "total", "n"])

    each = kept.select("vector").mapInArrow(run, "part int, entry int, position int, total decimal(38,0), n long")
    return each.groupBy("part", "entry", "position").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def train_books(kept: DataFrame, *, parts: int, part: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` of moving each used entry to the floor of its parts' mean."""
    books = first_books(kept, parts, part, entries)
    for _ in range(rounds if books.size else 0):
        moved = books.copy()
        for r in part_sums(kept, books).collect():  # a row for each component of the codebooks at most
            moved[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
        books = moved
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part."""
    parts, _, part = books.shape

    def run(batches):
        for batch in batches:
            codes, errors = assign(parts_of(batch.column("vector"), parts, part), books)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array([text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()),
                pa.array([min(int(e), LAST) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for every row whose vector is not null and finite in all components.

    Components become floor(scale * x). Vectors are as long as the longest one, rounded up to a multiple of ``parts``; shorter
    ones, empty ones too, end in zeros. Rows without key are encoded but start no entry; a repeated key starts one. With fewer
    keys than ``entries`` there are fewer entries; without any key all codes refer to one entry of zeros. Components beyond
    2^62 count as 2^62, errors beyond 63 bits as 2^63 - 1. Repeated rows get the same code each. An empty table gives an
    empty result; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    prepare(vectors.sparkSession, BATCH_ROWS)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    kept = cut_lineage(integer_vectors(rows, scale))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    books = train_books(kept, parts=parts, part=max(-(-longest // parts), 1), entries=entries, rounds=rounds)
    shown = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut_lineage(encode(kept, books if books.size else np.zeros((parts, 1, books.shape[2]), np.int64)))
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(Decimal(LAST))).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of_label"), "label_error")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256"))
