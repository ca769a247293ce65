"""Exact similarity joins over unit vectors.

Spark partitions the work; numpy multiplies two bounded blocks inside a task.

* Every vector has a home cell, the nearest of a bounded set of pivot vectors.
  The triangle inequality on angles says which other cells can hold a partner
  within the threshold; a vector visits only those. No pair is lost and no
  limit on partners is set.
* Cells are drawn together to groups of about one block, and a vector that visits
  several cells of a group goes there once: small cells cost no copies.
* A group is cut into blocks of bounded size by a hash of the id, however many
  rows it holds, so a hot cell becomes more tiles and never a bigger one.
* Exact copies are joined once (``distinct_vectors``, ``_classes``): a group of
  copies never meets itself vector by vector, only its ids are paired.
* Top-k without a threshold first bounds the k-th score inside the home cell,
  then visits only cells that can beat the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import vectors as vx
from codeloom.session import cut_lineage

MAX_PIVOTS = 1024
CELL_ROWS = 50_000
MIN_BLOCK, MAX_BLOCK = 256, 4096
MAX_TOP_BLOCK = 32_768  # of tiles that give sums or k rows a query, or their pairs a batch at a time
MAX_MEMBERS = 1024  # ids of equal vectors in a row
BATCH_PAIRS = 1 << 20  # that leave a tile at once
STRIPE = 1 << 22  # scores a kernel holds at once
SLACK = 1e-6  # added to angle bounds against rounding
SCORE_DIGITS = 9  # scores are rounded before ranking, so equal vectors tie


def _matrix(column) -> np.ndarray:
    """Arrow list column -> (rows, dim) array in double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


@dataclass
class Cells:
    """Pivots with the radius and row count of their cells; at most MAX_PIVOTS rows.

    ``group`` numbers neighbouring cells of together about one block alike, ``count`` has the rows of a group.
    """

    pivots: np.ndarray
    radius: np.ndarray
    occupied: np.ndarray
    group: np.ndarray
    count: np.ndarray
    block: int
    id_type: str

    @property
    def single(self) -> bool:
        return len(self.pivots) == 1

    def blocks(self) -> list[int]:
        return [max(1, math.ceil(c / self.block)) for c in self.count]


def distinct_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """One row per distinct vector: smallest id, number of copies."""
    return df.groupBy(F.col(vector).alias("embedding")).agg(F.min(vec_id).alias("id"), F.count("*").alias("copies"))


def copy_members(df: DataFrame, reps: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id of the representative, id of the member) for every row."""
    return (df.select(F.col(vec_id).alias("member"), F.col(vector).alias("embedding"))
            .join(reps.select("embedding", "id"), "embedding").select("id", "member"))


def _plain(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vec"))


def _home(df: DataFrame, pivots: np.ndarray, id_type: str) -> DataFrame:
    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            angles = _angles(_matrix(batch.column("vec")), pivots)
            home = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int32)), pa.array(angles[np.arange(len(home)), home])],
                names=["home", "angle"])

    return df.select("vec").mapInArrow(assign, "home int, angle double")


def build_cells(base: DataFrame, prune: bool = True, cell_rows: int = CELL_ROWS, max_block: int = MAX_BLOCK) -> Cells:
    """Choose pivots and measure cells of ``base`` (id, vec).

    The driver receives at most MAX_PIVOTS vectors and as many summary rows.
    """
    id_type = base.schema["id"].dataType.simpleString()
    n = base.count()
    block = int(min(max_block, max(MIN_BLOCK, math.ceil(n / 4))))
    wanted = min(MAX_PIVOTS, math.ceil(n / cell_rows)) if prune else 1
    if wanted <= 1:
        return Cells(np.zeros((1, 1)), np.array([math.pi]), np.array([n > 0]), np.zeros(1, np.int64), np.array([n]), block, id_type)
    picked = base.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = np.array([row["vec"] for row in picked], dtype=np.float64)
    radius, count = np.zeros(wanted), np.zeros(wanted, dtype=np.int64)
    for row in _home(base, pivots, id_type).groupBy("home").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
        radius[row["home"]], count[row["home"]] = row["r"], row["n"]
    order = np.argsort(_angles(pivots, pivots[:1])[:, 0], kind="stable")
    pivots, radius, count = pivots[order], radius[order], count[order]
    group = np.maximum(np.cumsum(count) - 1, 0) // block
    group = np.unique(group, return_inverse=True)[1]
    return Cells(pivots, radius, count > 0, group, np.bincount(group, weights=count).astype(np.int64), block, id_type)


def _visits(df: DataFrame, cells: Cells, self_join: bool, theta: float | None) -> DataFrame:
    """(id, vec, home, cells to visit) for rows (id, vec[, theta]); both name groups of cells. Other columns stay."""
    kept = [c for c in df.columns if c != "theta"]
    if cells.single:
        return df.select(*kept, F.lit(0).alias("home"),
                         (F.array().cast("array<int>") if self_join else F.array(F.lit(0))).alias("cells"))
    pivots, radius, occupied, group = cells.pivots, cells.radius, cells.occupied, cells.group
    firsts = np.searchsorted(group, np.arange(group[-1] + 1))
    per_row = theta is None

    def visit(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            angles = _angles(_matrix(batch.column("vec")), pivots)
            home = angles.argmin(axis=1)
            limit = (batch.column("theta").to_numpy(zero_copy_only=False) if per_row
                     else np.full(len(home), theta))[:, None]
            reach = (angles <= radius[None, :] + limit + SLACK) & occupied[None, :]
            if self_join:
                own = angles[np.arange(len(home)), home][:, None]
                # both vectors sit in their nearest cell, hence the second bound
                reach &= angles <= own + 2 * limit + SLACK
                reach &= np.arange(len(pivots))[None, :] > home[:, None]
            reach, home = np.logical_or.reduceat(reach, firsts, axis=1), group[home]
            if self_join:
                reach &= np.arange(len(firsts))[None, :] > home[:, None]
            rows, cols = np.nonzero(reach)
            offsets = np.zeros(len(home) + 1, dtype=np.int32)
            np.cumsum(np.bincount(rows, minlength=len(home)), out=offsets[1:])
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cols.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(home.astype(np.int32)), listed], names=[*kept, "home", "cells"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(visit, f"{types}, home int, cells array<int>")


def _lookup(values: list[int], index) -> F.Column:
    return F.element_at(F.lit([int(v) for v in values]), index + 1)


def _salt(count) -> F.Column:
    return F.pmod(F.xxhash64("id"), count).cast("int")


def _upto(count) -> F.Column:
    return F.sequence(F.lit(0), count - 1)


def _tile_join(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    keys = ["cell", "lsub", "rsub"]
    # fresh attributes for the right side: both sides may stem from one table
    right = right.select(*[F.col(c).alias(f"r{c}") for c in right.columns if c not in keys], *[F.col(k).alias(k) for k in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _tile_stream(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """As ``_tile_join``, for kernels that give batches one after the other: what a tile finds is never held as a whole."""
    rows = left.withColumn("is_right", F.lit(False)).unionByName(right.withColumn("is_right", F.lit(True)))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        on_right = table.column("is_right")
        yield from kernel(key, table.filter(pc.invert(on_right)), table.filter(on_right))

    # annotations as strings do not name the form that takes and gives batches
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("cell", "lsub", "rsub").applyInArrow(run, schema)


def _empty_pairs(src_type: str, dst_type: str) -> pa.Table:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.table({"src": pa.array([], types[src_type]), "dst": pa.array([], types[dst_type]),
                     "score": pa.array([], pa.float64())})


def _score(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return -np.sqrt(np.maximum(square, 0.0))
    return a @ b.T


def _stripes(x: np.ndarray, y: np.ndarray, metric: str):
    """(first row, scores) of as many rows of ``x`` at a time as a bounded table holds."""
    step = max(1, STRIPE // len(y))
    for begin in range(0, len(x), step):
        yield begin, _score(x[begin:begin + step], y, metric)


def _close(x: np.ndarray, y: np.ndarray, threshold: float, metric: str = "dot", within: float | None = None):
    """Positions and rounded scores of the pairs of two blocks that reach the threshold, a stripe at a time.

    With ``within`` they are also closer than that: 1 - score < within.
    """
    for begin, rough in _stripes(x, y, metric):
        # only what can reach the threshold is rounded
        i, j = np.nonzero(rough >= threshold - 10.0 ** -SCORE_DIGITS)
        scores = np.round(rough[i, j], SCORE_DIGITS)
        keep = scores >= threshold if within is None else (scores >= threshold) & (1 - scores < within)
        yield i[keep] + begin, j[keep], scores[keep]


def _self_tiles(base: DataFrame, cells: Cells, theta: float, kernel, schema: str, join=_tile_join) -> DataFrame:
    """``kernel`` over tiles that hold every pair of rows of ``base`` (id, vec, ...) within the angle ``theta``.

    A pair is in one tile; the tiles of a block with itself (equal numbers in the key) hold it both ways, and each row with itself.
    """
    rows = _visits(base, cells, True, theta)
    kept, blocks = base.columns, cells.blocks()
    if cells.single:
        visitors = [0]
    else:
        visitors = [0] * len(blocks)
        for row in rows.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
            visitors[row["cell"]] = row["count"]
    v_blocks = [math.ceil(v / cells.block) for v in visitors]

    # visitors (home < cell) take block numbers after the native blocks, so one
    # tile key space holds both kinds of tiles
    n_native = _lookup(blocks, F.col("home"))
    own = _salt(n_native)
    native_left = rows.select(*kept, F.col("home").alias("cell"), own.alias("lsub"), n_native.alias("n"))
    native_left = native_left.select(*kept, "cell", "lsub", F.explode(F.sequence(F.col("lsub"), F.col("n") - 1)).alias("rsub"))
    left = native_left
    if not cells.single:
        visiting = rows.select(*kept, F.explode("cells").alias("cell"))
        visiting = visiting.select(
            *kept, "cell", (_lookup(blocks, F.col("cell")) + _salt(_lookup(v_blocks, F.col("cell")))).alias("lsub"),
            F.explode(_upto(_lookup(blocks, F.col("cell")))).alias("rsub"))
        left = native_left.unionByName(visiting)
    right = rows.select(*kept, F.col("home").alias("cell"), own.alias("rsub"),
                        n_native.alias("n"), _lookup(v_blocks, F.col("home")).alias("v"))
    lefts = F.concat(F.sequence(F.lit(0), F.col("rsub")),
                     F.when(F.col("v") > 0, F.sequence(F.col("n"), F.col("n") + F.col("v") - 1))
                     .otherwise(F.array().cast("array<int>")))
    right = right.select(*kept, "cell", F.explode(lefts).alias("lsub"), "rsub")
    return join(left, right, kernel, schema)


def _angle(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold)))


def _classes(base: DataFrame, max_members: int) -> DataFrame:
    """(id, vec, members) of rows (id, vec): rows of equal vectors drawn together, several rows for more than ``max_members``."""
    hot = base.groupBy("vec").agg(F.count("*").alias("n")).filter(F.col("n") > max_members)
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("n") / max_members)))
    rows = base.join(hot, "vec", "left").groupBy("vec", salt.alias("salt")).agg(F.collect_list("id").alias("members"))
    return rows.select(F.array_min("members").alias("id"), "vec", "members")


def member_pairs(left: pa.ListArray, right: pa.ListArray, i: np.ndarray, j: np.ndarray, scores: np.ndarray, limit: int):
    """(src, dst, score) of all members of the classes ``left[i]`` and ``right[j]``, src < dst, some ``limit`` pairs at a time."""
    values, starts, lengths = [], [], []
    for lists in (left, right):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values.append(lists.values)
        starts.append(offsets[:-1])
        lengths.append(np.diff(offsets))
    wide = lengths[1][j]
    total = np.cumsum(lengths[0][i] * wide)
    low = 0
    while low < len(i):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + limit, "right")))
        at = np.repeat(np.arange(low, high), np.diff(total[low:high], prepend=done))
        nth = np.arange(len(at)) - (np.concatenate([[done], total[low:high - 1]]) - done)[at - low]
        p = values[0].take(pa.array(starts[0][i[at]] + nth // wide[at]))
        q = values[1].take(pa.array(starts[1][j[at]] + nth % wide[at]))
        smaller = pc.less(p, q)
        yield pc.if_else(smaller, p, q), pc.if_else(smaller, q, p), pa.array(scores[at]), smaller
        low = high


def similar_pairs(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding",
                  metric: str = "dot", cell_rows: int = CELL_ROWS, max_members: int = MAX_MEMBERS, batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """All pairs ``src < dst`` with score >= threshold; (src, dst, score).

    ``dot`` expects unit vectors and prunes cells; ``euclidean`` scores by the
    negated distance and joins blocks without pruning. Equal vectors go to the
    tiles as one row with their ids, and pairs leave a tile in batches, so tiles
    are as large as those of ``top_k``.
    """
    base = cut_lineage(_classes(_plain(df, vec_id, vector), max_members))
    cells = build_cells(base, prune=metric == "dot", cell_rows=cell_rows, max_block=MAX_TOP_BLOCK)

    def kernel(key, a: pa.Table, b: pa.Table):
        if not a.num_rows or not b.num_rows:
            return
        # a native block against itself holds each pair twice and the diagonal
        own = key[1].as_py() == key[2].as_py()
        left, right = (pa.concat_arrays([pa.ListArray.from_arrays(pc.subtract(c.offsets, c.offsets[0]), c.flatten()) for c in t.column("members").chunks])
                       for t in (a, b))
        for i, j, scores in _close(_matrix(a.column("vec")), _matrix(b.column("vec")), threshold, metric):
            for src, dst, score, smaller in member_pairs(left, right, i, j, scores, batch_pairs):
                out = pa.RecordBatch.from_arrays([src, dst, score], names=["src", "dst", "score"])
                yield out.filter(smaller) if own else out

    return _self_tiles(base, cells, _angle(threshold) if metric == "dot" else math.pi, kernel,
                       f"src {cells.id_type}, dst {cells.id_type}, score double", _tile_stream)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Both columns as positions in their distinct values in order, and these values; null is -1."""
    every = pa.chunked_array([*a.chunks, *b.chunks], a.type)
    values = every.unique().drop_null()
    values = values.take(pc.array_sort_indices(values))
    codes = pc.fill_null(pc.index_in(every, values), -1).to_numpy()
    return codes[:len(a)], codes[len(a):], values


def neighbour_sums(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding", weight: str | None = None,
                   group: str | None = None, by_score: bool = True, within: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Sums over the similar partners of each row that has some: (id, total, inside), without a row for each pair.

    ``total`` adds up the partners' ``weight`` (1 without), times the score with ``by_score``; ``inside`` only those of partners in the
    row's own ``group``. A tile adds up what its rows have in it, so at most a row for each row of its blocks leaves it, and blocks
    are as large as those of ``top_k``.
    """
    weights = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    groups = F.lit(None).cast("int") if group is None else F.col(group)
    base = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vec"), weights.alias("w"), groups.alias("g"))
    cells = build_cells(base, cell_rows=cell_rows, max_block=MAX_TOP_BLOCK)
    none = pa.table({"id": _empty_pairs(cells.id_type, cells.id_type).column("src"), "total": pa.array([], pa.float64()), "inside": pa.array([], pa.float64())})

    def sums(ids, at, at_partner, values, same):
        n = len(ids)
        # of no values at all numpy makes integers
        total, inside = (np.bincount(*rows, n).astype(np.float64) for rows in ((at, values), (at[same], values[same])))
        some = np.bincount(at, minlength=n)
        return [ids, total, inside, some]

    def add(so_far, now):
        return now if so_far is None else [now[0], *[p + q for p, q in zip(so_far[1:], now[1:])]]

    def kernel(key, a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [None, None]
        if a.num_rows and b.num_rows:
            own = key[1].as_py() == key[2].as_py()
            p, q, _ = _codes(a.column("id"), b.column("rid"))
            gp, gq, _ = _codes(a.column("g"), b.column("rg"))
            wp, wq = a.column("w").to_numpy(), b.column("rw").to_numpy()
            for i, j, scores in _close(_matrix(a.column("vec")), _matrix(b.column("rvec")), threshold, within=within):
                other = p[i] != q[j]
                i, j, scores = i[other], j[other], scores[other] if by_score else np.ones(other.sum())
                same = (gp[i] == gq[j]) & (gp[i] >= 0)
                sides[0] = add(sides[0], sums(a.column("id"), i, j, scores * wq[j], same))
                # a block against itself has every pair both ways
                if not own:
                    sides[1] = add(sides[1], sums(b.column("rid"), j, i, scores * wp[i], same))
        out = [pa.table({"id": ids.filter(pa.array(some > 0)), "total": total[some > 0], "inside": inside[some > 0]})
               for ids, total, inside, some in (side for side in sides if side is not None)]
        return pa.concat_tables(out) if out else none

    found = _self_tiles(base, cells, _angle(threshold), kernel, f"id {cells.id_type}, total double, inside double")
    return found.groupBy("id").agg(F.sum("total").alias("total"), F.sum("inside").alias("inside"))


def _join_up(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (smallest member of each node's tree) once the nodes ``i`` and ``j`` are linked."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low != high
        if not open_.any():
            return root
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def similar_forest(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding", core: str | None = None,
                   within: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links that connect what all similar pairs connect, without a row for each pair: (src, dst, is_core).

    A tile gives a tree for each part of its rows that hangs together, so fewer links than it has rows. With ``core`` (a boolean
    column) only rows that have it set link others; another row has links to its smallest core partner in each tile, ``is_core`` false.
    """
    cores = F.lit(True) if core is None else F.col(core)
    base = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vec"), cores.alias("core"))
    cells = build_cells(base, cell_rows=cell_rows, max_block=MAX_TOP_BLOCK)
    none = _empty_pairs(cells.id_type, cells.id_type)
    none = pa.table({"src": none.column("src"), "dst": none.column("dst"), "is_core": pa.array([], pa.bool_())})

    def kernel(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none
        p, q, ids = _codes(a.column("id"), b.column("rid"))
        is_core = np.zeros(len(ids), bool)
        is_core[p], is_core[q] = a.column("core").to_numpy(), b.column("rcore").to_numpy()
        root, nearest = np.arange(len(ids)), np.full(len(ids), len(ids))
        for i, j, _ in _close(_matrix(a.column("vec")), _matrix(b.column("rvec")), threshold, within=within):
            i, j = p[i], q[j]
            both = is_core[i] & is_core[j]
            root = _join_up(root, i[both], j[both])
            for edge, to in ((i, j), (j, i)):
                border = ~is_core[edge] & is_core[to]
                np.minimum.at(nearest, edge[border], to[border])
        linked, touching = np.nonzero(root != np.arange(len(ids)))[0], np.nonzero(nearest < len(ids))[0]
        return pa.table({"src": ids.take(pa.array(np.concatenate([linked, touching]))),
                         "dst": ids.take(pa.array(np.concatenate([root[linked], nearest[touching]]))),
                         "is_core": pa.array(np.arange(len(linked) + len(touching)) < len(linked))})

    return _self_tiles(base, cells, _angle(threshold), kernel, f"src {cells.id_type}, dst {cells.id_type}, is_core boolean")


def similarity_links(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding",
                     cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (src, dst, score) of a table that may hold many exact copies.

    Distinct vectors are paired exactly; every further copy hangs on its
    representative by one link. The links connect the same rows as all pairs
    would, and a group of n copies gives n - 1 rows instead of n (n - 1) / 2.
    """
    reps = cut_lineage(distinct_vectors(df, vec_id, vector))
    pairs = similar_pairs(reps, threshold, vec_id="id", cell_rows=cell_rows)
    unit = vx.dot(F.col("embedding"), F.col("embedding"))
    copies = (df.select(F.col(vec_id).alias("dst"), F.col(vector).alias("embedding"))
              .join(reps.select("embedding", F.col("id").alias("src")), "embedding").filter(F.col("src") != F.col("dst"))
              .select("src", "dst", F.round(unit, SCORE_DIGITS).alias("score")).filter(F.col("score") >= threshold))
    return pairs.unionByName(copies)


def _top_tiles(queries: DataFrame, base: DataFrame, cells: Cells, k: int, floor: float | None,
               mode: str, theta: float | None, metric: str) -> DataFrame:
    """Up to k candidates per query and tile; queries (id, vec, cells)."""
    visiting = _visits(queries, cells, False, theta) if "cells" not in queries.columns else queries
    visiting = visiting.select("id", "vec", F.explode("cells").alias("cell"))
    counts = [0] * len(cells.count)
    for row in visiting.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    v_blocks = [max(1, math.ceil(c / cells.block)) for c in counts]
    blocks = cells.blocks()
    left = visiting.select("id", "vec", "cell", _salt(_lookup(v_blocks, F.col("cell"))).alias("lsub"),
                           F.explode(_upto(_lookup(blocks, F.col("cell")))).alias("rsub"))
    homes = _visits(base, cells, True, 0.0).select("id", "vec", F.col("home").alias("cell"))
    right = homes.select("id", "vec", "cell", F.explode(_upto(_lookup(v_blocks, F.col("cell")))).alias("lsub"),
                         _salt(_lookup(blocks, F.col("cell"))).alias("rsub"))
    src_type = queries.schema["id"].dataType.simpleString()
    empty = _empty_pairs(src_type, cells.id_type)

    def kernel(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty
        b = b.take(pc.sort_indices(b, sort_keys=[("rid", "ascending")]))
        x, y, found = _matrix(a.column("vec")), _matrix(b.column("rvec")), []
        p, q = a.column("id").to_numpy(), b.column("rid").to_numpy()
        odd = not (np.isfinite(x).all() and np.isfinite(y).all())
        for begin, table in _stripes(x, y, metric):
            if odd:
                table[np.isnan(table)] = -np.inf
            if mode == "upper":
                table[q[None, :] <= p[begin:begin + len(table), None]] = -np.inf
            elif mode == "full":
                table[q[None, :] == p[begin:begin + len(table), None]] = -np.inf
            # candidates are all that may still tie with the k-th best once rounded
            least = np.partition(table, -k, axis=1)[:, -k] if k < table.shape[1] else np.full(len(table), -np.inf)
            if floor is not None:
                least = np.maximum(least, floor)
            i, j = np.nonzero((table >= least[:, None] - 10.0 ** -SCORE_DIGITS) & (table > -np.inf))
            scores = np.round(table[i, j], SCORE_DIGITS)
            if floor is not None:
                i, j, scores = i[scores >= floor], j[scores >= floor], scores[scores >= floor]
            # columns are in id order: ties go to the smaller id
            order = np.lexsort((j, -scores, i))
            i, j, scores = i[order], j[order], scores[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[best] + begin, j[best], scores[best]))
        i, j, scores = (np.concatenate(part) for part in zip(*found))
        return pa.table({"src": a.column("id").take(pa.array(i)), "dst": b.column("rid").take(pa.array(j)), "score": pa.array(scores)})

    return _tile_join(left, right, kernel, f"src {src_type}, dst {cells.id_type}, score double")


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, base: DataFrame, k: int, query_id: str = "vec_id", base_id: str = "vec_id",
          vector: str = "embedding", query_vector: str | None = None, min_score: float | None = None,
          mode: str = "cross", metric: str = "dot", cell_rows: int = CELL_ROWS) -> DataFrame:
    """k best partners of every query row: (src, dst, score, rank).

    mode: ``cross`` (two tables), ``full`` (one table, not itself), ``upper``
    (one table, only partners with a larger id). Ties go to the smaller id.
    """
    left = _plain(queries, query_id, query_vector or vector)
    right = _plain(base, base_id, vector)
    cells = build_cells(right, prune=metric == "dot", cell_rows=cell_rows, max_block=MAX_TOP_BLOCK)
    if cells.single:
        return _rank(_top_tiles(left, right, cells, k, min_score, mode, math.pi, metric), k)
    if min_score is not None:
        theta = math.acos(max(-1.0, min(1.0, min_score)))
        return _rank(_top_tiles(left, right, cells, k, min_score, mode, theta, metric), k)
    # first the home cell alone: its k-th score bounds the angle still worth a visit
    at_home = _visits(left, cells, True, 0.0).select("id", "vec", F.array("home").alias("cells"))
    first = _rank(_top_tiles(at_home, right, cells, k, None, mode, None, metric), k)
    bound = first.groupBy("src").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    theta = F.when(F.col("found") >= k, F.acos(F.greatest(F.least("worst", F.lit(1.0)), F.lit(-1.0)))).otherwise(
        F.lit(math.pi))
    bounded = left.join(bound, left["id"] == bound["src"], "left").select(
        "id", "vec", F.coalesce(theta, F.lit(math.pi)).alias("theta"))
    return _rank(_top_tiles(bounded, right, cells, k, None, mode, None, metric), k)


def nearest_to(df: DataFrame, query: list[float], k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k rows nearest to one query vector by full cosine; one scan, no shuffle of vectors."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    scored = df.select(vec_id, F.round(vx.cosine(F.col(vector), q), SCORE_DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), vec_id).limit(k)
