"""Rounds of local moving over packed links.

Links do not change from round to round, communities do. Links are packed once: a part holds all links of its source nodes
as arrays of positions, in a table bucketed by part. A round deals the communities of the nodes out to the parts that have links
to them, where numpy adds up the weights by community and picks the best move; links are read where they lie and never shuffled
again. A task holds the links of a part (``PART_LINKS``, or those of one node), a row for each node these lead to and one for each
community and part. ``JOB_ROUNDS`` rounds are one job: a round costs a shuffle, not a table, and rows keep what each round found.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

PART_LINKS = 1 << 22
LEAST_LINKS = 1 << 16  # of a part, where there are cores for more parts
CHUNK_LINKS = 1 << 18  # of a packed row
LEAST_GAIN = 1e-12
JOB_ROUNDS = 8
# The plan of the rounds is settled by the buckets: looking at it again before each shuffle takes longer than a round. And with a limit
# in bytes Spark measures a batch at each row, which takes time with the square of the rows where most lists are null.
SETTINGS = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


def _sorted_values(*columns) -> pa.Array:
    values = pa.chunked_array([c for column in columns for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]).unique()
    return values.take(pc.array_sort_indices(values))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def pack_part(src: pa.ChunkedArray, dst: pa.ChunkedArray, weight: np.ndarray, chunk: int):
    """(nodes in order, whether a node has links, strength, loop, chunks) of the links of a part; links given twice add up.

    A chunk has the positions of some sources, how many links each has, and positions and weights of these.
    """
    nodes = _sorted_values(src, dst)
    n = len(nodes)
    s, d = (pc.index_in(c, value_set=nodes).to_numpy().astype(np.int64) for c in (src, dst))
    key, w = _summed(s * n + d, weight)
    s, d = key // n, key % n
    strength, own = np.bincount(s, w, n), np.bincount(s, minlength=n) > 0
    loop = np.bincount(s[s == d], w[s == d], n)
    s, d, w = s[s != d], d[s != d], w[s != d]
    chunks, low = [], 0
    while low < len(s):
        high = min(low + chunk, len(s))
        # links of a node stay together
        high = int(np.searchsorted(s, s[high - 1], "left" if high < len(s) and s[high] == s[high - 1] and s[high - 1] != s[low] else "right"))
        sources, counts = np.unique(s[low:high], return_counts=True)
        chunks.append((sources.astype("<i4"), counts.astype("<i4"), d[low:high].astype("<i4"), w[low:high].astype("<f8")))
        low = high
    return nodes, own, strength, loop, chunks


def sums_by_code(counts: np.ndarray, codes: np.ndarray, weight: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, sum) of links of rows with so many links each, in this order."""
    at = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    key = at * n_codes + codes
    if len(counts) * n_codes <= 2 * len(key):
        found = np.flatnonzero(np.bincount(key, minlength=len(counts) * n_codes))
        sums = np.bincount(key, weight, len(counts) * n_codes)[found]
    else:
        found, sums = _summed(key, weight)
    return found // n_codes, found % n_codes, sums


def best_moves(chunks, code: np.ndarray, sigma: np.ndarray, k: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """(best code or -1, weight of links into the own community) of each node; ``sigma`` has the strength of each code.

    Gains are compared by 12 digits, ties go to the smallest code.
    """
    better, k_own, m = np.full(len(code), -1), np.zeros(len(code)), m2 / 2
    for sources, counts, dst, weight in chunks:
        row, target, k_in = sums_by_code(counts, code[dst], weight, len(sigma))
        mine, stay = code[sources], target == code[sources][row]
        own = np.zeros(len(sources))
        own[row[stay]] = k_in[stay]
        k_own[sources] = own
        strength, rest = k[sources], sigma[mine] - k[sources]
        gain = (k_in - own[row]) / m - strength[row] * (sigma[target] - rest[row]) / (2 * m * m)
        open_ = ~stay & (gain > LEAST_GAIN)
        row, target, gain = row[open_], target[open_], np.round(gain[open_], 12)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            top = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(row))))
            row, target = row[gain == top], target[gain == top]
            keep = np.concatenate([[True], row[1:] != row[:-1]])
            better[sources[row[keep]]] = target[keep]
    return better, k_own


def _longer(lists: pa.ChunkedArray, new: pa.Array) -> pa.Array:
    """Lists of equal length with one element more each."""
    old, n = pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else new[:0], len(new)
    size = len(old) // n if n else 0
    places = np.hstack([np.arange(n * size).reshape(n, size), n * size + np.arange(n)[:, None]]).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (size + 1)), pa.concat_arrays([old.cast(new.type), new]).take(pa.array(places)))


def _labels(spark, parts: int) -> list[int]:
    """A label for each bucket, so that every part has one of its own."""
    bucket = F.pmod(F.hash("part"), F.lit(parts)).alias("bucket")
    found = spark.range(64 * parts).select(F.col("id").cast("int").alias("part")).groupBy(bucket).agg(F.min("part").alias("part"))
    return sorted(r["part"] for r in found.collect())


def _packed(links: DataFrame, labels: list[int], chunk: int) -> DataFrame:
    """Rows of three kinds: nodes (k, loop), nodes that a part needs (both with ``node``), and chunks."""
    kind = links.schema["src"].dataType
    spark_schema = f"part int, node {kind.simpleString()}, k double, loop double, sources binary, counts binary, dst binary, weight binary"
    label = F.element_at(F.lit(labels), (F.pmod(F.xxhash64("src"), F.lit(len(labels))) + 1).cast("int"))

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        nodes, own, strength, loop, chunks = pack_part(table.column("src"), table.column("dst"), table.column("weight").to_numpy(), chunk)
        types = [pa.int32(), nodes.type, pa.float64(), pa.float64(), *[pa.binary()] * 4]
        names = ["part", "node", "k", "loop", "sources", "counts", "dst", "weight"]

        def out(n, **columns):
            columns["part"] = np.full(n, key[0].as_py(), np.int32)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

        yield out(len(nodes), node=nodes)
        yield out(int(own.sum()), node=nodes.filter(pa.array(own)), k=strength[own], loop=loop[own])
        for arrays in chunks:
            yield out(1, **{c: [a.tobytes()] for c, a in zip(names[4:], arrays)})

    # annotations as strings do not name the form that takes and gives batches
    pack.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = links.select("src", "dst", F.col("weight").cast("double").alias("weight"), label.alias("part"))
    return cut_lineage(rows.groupBy("part").applyInArrow(pack, spark_schema))


class PackedLinks:
    """Links in both directions (src, dst, weight), loops allowed, packed for rounds; ``drop`` ends the use of the table."""

    def __init__(self, links: DataFrame, part_links: int = PART_LINKS, chunk: int = CHUNK_LINKS):
        self.spark = links.sparkSession
        n = links.count()
        parts = max(-(-n // part_links), min(self.spark.sparkContext.defaultParallelism, -(-n // LEAST_LINKS)), 1)
        self.labels = _labels(self.spark, parts)
        packed = _packed(links, self.labels, chunk)
        needed = packed.filter("sources IS NULL AND k IS NULL").groupBy("node").agg(F.collect_list("part").alias("parts"))
        own = packed.filter("k IS NOT NULL").select("node", F.col("part").alias("home"), "k", "loop")
        self.state = cut_lineage(own.join(needed, "node").select("node", F.col("node").alias("community"), "k", "loop", "home", "parts"))
        self.m2, self.loops = self.state.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("loop"), F.lit(0.0))).first()
        self.table = f"packed_links_{uuid.uuid4().hex}"
        chunks = packed.filter("sources IS NOT NULL").select("part", "sources", "counts", "dst", "weight")
        chunks.repartition(parts, "part").write.bucketBy(parts, "part").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rounds(self, state: DataFrame, turn: int, n: int = JOB_ROUNDS) -> DataFrame:
        """``state`` (node, community, k, home, parts) after ``n`` rounds, written, with a list element for each round: the community
        before it (``seen``), whether the node wants to move (``wants``), the weight of its links into its own community
        (``inside``) and its strength times that of its community (``outside``). A node may move if its hash gives it the turn."""
        kind, m2, labels = state.schema["node"].dataType.simpleString(), self.m2, [int(p) for p in self.labels]
        lists = {"seen": kind, "wants": "boolean", "inside": "double", "outside": "double"}
        own = ["home", "k", "turns", "parts", *lists]
        schema = f"node {kind}, community {kind}, sigma double, home int, k double, turns int, parts array<int>, " + ", ".join(
            f"{c} array<{t}>" for c, t in lists.items())
        names = [c.split()[0] for c in schema.split(", ")]

        def move(packed: pa.Table, known: pa.Table) -> pa.Table:
            is_node = pc.is_valid(known.column("node"))
            strengths, known = known.filter(pc.invert(is_node)), known.filter(is_node)
            known = known.take(pc.sort_indices(known, sort_keys=[("node", "ascending")]))
            values = _sorted_values(strengths.column("community"))
            code_of = lambda table: pc.index_in(table.column("community"), value_set=values).to_numpy().astype(np.int64)
            sigma = np.bincount(code_of(strengths), strengths.column("sigma").to_numpy(), len(values))
            code, k = code_of(known), np.nan_to_num(known.column("k").to_numpy())
            columns = [[np.frombuffer(x.as_buffer(), t) for x in packed.column(c)] for c, t in
                       (("sources", "<i4"), ("counts", "<i4"), ("dst", "<i4"), ("weight", "<f8"))]
            better, k_own = best_moves(zip(*columns), code, sigma, k, m2)
            mine = pc.is_valid(known.column("home"))
            known, at = known.filter(mine), mine.to_numpy()
            better, k_own, code, k = better[at], k_own[at], code[at], k[at]
            lengths = pc.list_value_length(known.column("seen")).to_numpy()
            has_turn = known.column("turns").to_numpy() >> (lengths[0] if len(lengths) else 0) & 1 == 1
            moved = np.where(has_turn & (better >= 0), better, code)
            new = [values.take(pa.array(code)), pa.array(better >= 0), pa.array(k_own), pa.array(k * sigma[code])]
            grown = {c: _longer(known.column(c), x) for c, x in zip(lists, new)}
            grown |= {"community": values.take(pa.array(moved)), "sigma": pa.nulls(len(k), pa.float64())}
            rows = pa.table([grown.get(c, known.column(c)) for c in ["node", "community", "sigma", *own]], names=names)
            # the strength of communities: each part tells all parts of its own nodes
            left = np.flatnonzero(np.bincount(moved, minlength=len(values)))
            theirs = {"community": values.take(pa.array(left)), "sigma": pa.array(np.bincount(moved, k, len(values))[left]),
                      "parts": pa.array([labels] * len(left), rows.schema.field("parts").type)}
            return pa.concat_tables([rows, pa.table([theirs.get(f.name, pa.nulls(len(left), f.type)) for f in rows.schema], schema=rows.schema)])

        def dealt(rows: DataFrame) -> DataFrame:
            here = F.col("part") == F.col("home")
            return rows.select("*", F.explode("parts").alias("part")).select("part", "node", "community", "sigma", *[F.when(here, F.col(c)).alias(c) for c in own])

        has_turn = [F.when(F.pmod(F.xxhash64("node", F.lit(turn + r)), F.lit(2)) == 0, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(n)]
        turns = functools.reduce(lambda a, b: a + b, has_turn)
        none = [F.array().cast(f"array<{t}>").alias(c) for c, t in lists.items()]
        rows = state.select("node", "community", F.lit(None).cast("double").alias("sigma"), "home", "k", turns.alias("turns"), "parts", *none)
        sums = state.groupBy("community").agg(F.sum("k").alias("sigma")).withColumn("parts", F.lit(labels))
        rows = rows.unionByName(sums, allowMissingColumns=True)
        for _ in range(n):
            rows = self.spark.table(self.table).groupBy("part").cogroup(dealt(rows).groupBy("part")).applyInArrow(move, schema)
        was = {key: self.spark.conf.get(key) for key in SETTINGS}
        try:
            for key, value in SETTINGS.items():
                self.spark.conf.set(key, value)
            return cut_lineage(rows.filter("node IS NOT NULL").select("node", "community", "k", "home", "parts", *lists))
        finally:
            for key, value in was.items():
                self.spark.conf.set(key, value)
