"""Semantic blocks: runs of neighbouring chunks that share symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import vectors as vx
from codeloom.functions.ordered import ROWS_PER_RANGE, forward_fill, running_sum, shift_value
from codeloom.operators import embedding
from codeloom.session import cut_lineage

SHARE = 0.6
REPRESENTATIVES = 6
# --- fixed values: limits of the block merge ---------------------------------
MERGE_SHARE, SAME_PARENT_SIM, SAME_FILE_SIM, MIN_SHARED = 0.5, 0.25, 0.35, 3
TOP_LEVEL_KINDS = ["mod", "struct", "enum", "fn", "trait", "impl"]


def semantic_blocks(chunks: DataFrame, keys: list[str], order: str, symbols: str = "containing_symbols",
                    share: float = SHARE, width: int = ROWS_PER_RANGE) -> DataFrame:
    """Number the blocks: a chunk joins the block before it if both share enough symbols."""
    rows = shift_value(chunks, keys, order, F.col(symbols), "__before", back=True, width=width)
    opens = (F.col("__before").isNull() | (vx.overlap_share(F.col("__before"), F.col(symbols)) < share)).cast("bigint")
    return running_sum(rows, keys, order, opens, "block", width).drop("__before")


def representatives(blocks: DataFrame, keys: list[str], symbols: str = "containing_symbols",
                    n: int = REPRESENTATIVES) -> DataFrame:
    """The n most frequent symbols of each block as (keys, block, rank, symbol, freq)."""
    counted = (blocks.select(*keys, "block", F.explode(symbols).alias("symbol"))
               .groupBy(*keys, "block", "symbol").agg(F.count("*").alias("freq")))
    best = Window.partitionBy(*keys, "block").orderBy(F.desc("freq"), "symbol")
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def block_names(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Readable name of each block from its first chunk id, and its number of chunks."""
    first = F.min_by("chunk_id", order)
    rows = blocks.groupBy(*keys, "block").agg(first.alias("first_id"), F.count("*").alias("n_chunks"))
    after = F.substr("first_id", F.instr("first_id", F.lit("::")) + 2)
    head = F.substring_index("first_id", "::", 1)
    name = (F.when(F.col("first_id").contains("::"),
                   F.when(after.contains(":"), F.substring_index(after, ":", 1)).otherwise(head))
            .otherwise(F.substring_index("first_id", ":", 1)))
    return rows.select(*keys, "block", "n_chunks", name.alias("name"))


def symbol_places(placed: DataFrame, shown: int = 3) -> DataFrame:
    """Per symbol of a file the first chunks it lives in and how many more there are."""
    first = Window.partitionBy("path", "name").orderBy("chunk_ord")
    counts = placed.groupBy("path", "name").agg(F.count("*").alias("n_chunks"))
    top = (placed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= shown)
           .groupBy("path", "name").agg(F.transform(
               F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids")))
    return counts.join(top, ["path", "name"]).withColumn("more", F.greatest(F.col("n_chunks") - shown, F.lit(0)))


def _share(a: set, b: set) -> float:
    small = min(len(a), len(b))
    return len(a & b) / small if small else 0.0


class _Block:
    """Running facts of a block while it grows."""

    def __init__(self, row):
        self.first_id, self.low, self.high = row.first_id, row.low, row.high
        self.symbols, self.kinds, self.communities, self.links = (set(x) for x in (row.symbols, row.kinds, row.communities, row.links))
        self.total, self.n = row.total, int(row.n)

    def absorb(self, other: "_Block") -> None:
        self.high = other.high
        self.symbols |= other.symbols
        self.kinds |= other.kinds
        self.communities |= other.communities
        self.links |= other.links
        if other.n:
            self.total = other.total if not self.n else [x + y for x, y in zip(self.total, other.total)]
            self.n += other.n

    def may_join(self, other: "_Block") -> bool:
        head, next_head = self.first_id.split("::")[0], other.first_id.split("::")[0]
        if head != next_head and head in TOP_LEVEL_KINDS and next_head in TOP_LEVEL_KINDS:
            return False
        shared = len(self.symbols & other.symbols)
        linked = any(other.low <= x <= other.high for x in self.links) or any(self.low <= x <= self.high for x in other.links)
        if shared < MIN_SHARED and not linked:
            return False
        if self.communities & other.communities or _share(self.symbols, other.symbols) >= MERGE_SHARE:
            return True
        if self.kinds and self.kinds == other.kinds:
            return True
        if not (self.n and other.n):
            return False
        sim = sum(x * y for x, y in zip(self.total, other.total)) / (self.n * other.n)
        return sim >= (SAME_PARENT_SIM if head == next_head and head else SAME_FILE_SIM)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """The first chunk of each merged block of a file."""
    blocks = [_Block(r) for r in rows.sort_values("low").itertuples()]
    changed = True
    while changed:
        changed, out, i = False, [], 0
        while i < len(blocks):
            if i + 1 < len(blocks) and blocks[i].may_join(blocks[i + 1]):
                blocks[i].absorb(blocks[i + 1])
                changed, i, keep = True, i + 2, blocks[i]
            else:
                i, keep = i + 1, blocks[i]
            out.append(keep)
        blocks = out
    return pd.DataFrame({"path": rows["path"].iloc[0], "low": [b.low for b in blocks]})


def block_facts(blocks: DataFrame) -> DataFrame:
    """One row a block: path, low and high order, first_id, symbols, kinds, communities, total and n of vectors, links.

    Links to chunks that the path lacks are left out, so that a link meets a block if it lies between low and high.
    """
    keys = ["path", "block"]
    plain = blocks.groupBy(*keys).agg(
        F.min("chunk_ord").alias("low"), F.max("chunk_ord").alias("high"), F.min_by("chunk_id", "chunk_ord").alias("first_id"),
        F.collect_set("community").alias("communities"))

    def sets(column: str, name: str) -> DataFrame:
        each = blocks.select(*keys, F.explode(column).alias("x")).distinct()
        if column == "links":
            each = each.join(blocks.select("path", F.col("chunk_ord").alias("x")), ["path", "x"], "left_semi")
        return each.groupBy(*keys).agg(F.collect_list("x").alias(name))

    sums = embedding.group_sums(blocks.filter("embedding is not null").select(*keys, "embedding"), keys).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda s: s["total"]).alias("total"), F.max("n").alias("n"))
    for other in (sets("containing_symbols", "symbols"), sets("kinds", "kinds"), sets("links", "links"), sums):
        plain = plain.join(other, keys, "left")
    empty = {c: F.coalesce(c, F.array()) for c in ("symbols", "kinds", "links", "total")}
    return plain.withColumns({**empty, "n": F.coalesce("n", F.lit(0).cast("bigint"))}).drop("block")


FACTS = ["low", "high", "first_id", "symbols", "kinds", "communities", "total", "n", "links"]


def _may_join(a: Column, b: Column) -> Column:
    """``_Block.may_join`` as a column of two structs of facts."""
    head, next_head = F.substring_index(a["first_id"], "::", 1), F.substring_index(b["first_id"], "::", 1)
    apart = (head != next_head) & head.isin(TOP_LEVEL_KINDS) & next_head.isin(TOP_LEVEL_KINDS)
    shared = F.size(F.array_intersect(a["symbols"], b["symbols"]))

    def meets(one: Column, two: Column) -> Column:
        return F.exists(one["links"], lambda x: x.between(two["low"], two["high"]))

    small = F.least(F.size(a["symbols"]), F.size(b["symbols"]))
    alike = F.when(small > 0, shared / small).otherwise(F.lit(0.0)) >= MERGE_SHARE
    kinds = (F.size(a["kinds"]) > 0) & (F.array_sort(a["kinds"]) == F.array_sort(b["kinds"]))
    near = F.when((head == next_head) & (head != ""), F.lit(SAME_PARENT_SIM)).otherwise(F.lit(SAME_FILE_SIM))
    sim = (a["n"] > 0) & (b["n"] > 0) & (vx.dot(a["total"], b["total"]) / (a["n"] * b["n"]) >= near)
    return ~apart & ((shared >= MIN_SHARED) | meets(a, b) | meets(b, a)) & (F.arrays_overlap(a["communities"], b["communities"]) | alike | kinds | sim)


def _joined(a: Column, b: Column) -> Column:
    total = (F.when(b["n"] == 0, a["total"]).when(a["n"] == 0, b["total"])
             .otherwise(F.zip_with(a["total"], b["total"], lambda x, y: x + y)))
    both = {c: F.array_union(a[c], b[c]) for c in ("symbols", "kinds", "communities", "links")}
    made = {"low": a["low"], "high": b["high"], "first_id": a["first_id"], "total": total, "n": a["n"] + b["n"], **both}
    return F.struct(*[made[c].alias(c) for c in FACTS])


def merge_pass(rows: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """One pass from left to right over the blocks (path, low, ...) of every file, and whether it joined any.

    A block joins the next one unless the one before has taken it. In a run of blocks that may each join the next, these are
    the first, third, fifth: so the pass is windows over ranges, with no row that waits for the one before.
    """
    keys = ["path"]
    seen = rows.select("path", "low", F.struct(*FACTS).alias("facts"))
    seen = shift_value(seen, keys, "low", F.col("facts"), "after", width=width)
    seen = seen.withColumn("may", F.coalesce(F.col("after").isNotNull() & _may_join(F.col("facts"), F.col("after")), F.lit(False)))
    seen = running_sum(seen, keys, "low", F.lit(1).cast("bigint"), "nth", width)
    # where the run began: after the last block that may not join
    seen = forward_fill(seen, keys, "low", F.when(~F.col("may"), F.col("nth")), "stop", width)
    seen = seen.withColumn("takes", F.col("may") & ((F.col("nth") - F.coalesce("stop", F.lit(0)) - 1) % 2 == 0))
    seen = cut_lineage(shift_value(seen, keys, "low", F.col("takes"), "taken", back=True, width=width)
                       .select("path", "facts", "after", "takes", F.coalesce("taken", F.lit(False)).alias("taken")))
    kept = seen.filter(~F.col("taken")).select("path", F.when(F.col("takes"), _joined(F.col("facts"), F.col("after"))).otherwise(F.col("facts")).alias("facts"))
    return cut_lineage(kept.select("path", "facts.*")), not seen.filter("takes").isEmpty()


def merge_blocks(blocks: DataFrame, task_blocks: int = 10_000, width: int = ROWS_PER_RANGE) -> DataFrame:
    """Merge neighbouring blocks of a file until nothing changes: (path, chunk_ord, unit).

    Input: path, chunk_ord, chunk_id, block, containing_symbols, kinds, community, embedding, links (orders of chunks with
    an edge to this one). A block is a run of neighbours in chunk_ord, which is unique in its path.

    What merges are facts, one row a block. A file of up to ``task_blocks`` blocks is folded by one task. A larger one goes
    through passes over ranges of its blocks, which give the same blocks, until it has become small enough or stays as it is.
    """
    facts = cut_lineage(block_facts(blocks))
    done, open_ = None, facts
    while True:
        sizes = open_.groupBy("path").agg((F.count("*") <= task_blocks).alias("small"))
        sized = open_.join(sizes, "path")
        small = sized.filter("small").drop("small").groupBy("path").applyInPandas(_fold, "path string, low bigint")
        done = small if done is None else done.unionByName(small)
        large = cut_lineage(sized.filter("not small").drop("small"))
        if large.isEmpty():
            break
        open_, changed = merge_pass(large, width)
        if not changed:
            done = done.unionByName(open_.select("path", "low"))
            break
    marks = done.select("path", F.col("low").alias("chunk_ord"), F.lit(1).cast("bigint").alias("opens"))
    rows = blocks.select("path", "chunk_ord").join(marks, ["path", "chunk_ord"], "left")
    return running_sum(rows, ["path"], "chunk_ord", F.coalesce("opens", F.lit(0).cast("bigint")), "unit", width).select(
        "path", "chunk_ord", (F.col("unit") - 1).alias("unit"))
