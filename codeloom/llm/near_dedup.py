"""Near-duplicate documents by a chosen-path set similarity join.

Each set of word shingles has a sketch of ``POSITIONS`` minwise tokens. A tree has ``BRANCHING`` of them for itself, starts
with all sets in one node and sends each set of a node that is too large to two children and, at every other level, to one: a
child for each token at a position chosen by the node's hash. A node whose sets agree at a share s of the positions has 2 s and
s times its rows below it, so rows do not double from level to level. Sets of similarity J part ways at a position with
probability 1 - J; no position comes twice on a way down. For J = 0.75 a tree keeps a pair together with 0.94 for one level.
``TREES`` trees, no two of which share a token, find it with 0.9999999 if its node is small after one level, 0.999 after 6 and
0.98 after 12 (simulated), which takes a group of some 60,000 sets that all agree at three quarters of the positions and are
no links. Tokens are whole at the roots and 16 bits below.

A node of up to ``NODE_SETS`` sets is one task's work: the rest of its tree is a recursion in that task, whose small nodes are
compared exhaustively by sketch. Larger nodes are split by Spark, level by level. Pairs that look similar are confirmed on full sets.

Sets, not documents, are joined: equal sets are one class. As only components are asked for, a task gives the pairs that would
join its node's sets, most alike first and fewer than the sets; where one of them is no link, all pairs of the node that look
alike and are in different components by then are compared in full. A large group of near copies is joined by comparing each
with a few pivots, and sets outside the main component are compared with all others as soon as that is little work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import byte_view, flat, groups_of, prepare
from codeloom.llm.words import mix, windows, words_of
from codeloom.operators.graph import connected_components
from codeloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 75  # percent
POSITIONS = 256
BRANCHING = 32
TREE_BITS = 4  # of a node's number: its tree, and whether it has two children
TWO_CHILDREN = np.uint64(8)
TREES = 8
NODE_SETS = 1 << 16
LEAF_SETS = 512
# a large node counts as small if its sets outside the main component times all its sets are at most so many
LEAF_PAIRS = 1 << 24
# a pair is confirmed on full sets from this many equal low bytes: 4.5 standard errors under the similarity
SKETCH_CUT = 161
PIVOTS = 4
SALTS = 64

_random = np.random.default_rng(715)
_FACTORS = _random.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has are one shingle."""
    data, offsets = byte_view(texts)
    n = len(offsets) - 1
    w = words_of(data, offsets, lower=True)
    first, hashes = windows(w.hash, w.row, SHINGLE)
    edges = np.searchsorted(w.row[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
    word_edges = np.searchsorted(w.row, np.arange(n + 1))
    out = []
    for row in range(n):
        size = int(word_edges[row + 1] - word_edges[row])
        if size >= SHINGLE:
            out.append(np.unique(hashes[edges[row]:edges[row + 1]]))
        elif size:
            _, short = windows(w.hash[word_edges[row]:word_edges[row + 1]], np.zeros(size, np.int64), size)
            out.append(mix(short + np.array([size], np.uint64) * _TWO))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set at each position."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 512):
        values = np.multiply.outer(_FACTORS, x[low:low + 512])
        values += _TERMS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _packed(least: np.ndarray, trees: int) -> bytes:
    """The low byte of each position, then the second byte of those that the trees use."""
    return least.astype(np.uint8).tobytes() + (least[:trees * BRANCHING] >> np.uint32(8)).astype(np.uint8).tobytes()


def sketch(shingles: np.ndarray, trees: int = TREES) -> bytes:
    return _packed(_least(shingles), trees)


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    return np.array([mix(shingles + _TWO).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles ^ _THREE))], "<u8").tobytes()


def sketches(docs: DataFrame, key: str, text: str, trees: int = TREES) -> DataFrame:
    """(key, n_shingles, digest, sig, roots); empty sets have neither digest nor sketch. ``roots``: the children of the roots."""
    if trees > min(POSITIONS // BRANCHING, int(TWO_CHILDREN)):
        raise ValueError(f"{POSITIONS} positions are enough for {POSITIONS // BRANCHING} trees")

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            sigs = [_least(s) if len(s) else None for s in sets]
            least = np.array([x for x in sigs if x is not None], np.uint32).reshape(-1, POSITIONS)
            nodes = np.concatenate([_root_children(t, least)[0] for t in range(trees)]).T.copy()
            roots = iter(nodes)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if x is None else _packed(x, trees) for x in sigs], pa.binary()),
                pa.array([None if x is None else next(roots).tobytes() for x in sigs], pa.binary())], names=["key", "n_shingles", "digest", "sig", "roots"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_shingles long, digest binary, sig binary, roots binary")


def _fixed(column) -> np.ndarray:
    """Rows of bytes of one length."""
    data, offsets = byte_view(column)
    return data.reshape(len(offsets) - 1, -1) if len(data) else np.zeros((len(offsets) - 1, POSITIONS), np.uint8)


def _tokens(column) -> np.ndarray:
    """The two low bytes of the positions that trees use, of each row."""
    whole = _fixed(column)
    n = whole.shape[1] - POSITIONS
    return whole[:, :n].astype(np.uint32) | whole[:, POSITIONS:].astype(np.uint32) << np.uint32(8)


def _low_bytes(column) -> np.ndarray:
    """The low byte of each position of each row."""
    return np.ascontiguousarray(_fixed(column)[:, :POSITIONS])


def _of_tree(node: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The number of a node, with its tree and number of children in the lowest bits."""
    return node >> np.uint64(TREE_BITS) << np.uint64(TREE_BITS) | kind


def root(tree: int) -> np.uint64:
    return _of_tree(mix(np.array([tree + 1], np.uint64)), np.uint64(tree) | TWO_CHILDREN)[0]


def _unused(place: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The first place from ``place`` on, in a circle, whose bit is not set; ``place`` itself if all are."""
    at = place
    for _ in range(BRANCHING):
        busy = used >> at & 1
        if not busy.any():
            return at
        at = (at + busy) % BRANCHING
    return np.where(used >> at & 1, place, at)


def _children(node: np.ndarray, used: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, child node, used) of each row's children, by tokens of the node's tree: two, or one if the node above had two.

    ``used`` has a bit for each position on the way to the node: its sets agree there, so it would split nothing again.
    """
    kind = node & np.uint64((1 << TREE_BITS) - 1)
    first = _unused((mix(node ^ _ONE) % np.uint64(BRANCHING)).astype(np.int64), used)
    second = _unused((mix(node ^ _THREE) % np.uint64(BRANCHING)).astype(np.int64), used | np.left_shift(1, first))
    row = np.concatenate([np.arange(len(node)), np.flatnonzero(kind & TWO_CHILDREN)])
    place = np.concatenate([first, second[row[len(node):]]])
    used = used[row] | np.left_shift(1, place)
    place += (kind & ~TWO_CHILDREN).astype(np.int64)[row] * BRANCHING
    child = mix(node[row] * _ONE + place.astype(np.uint64) * _TWO + sig[row, place].astype(np.uint64) * _THREE)
    return row, _of_tree(child, kind[row] ^ TWO_CHILDREN), used


def _root_children(tree: int, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, used) of the children of a root, the first one of all rows, then the second one."""
    n = len(sig)
    _, nodes, used = _children(np.full(n, root(tree)), np.zeros(n, np.int64), sig)
    return nodes.reshape(-1, n), used.reshape(-1, n)


def first_nodes(reps: DataFrame, trees: int) -> DataFrame:
    """(node, used, rep): the children of the roots."""
    # which positions the roots' children have used is the same for all sets
    used = np.concatenate([_root_children(t, np.zeros((1, POSITIONS), np.uint32))[1][:, 0] for t in range(trees)])

    def run(batches):
        for batch in batches:
            data, _ = byte_view(batch.column("roots"))
            nodes = np.frombuffer(data.tobytes(), np.int64)
            rep = batch.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.tile(used, len(rep))), pa.array(np.repeat(rep, len(used)))],
                                             names=["node", "used", "rep"])

    return reps.select("rep", "roots").mapInArrow(run, "node long, used long, rep long")


def next_nodes(rows: DataFrame) -> DataFrame:
    """(node, used, rep): the children of the nodes of (node, used, rep, sig)."""
    def run(batches):
        for batch in batches:
            row, nodes, used = _children(batch.column("node").to_numpy().view(np.uint64), batch.column("used").to_numpy(), _tokens(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(used), batch.column("rep").take(pa.array(row))],
                                             names=["node", "used", "rep"])

    return rows.select("node", "used", "rep", "sig").mapInArrow(run, "node long, used long, rep long")


def _candidates(label: np.ndarray, sig: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal positions) of the pairs of a node whose sketches are alike and whose labels differ."""
    _, number, uses = np.unique(label, return_inverse=True, return_counts=True)
    main = uses.argmax() if uses.max() > 1 else -1
    found = [(np.zeros(0, np.int64),) * 3]
    for a in np.flatnonzero(number != main).tolist():
        equal = (sig == sig[a]).sum(axis=1)
        others = np.flatnonzero((equal >= cut) & (number != number[a]))
        others = others[(others > a) | (number[others] == main)]  # a pair of two outsiders is found at the first of them
        found.append((np.full(len(others), a), others, equal[others]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray, alike: np.ndarray, linked) -> list[int]:
    """Numbers of the pairs, most alike first, that join two components not joined before; ``linked(a, b)`` may refuse."""
    parent = {x: x for x in label.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept, left = [], len(parent) - 1
    for k in np.argsort(-alike, kind="stable").tolist():
        x, y = root(int(label[a[k]])), root(int(label[b[k]]))
        if x != y and linked(a[k], b[k]):
            parent[x] = y
            kept.append(k)
            left -= 1
            if not left:
                break
    return kept


class _Joined:
    """Components of the labels of a node, as far as pairs found so far join them."""

    def __init__(self, label: np.ndarray):
        _, self.label = np.unique(label, return_inverse=True)
        self.parent = np.arange(int(self.label.max()) + 1 if len(label) else 0)

    def of(self, at: np.ndarray) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent[self.label[at]]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(self.label[a].tolist(), self.label[b].tolist(), strict=True):
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            self.parent[max(x, y)] = min(x, y)


def node_candidates(node: int, used: int, label: np.ndarray, sig: np.ndarray, tokens: np.ndarray, cut: int, leaf: tuple[int, int],
                    guess: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal positions) of the pairs in the tree below a node whose sketches are alike and whose labels differ.

    With ``guess``, pairs found count as links at once: a few pivots join most of a large group, and pairs inside what is
    joined already are left out. Without, all pairs come that the tree brings together.
    """
    leaf_sets, leaf_pairs = leaf
    joined, found = _Joined(label), [(np.zeros(0, np.int64),) * 3]
    stack = [(np.uint64(node), used, np.arange(len(label)))]

    def keep(a, b, alike):
        found.append((np.minimum(a, b), np.maximum(a, b), alike))
        if guess:
            joined.join(a, b)

    while stack:
        node, used, at = stack.pop()
        here = joined.of(at)
        uses = np.bincount(np.unique(here, return_inverse=True)[1])
        if guess and len(uses) > 1 and len(at) > leaf_sets:
            pivots = at[np.argsort(mix(at.astype(np.uint64) + node), kind="stable")[:PIVOTS]]
            for p in pivots.tolist():
                equal = (sig[at] == sig[p]).sum(axis=1)
                like = np.flatnonzero((equal >= cut) & (joined.of(at) != joined.of(np.array([p]))))
                keep(at[like], np.full(len(like), p), equal[like])
            here = joined.of(at)
            uses = np.bincount(np.unique(here, return_inverse=True)[1])
        if len(uses) < 2:
            continue
        if len(at) <= leaf_sets or (len(at) - max(int(uses.max()), 1)) * len(at) <= leaf_pairs:
            a, b, alike = _candidates(here, sig[at], cut)
            keep(at[a], at[b], alike)
            continue
        row, child, gone = _children(np.full(len(at), node), np.full(len(at), used), tokens[at])
        order = np.argsort(child, kind="stable")
        row, child, gone = row[order], child[order], gone[order]
        edges = np.concatenate([[0], np.flatnonzero(child[1:] != child[:-1]) + 1, [len(child)]])
        stack.extend((child[x], int(gone[x]), at[row[x:y]]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if y - x > 1)
    a, b, alike = (np.concatenate([f[k] for f in found]) for k in range(3))
    first = np.unique(a * len(label) + b, return_index=True)[1]
    return a[first], b[first], alike[first]


def _nodes(batches, *columns: str) -> Iterator[tuple]:
    """Arrays of each node's rows: its number and used positions, the columns, low bytes and tokens of the sketches."""
    for table in groups_of(batches, "node"):
        node = table.column("node").to_numpy()
        low, tokens = _low_bytes(table.column("sig")), _tokens(table.column("sig"))
        values = [table.column(c).to_numpy() for c in columns]
        edges = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        # most nodes have two rows, and most of those are not alike
        two = edges[:-1][np.diff(edges) == 2]
        dull = set(two[(low[two] == low[two + 1]).sum(axis=1) < POSITIONS // 4].tolist())
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a not in dull:
                yield table, a, (int(node[a:a + 1].view(np.uint64)[0]), int(table.column("used")[a].as_py())), *(v[a:b] for v in values), low[a:b], tokens[a:b]


def _together(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("node", "used", "rep", "label", "sig", *columns).repartition("node").sortWithinPartitions("node")


def _ordered(x: np.ndarray, y: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())]


def forest_pairs(rows: DataFrame, cut: int, leaf: tuple[int, int]) -> DataFrame:
    """(node, p, m): the most similar pairs by sketch that would join all components of a node, fewer than the node's sets."""
    def run(batches):
        for _, _, node, rep, label, low, tokens in _nodes(batches, "rep", "label"):
            a, b, alike = node_candidates(*node, label, low, tokens, cut, leaf, guess=True)
            kept = _join_labels(label, a, b, alike, lambda x, y: True)
            if kept:
                number = np.full(len(kept), node[0], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), *_ordered(rep[a[kept]], rep[b[kept]])], names=["node", "p", "m"])

    return _together(rows).mapInArrow(run, "node long, p long, m long")


def open_rows(rows: DataFrame, cut: int, leaf: tuple[int, int]) -> DataFrame:
    """(node, used, rep, label) of the sets that look like a set of another component in their node. Sets that no such pairs
    connect are told apart by ``node``, so that what is compared together is no more than it has to be."""
    def run(batches):
        for table, start, node, label, low, tokens in _nodes(batches, "label"):
            a, b, _ = node_candidates(*node, label, low, tokens, cut, leaf, guess=False)
            if len(a):
                at = np.union1d(a, b)
                groups = _Joined(np.arange(len(label)))
                groups.join(a, b)
                number = mix(np.uint64(node[0]) + groups.of(at).astype(np.uint64) * _TWO).view(np.int64)
                part = table.select(["rep", "label"]).take(pa.array(at + start)).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(at), node[1])), flat(part.column("rep")), flat(part.column("label"))],
                                                 names=["node", "used", "rep", "label"])

    return _together(rows).mapInArrow(run, "node long, used long, rep long, label long")


def exact_links(rows: DataFrame, cut: int, similarity: int, held_shingles: int = 1 << 22) -> DataFrame:
    """(p, m) confirmed in place for rows (node, rep, label, sig, text): full sets are compared for all pairs
    that look alike, most alike first, unless their components have met by then. Only links come out, fewer than sets."""
    def run(batches):
        for table, start, _, rep, label, low, _ in _nodes(batches, "rep", "label"):
            a, b, alike = _candidates(label, low, cut)
            texts, sets, held = flat(table.column("text")), {}, 0

            def shingles(k):
                nonlocal held
                if k not in sets:
                    if held > held_shingles:
                        sets.clear()
                        held = 0
                    sets[k] = shingle_sets(texts.slice(start + int(k), 1))[0]
                    held += len(sets[k])
                return sets[k]

            kept = _join_labels(label, a, b, alike, lambda x, y: _linked(shingles(x), shingles(y), similarity))
            yield pa.RecordBatch.from_arrays(_ordered(rep[a[kept]], rep[b[kept]]), names=["p", "m"])

    return _together(rows, "text").mapInArrow(run, "p long, m long")


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= similarity * (len(a) + len(b) - both)


def star_pairs(rows: DataFrame, reps: DataFrame, cut: int) -> DataFrame:
    """(p, m) from large nodes: each set with the most similar of a few pivots of its node."""
    picked = rows.groupBy("node").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), F.col("rep"))).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = picked.select("node", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.rep") for k in range(PIVOTS)]))).alias("rep"))
    pivots = pivots.join(reps.select("rep", "sig"), "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "sig")).alias("pivots"))

    def run(batches):
        for batch in batches:
            rep, sig = batch.column("rep").to_numpy(), _low_bytes(batch.column("sig"))
            found = batch.column("pivots")
            edges, each = found.offsets.to_numpy() - found.offsets[0].as_py(), found.flatten()
            row = np.repeat(np.arange(len(rep)), np.diff(edges))
            other = each.field("rep").to_numpy()
            equal = (sig[row] == _low_bytes(each.field("sig"))).sum(axis=1)
            equal[other == rep[row]] = -1
            best = np.lexsort((other, -equal, row))
            best = best[np.unique(row[best], return_index=True)[1]]
            best = best[equal[best] >= cut]
            p, m = np.minimum(other[best], rep[row[best]]), np.maximum(other[best], rep[row[best]])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(m)], names=["p", "m"])

    return rows.join(cut_lineage(pivots), "node").select("rep", "sig", "pivots").mapInArrow(run, "p long, m long")


def confirm(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """(p, m, linked) from full shingle sets.

    ``texts`` (id, text) is bucketed by id, so it is not shuffled. A document may be the ``p`` of very many pairs: its text
    goes to one of SALTS places for each hash of ``m``, and never to more places than it has pairs.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int"))
    left = salted.select("p", "salt").distinct().join(texts.select(F.col("id").alias("p"), F.col("text").alias("p_text")), "p")
    right = salted.join(texts.select(F.col("id").alias("m"), F.col("text").alias("m_text")), "m")

    def run(batches):
        for batch in batches:
            one, two = shingle_sets(batch.column("p_text")), shingle_sets(batch.column("m_text"))
            linked = [_linked(a, b, similarity) for a, b in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("m"), pa.array(linked, pa.bool_())], names=["p", "m", "linked"])

    return right.join(left, ["p", "salt"]).select("p", "m", "p_text", "m_text").mapInArrow(run, "p long, m long, linked boolean")


def _mixed(rows: DataFrame, labels: DataFrame | None, node_sets: int) -> DataFrame:
    """(node, used, rep, label, small) of the nodes with sets of several components."""
    if labels is None:
        rows = rows.select("node", "used", "rep", F.col("rep").alias("label"))
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.count("*").alias("labels"))
    else:
        rows = cut_lineage(rows.select("node", "used", "rep").join(labels, "rep", "left").select("node", "used", "rep", F.coalesce("label", "rep").alias("label")))
        stats = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
    stats = stats.filter("labels > 1").select("node", (F.col("n") <= node_sets).alias("small"))
    return cut_lineage(rows.join(stats, "node").select("node", "used", "rep", "label", "small"))


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY, trees: int = TREES,
                 node_sets: int = NODE_SETS, leaf_sets: int = LEAF_SETS, leaf_pairs: int = LEAF_PAIRS, sketch_cut: int = SKETCH_CUT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Linked are sets with 100 * intersection >= similarity * union; ``component_id`` is the smallest key reachable, and the
    row with that key is kept. Null and empty texts have no shingles and stay alone. Rows without key can't be named by
    links: they stay alone, component null, and are kept. Rows that repeat a key are one document and say the same. An empty
    table gives an empty result; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    made = cut_lineage(sketches(docs, key, text, trees))
    sets = made.filter(F.col("key").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut_lineage(sets.groupBy("digest").agg(F.min("key").alias("rep"), F.min_by(F.struct("sig", "roots"), "key").alias("s"))
                          .select("digest", "rep", "s.*"))
    members = made.select("key", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    labels = _links(spark, docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), classes.select("rep", "sig", "roots"),
                    trees, similarity, node_sets, (leaf_sets, leaf_pairs), sketch_cut)
    found = members.join(labels, "rep", "left") if labels is not None else members.withColumn("label", F.lit(None).cast("long"))
    component = F.when(F.col("key").isNotNull(), F.coalesce("label", "rep", "key"))
    return found.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                        (F.col("key").isNull() | (F.col("key") == component)).alias("kept"))


def _links(spark, docs: DataFrame, reps: DataFrame, trees: int, similarity: int, node_sets: int, leaf: tuple[int, int], cut: int) -> DataFrame | None:
    """(rep, label) of the classes that have links; None if there are none."""
    rows, labels = first_nodes(reps, trees), None
    sigs = reps.select("rep", "sig")
    low = reps.select("rep", F.substring("sig", 1, POSITIONS).alias("sig"))
    table = f"near_dedup_{uuid.uuid4().hex}"
    texts = None

    def joined(found: DataFrame) -> DataFrame | None:
        new = cut_lineage(found.select(F.col("p").alias("src"), F.col("m").alias("dst")).distinct())
        if new.isEmpty():
            return labels
        known = labels.select(F.col("rep").alias("src"), F.col("label").alias("dst")) if labels is not None else new.limit(0)
        return cut_lineage(connected_components(new.unionByName(known)).select(F.col("node").alias("rep"), F.col("component").alias("label")))

    try:
        while True:
            here = _mixed(rows, labels, node_sets)
            if texts is None:
                # every later node holds only sets of these nodes
                ids = here.select(F.col("rep").alias("id")).distinct()
                buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
                (docs.join(ids, "id", "left_semi").repartition(buckets, "id").write.bucketBy(buckets, "id").saveAsTable(table))
                texts = spark.table(table)
            small, large = here.filter("small"), here.filter("not small")
            has_large = not large.isEmpty()
            pairs = forest_pairs(small.join(sigs, "rep"), cut, leaf)
            if has_large:
                pairs = pairs.unionByName(star_pairs(large.join(low, "rep"), low, cut).select(F.lit(None).cast("long").alias("node"), "p", "m"))
            pairs = cut_lineage(pairs)
            tested = cut_lineage(confirm(pairs.select("p", "m").distinct(), texts, similarity))
            labels = joined(tested.filter("linked"))
            # where a pair of the forest is no link, the node's sets may be joined by others
            failed = cut_lineage(pairs.join(tested.filter("not linked"), ["p", "m"], "left_semi").filter("node is not null").select("node").distinct())
            if not failed.isEmpty():
                again = _mixed(small.join(failed, "node", "left_semi").select("node", "used", "rep"), labels, node_sets)
                open_ = cut_lineage(open_rows(again.join(sigs, "rep"), cut, leaf))
                found = exact_links(open_.join(low, "rep").join(texts, open_["rep"] == texts["id"]), cut, similarity)
                labels = joined(found)
            if not has_large:
                return labels
            # sets of large nodes that are in one component by now are done
            rows = cut_lineage(next_nodes(_mixed(large.select("node", "used", "rep"), labels, node_sets).join(sigs, "rep")))
            if rows.isEmpty():
                return labels
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns. Rows without key stay. Of rows that repeat a kept
    key and its text one stays; rows of one key with different texts are one document to the links, and each of its texts stays once."""
    from pyspark.sql import Window

    found = near_classes(docs, key=key, text=text, **options).filter("kept").select(F.col(key).alias("kept_id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("kept_id"),
                        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    joined = whole.join(cut_lineage(found.filter("kept_id is not null")), "kept_id")
    first = joined.withColumn("copy", F.row_number().over(Window.partitionBy("kept_id", "digest").orderBy("kept_id"))).filter("copy = 1")
    return first.select("row.*").unionByName(whole.filter("kept_id is null").select("row.*"))
