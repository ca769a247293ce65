"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled rows, which the driver holds as a small matrix; features and scores of all
rows are computed in tasks. The trees are flattened into arrays of (feature, bin, left, right, value), so that all rows of
a batch go down all trees at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import prepare
from codeloom.llm.text_stats import IS_DIGIT, IS_LOWER, IS_START, IS_UPPER, Stats, ends_sentence, table
from codeloom.llm.words import IS_SPACE, mix, windows

# the bound of the training sample
MAX_TRAINING_ROWS = 20_000

FEATURES = ("log_words", "word_length", "long_words", "short_words", "symbols", "bars", "exclamations", "stops", "commas", "digits",
            "upper", "lower", "other_scripts", "spaces", "distinct_words", "repeated_words", "repeated_pairs", "repeated_lines",
            "log_lines", "words_a_line", "open_lines", "capital_words")


def features(texts) -> np.ndarray:
    """A row of FEATURES for each text; only the text is looked at."""
    s = Stats(texts)
    w, data = s.words, s.data
    n, chars = np.maximum(s.n_words, 1), np.maximum(s.word_chars, 1)
    length = w.end - w.start

    def share(flags: np.ndarray) -> np.ndarray:
        return s.count(flags) / chars

    salt = w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix(w.hash + salt)
    _, first = np.unique(key, return_index=True)
    two, pair = windows(w.hash, w.row, 2)
    _, first_pair = np.unique(mix(pair + salt[two]), return_index=True)
    pairs = np.maximum(s.by_row(w.row[two]), 1)
    lines = s.lines
    n_lines = np.maximum(s.by_row(lines.row[s.line_words > 0]), 1)
    starts, ends = s.line_last
    whole = (s.line_words > 0) & ends_sentence(data, ends, starts)
    columns = [
        np.log1p(s.n_words), s.word_chars / n, s.by_row(w.row[length >= 12]) / n, s.by_row(w.row[length <= 3]) / n,
        s.n_symbols / chars, share(table(b"|")), share(table(b"!")), share(table(b".")), share(table(b",")), share(IS_DIGIT),
        share(IS_UPPER), share(IS_LOWER), share(IS_START & (np.arange(256) >= 0x80)), s.count(IS_SPACE) / chars,
        s.by_row(w.row[first]) / n, s.n_repeat_words / n, s.by_row(w.row[two[first_pair]]) / pairs, s.n_dup_lines / n_lines,
        np.log1p(s.by_row(lines.row)), s.n_words / n_lines, 1 - s.by_row(lines.row[whole]) / n_lines,
        s.by_row(w.row[IS_UPPER[data[w.start]]]) / n if len(w.row) else np.zeros(s.n),
    ]
    return np.column_stack([np.asarray(c, np.float64) for c in columns]) if s.n else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Trees as flat arrays. A leaf points at itself, so a fixed number of steps ends in leaves."""

    edges: list[np.ndarray]  # upper bin edges of each feature
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(bins[rows, self.feature[at]] <= self.bin[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        smooth: float = 1.0, min_rows: int = 5) -> Forest:
    """Boosted trees for the logistic loss. Without rows of both labels the score is the share of label 1, one half if none."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    forest = Forest(edges, *[np.zeros(0, np.int64)] * 5, np.zeros(0), depth, float(np.log(share / (1 - share))))
    parts: list[list] = [[], [], [], [], [], []]
    margin, size = np.full(len(y), forest.start), 0
    binned = forest.binned(x) if len(x) else np.zeros((0, x.shape[1]), np.uint8)
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree, leaf = _grow(binned, p - y, p * (1 - p), depth, bins, smooth, min_rows, rate)
        margin += tree[4][leaf]
        parts[0].append(size)
        for part, column, shift in zip(parts[1:], tree, (0, 0, size, size, 0), strict=True):
            part.append(column + shift)
        size += len(tree[0])
    if not size:
        return Forest(edges, np.zeros(1, np.int64), *[np.zeros(1, np.int64)] * 4, np.zeros(1), 0, forest.start)
    return Forest(edges, np.array(parts[0]), *[np.concatenate(p) for p in parts[1:]], depth, forest.start)


def _grow(binned, gradient, curve, depth, bins, smooth, min_rows, rate):
    """One tree, level by level, from histograms of gradient and curvature; (columns, leaf of each row)."""
    feature, cut, left, right, value = [0], [0], [0], [0], [0.0]
    node, width = np.zeros(len(binned), np.int64), binned.shape[1]
    value[0] = -rate * gradient.sum() / (curve.sum() + smooth)
    open_nodes = [0]
    for _ in range(depth):
        grown = []
        for parent in open_nodes:
            rows = np.flatnonzero(node == parent)
            if len(rows) < 2 * min_rows:
                continue
            cells = (binned[rows] + np.arange(width) * bins).ravel()
            sums = [np.bincount(cells, np.repeat(v[rows], width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (gradient, curve)]
            counts = np.bincount(cells, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
            g, h = gradient[rows].sum(), curve[rows].sum()
            gain = sums[0] ** 2 / (sums[1] + smooth) + (g - sums[0]) ** 2 / (h - sums[1] + smooth) - g * g / (h + smooth)
            gain[(counts < min_rows) | (len(rows) - counts < min_rows)] = -1
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-6:
                continue
            feature[parent], cut[parent] = divmod(best, bins)
            goes_left = binned[rows, feature[parent]] <= cut[parent]
            for side, members in ((left, rows[goes_left]), (right, rows[~goes_left])):
                child = len(feature)
                side[parent] = child
                for column, v in zip((feature, cut, left, right, value), (0, 0, child, child, -rate * gradient[members].sum() / (curve[members].sum() + smooth)), strict=True):
                    column.append(v)
                node[members] = child
                grown.append(child)
        open_nodes = grown
    return [np.array(c) for c in (feature, cut, left, right, value)], node


def held_out(key):
    """Rows whose key's CRC-32 leaves remainder 2 by 4 are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = MAX_TRAINING_ROWS, **options) -> Forest:
    """Fit on at most ``max_rows`` labelled rows that are not held out, those of the smallest hash of their key."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("label"))
    # at most max_rows rows of two numbers: small enough for a broadcast by its bound
    sample = known.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").select("label", "text")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.mapInArrow(run, "label double, x array<double>").limit(max_rows).toArrow()
    order = np.lexsort([np.array([hash(tuple(v)) for v in found["x"].to_pylist()], np.int64)])  # same trees however tasks end
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, found["label"].to_numpy()[order], **options)


def score(docs: DataFrame, forest: Forest, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row.

    Null and empty texts get the score of a text without words. Repeated rows are scored alike; an empty table gives an
    empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            p = forest.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(p, pa.float64()),
                                              pa.array(p >= threshold, pa.bool_()).cast(pa.int32())], names=["key", "held_out", "score", "predicted"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, forest: Forest, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            yield batch.filter(pa.array(forest.score(features(batch.column(place))) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
