"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in vectorised numpy on the executors. The trees are grown
on the driver from a bounded sample of labelled rows (``max_train``, chosen by a hash of the id),
flattened into arrays as complete binary trees, and every document walks all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import blocks, hash_runs, mapped, mix, runs

#: Bound on the labelled rows that the trees are grown from.
MAX_TRAIN = 12_000
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 new line, 6 sentence mark, 7 symbol, 8 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 1, 2, 3, 4, 5
_KIND[[ord(c) for c in ".,;:?"]], _KIND[[ord(c) for c in "!#$%&*|~^_=+<>{}[]\\@/"]], _KIND[128:] = 6, 7, 8
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

FEATURES = ["log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "line_ends", "marks", "symbols", "beyond_ascii", "upper_words", "symbol_words", "short_words", "long_words", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs", "log_lines", "line_words", "repeated_lines", "empty_lines", "marks_a_word"]


def _counts(flags: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=flags, minlength=n)


def _distinct(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, for each slice between ``cuts``."""
    n = len(cuts) - 1
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    h = hashes.copy()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cuts[:-1][cuts[:-1] < len(h)]] = True
    at = np.flatnonzero(new)
    rows = np.searchsorted(cuts, at, side="right") - 1
    most = np.zeros(n)
    np.maximum.at(most, rows, np.diff(np.append(at, len(h))))
    return np.bincount(rows, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a block; all zero for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    starts, ends, rows = runs(~_BLANK[data], offsets)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(cuts).astype(float)
    per, word = np.maximum(size, 1), np.maximum(words, 1)

    sums = {}
    for k in (1, 2, 3, 4, 5, 6, 7, 8):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        sums[k] = total
    share = {k: (t[offsets[1:]] - t[offsets[:-1]]) / per for k, t in sums.items()}
    inside = {k: t[ends] - t[starts] for k, t in sums.items() if k in (1, 2, 7)}
    length = ends - starts
    hashes = hash_runs(data, starts, ends)
    distinct, top = _distinct(hashes, cuts)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    with np.errstate(over="ignore"):
        two = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)
    two_rows = rows[:-1][rows[1:] == rows[:-1]] if len(rows) > 1 else np.zeros(0, np.int64)
    two = two[rows[1:] == rows[:-1]] if len(rows) > 1 else two
    two_cuts = np.searchsorted(two_rows, np.arange(n + 1))
    pairs, _ = _distinct(two, two_cuts)

    line_start, line_end, line_rows = runs(data != 10, offsets)
    line_cuts = np.searchsorted(line_rows, np.arange(n + 1))
    lines = np.diff(line_cuts).astype(float)
    different, _ = _distinct(hash_runs(data, line_start, line_end), line_cuts)
    ends_n = sums[5][offsets[1:]] - sums[5][offsets[:-1]]

    out = np.column_stack([
        np.log1p(size), np.log1p(words), _counts(length, rows, n) / word,
        share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8],
        _counts((inside[2] > 1) & (inside[1] == 0), rows, n) / word, _counts(inside[7] > 0, rows, n) / word,
        _counts(length <= 3, rows, n) / word, _counts(length > 16, rows, n) / word,
        distinct / word, top / word, _counts(same, rows, n) / word, pairs / np.maximum(np.diff(two_cuts), 1),
        np.log1p(lines), words / np.maximum(lines, 1), 1 - different / np.maximum(lines, 1), np.maximum(ends_n + 1 - lines, 0) / (ends_n + 1), share[6] * per / word,
    ])
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """Boosted trees as flat arrays: row t of each is a complete binary tree of ``depth`` levels."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.leaf[tree, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Boost ``trees`` trees of logistic loss on histograms of at most ``bins`` quantile bins a feature."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    cell = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            g_all, h_all = np.bincount(at, grad, width), np.bincount(at, hess, width)
            best = np.full(width, 1e-3)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * bins + cell[:, f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)[:, : len(e)]
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(1)[:, : len(e)]
                n = np.bincount(key, minlength=width * bins).reshape(width, bins).cumsum(1)[:, : len(e)]
                all_n = np.bincount(at, minlength=width)
                gain = g**2 / (h + penalty) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + penalty) - (g_all**2 / (h_all + penalty))[:, None]
                gain[(n < least) | (all_n[:, None] - n < least)] = 0
                cut = gain.argmax(1)
                found = gain[np.arange(width), cut]
                for i in np.flatnonzero(found > best):
                    best[i], features[t, first + i], thresholds[t, first + i] = found[i], f, e[cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + penalty)
        raw += values[t, leaf]
    return Trees(base, depth, features, thresholds, values)


def _statistics_table(batch: pa.RecordBatch) -> np.ndarray:
    parts = [statistics(d, o) for _, d, o in blocks(batch.column("text"))]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from at most ``max_train`` labelled documents that are not held out.

    The ids with the smallest hashes are taken, so the choice doesn't depend on partitions. Null
    ids and null labels teach nothing; of repeated labels the mean decides, and of texts with one id
    that with the smallest hash. Without rows of both labels the score is one smoothed share.
    """
    ids = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def kernel(batches):
        for b in batches:
            x = _statistics_table(b).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], ["id", "quality", "x"])

    found = mapped(rows, kernel, "id string, quality int, x array<float>").toArrow().sort_by("id")
    if not found.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
    return grow(x, found["quality"].to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones, and long ones as a whole. Rows with equal or null doc_id
    stay separate rows, of which equal texts have equal scores. An empty table gives none; other
    columns are ignored. Without labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    def kernel(batches):
        for b in batches:
            score = model.value.score(_statistics_table(b).astype(np.float32).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text"), kernel, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    def kernel(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.score(_statistics_table(b).astype(np.float32).astype(float)) >= threshold))

    return mapped(docs, kernel, docs.schema)
