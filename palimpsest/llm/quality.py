"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are a fixed number of ratios and lengths. Trees are
grown on the driver from a bounded sample of labelled rows, over at most 64 bins
a feature, and flattened into arrays that numpy walks for a batch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_mod, slices
from palimpsest.workers import map_batches, ship

#: Labelled rows from which the model is fitted: about so many, whatever the input.
SAMPLE_ROWS = 12_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "stops", "exclaim", "pipe", "other_punct", "non_ascii",
    "lines_per_word", "distinct_words", "top_word", "top_five", "caps_words", "short_words", "duplicate_lines", "distinct_pairs", "distinct_fives", "ends_in_stop",
    "punct_words", "worst_window",
)

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b".,;:?", b"!", b"|", b"\"'()[]{}-_/\\+=~^`@"), 1):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 8


def statistics(text: bytes | None) -> list[float]:
    """The features of one text (UTF-8); a null text is an empty one."""
    text = text or b""
    words, n_bytes = text.split(), len(text)
    n = len(words)
    if not n:
        return [float(np.log1p(n_bytes))] + [0.0] * (len(FEATURES) - 1)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9) / n_bytes
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:]
    fives = codes[: max(0, n - 4)].copy()
    for k in range(1, 5):
        fives = fives * np.uint64(0x9E3779B97F4A7C15) ^ codes[k : n - 4 + k] if len(fives) else fives
    caps = sum(map(bytes.isupper, words))
    ends = [w[-1] for w in words]
    punct = sum(not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127) for c in ends)
    plain = sum(c in b".,;:?" for c in ends)
    # the stretch of 50 words with the fewest distinct ones
    worst = min(len(set(words[i : i + 50])) / len(words[i : i + 50]) for i in range(0, max(1, n - 25), 50))
    return [
        np.log1p(n_bytes), np.log1p(n), lengths.mean(), np.log1p(lengths.max()), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        len(lines) / n, len(counts) / n, top[0] / n, sum(top) / n, caps / n, (lengths <= 3).mean(), 1 - len(set(lines)) / len(lines),
        len(np.unique(pairs)) / max(1, len(pairs)), len(np.unique(fives)) / max(1, len(fives)), plain / n, punct / n, worst,
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Trees as flat arrays: node k of feature[k] <= threshold[k] goes left[k], else right[k]."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1. All trees and rows go down a level at a time."""
        if not len(x):
            return np.empty(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Grow trees for the logistic loss, level by level, from histograms of bins."""
    rows, width = x.shape
    if not rows:
        x, y, rows = np.zeros((1, width)), np.ones(1), 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(rows, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add() -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node_of = np.zeros(rows, np.int64)
        level = [add()]
        roots.append(level[0])
        for deep in range(depth + 1):
            n = len(level)
            open_rows = node_of >= 0
            at = node_of[open_rows]
            g_sum, h_sum = np.bincount(at, g[open_rows], n), np.bincount(at, h[open_rows], n)
            for k, node in enumerate(level):
                value[node] = float(-rate * g_sum[k] / (h_sum[k] + l2))
            if deep == depth:
                margin[open_rows] += np.array([value[node] for node in level])[at]
                break
            best = np.full(n, 1e-6)
            split = np.full((n, 2), -1)
            for f in range(width):
                cell = at * bins + binned[f][open_rows]
                gl = np.bincount(cell, g[open_rows], n * bins).reshape(n, bins).cumsum(1)
                hl = np.bincount(cell, h[open_rows], n * bins).reshape(n, bins).cumsum(1)
                cl = np.bincount(cell, minlength=n * bins).reshape(n, bins).cumsum(1)
                gain = gl**2 / (hl + l2) + (g_sum[:, None] - gl) ** 2 / (h_sum[:, None] - hl + l2) - (g_sum**2 / (h_sum + l2))[:, None]
                gain[(cl < least) | (cl[:, -1:] - cl < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                where = gain.argmax(1)
                better = gain[np.arange(n), where] > best
                best = np.where(better, gain[np.arange(n), where], best)
                split[better] = np.stack([np.full(n, f), where], 1)[better]
            nxt, child = [], np.full((n, 2), -1)
            for k, node in enumerate(level):
                if split[k, 0] >= 0:
                    feature[node], threshold[node] = int(split[k, 0]), float(cuts[split[k, 0]][split[k, 1]])
                    left[node], right[node] = add(), add()
                    child[k] = len(nxt), len(nxt) + 1
                    nxt += [left[node], right[node]]
            moved = np.full(rows, -1)
            f_of, b_of = split[at, 0], split[at, 1]
            goes_right = binned[np.maximum(f_of, 0), np.flatnonzero(open_rows)] > b_of
            moved[open_rows] = np.where(f_of >= 0, child[at, goes_right.astype(int)], -1)
            ended = open_rows.copy()
            ended[open_rows] = f_of < 0
            margin[ended] += np.array([value[node] for node in level])[node_of[ended]]
            node_of, level = moved, nxt
            if not level:
                break
    whole = lambda v: np.array(v, np.int64)
    return Forest(base, whole(roots), whole(feature), np.array(threshold), whole(left), whole(right), np.array(value), depth)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on about ``sample_rows`` labelled documents outside the held-out third.

    Rows are taken by a hash of doc_id, so the same data give the same model.
    Null labels and ids are passed over; labels other than 0 count as 1; without
    any label every document scores near one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("y")).where(F.col("y").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # the sample is bounded, and so may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = map_batches(texts.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text"), run, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score): the probability of label 1 for each whole text, a row a document.

    Null and empty texts are scored by the statistics of an empty text. Only
    doc_id and text are read, and doc_id is no feature.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(matrix(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    held_out is null for a null doc_id. Repeated rows each come back. Empty
    tables give empty results; see ``learn`` for missing labels.
    """
    return score(docs, learn(docs, labels, sample_rows)).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text):  # noqa: ANN001, ANN202  Spark would take hints for a signature
        import pandas as pd

        return pd.Series(model.value.score(matrix(text.tolist())))

    return docs.where(scored(F.col("text").cast("binary")) >= threshold)
