"""SimHash near-duplicates through a binary trie self-join.

The join runs over three tries, each on the fingerprints turned so that another
third of the bits leads. Two fingerprints within ``bits`` have a third in which at
most a third of these differ, so that trie keeps a tight budget over its leading
bits and the whole budget below. A pair of nodes at some depth is a cell, and a
task's work: a row goes to the cell of its own node and to those of the nodes
that the budget allows beside it. Cells of too many rows go deeper, which takes
them apart as the join itself does, until they fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, slices, staged, without_keys
from palimpsest.llm.components import connected_components
from palimpsest.llm.trie import TrieJoin, digests, majority
from palimpsest.workers import map_batches

#: Words in a shingle and differing bits allowed.
SHINGLE, BITS = 4, 4
#: Tries; the leading bits of each that keep the tight budget.
TRIES = 3
LEADING = 64 // TRIES
#: Rows of a trie node at the depth where the join is dealt out, the least depth, and rows of one cell that one task joins.
NODE_ROWS, LEAST_DEPTH, CELL_ROWS = 8192, 4, 200_000
#: Levels that a cell too large is taken down at once, and the last level for that.
STEP, DEEPEST = 4, 60


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text given as UTF-8; zero without words."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row a document, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, fp long")


def budget(depth: int, bits: int) -> int:
    """Bits that may differ among the first ``depth`` of a trie."""
    return bits // TRIES if depth <= LEADING else bits


def turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _back(turned: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(by == 0, turned, (turned >> by) | (turned << (np.uint64(64) - by) % np.uint64(64)))


def _deeper(rows: DataFrame, depth: int, step: int, bits: int) -> DataFrame:
    """Rows (trie, turned, lo, x) of the cells ``step`` levels below those at ``depth``.

    A cell is the lesser prefix lo of its two nodes and the bits x in which they differ.
    """
    below, allowed = depth + step, budget(depth + step, bits)
    masks = [sum(1 << b for b in c) for n in range(min(allowed, step) + 1) for c in combinations(range(step), n)]
    rows = rows.select("trie", "turned", "x", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("m"))
    rows = rows.where(F.bit_count("x") + F.bit_count("m") <= allowed)
    x = F.shiftleft("x", step).bitwiseOR(F.col("m"))
    own = F.shiftrightunsigned("turned", 64 - below)
    return rows.select("trie", "turned", F.least(own, own.bitwiseXOR(x)).alias("lo"), x.alias("x"))


def cells(fps: DataFrame, bits: int = BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(trie, depth, lo, x, turned): the rows of every cell of the join."""
    n = fps.count()
    depth = min(LEADING, max(LEAST_DEPTH, (n // NODE_ROWS).bit_length()))
    turns = F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), turned(F.col("fp"), LEADING * t).alias("turned")) for t in range(TRIES))))
    rows = _deeper(fps.select(turns.alias("r")).select("r.trie", "r.turned", F.lit(0).cast("long").alias("x")), 0, depth, bits)
    by, fit = ["trie", "lo", "x"], []
    while True:
        cell = rows.select("trie", F.lit(depth).alias("depth"), "lo", "x", "turned")
        node = F.shiftrightunsigned("turned", 64 - depth)
        large = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ((F.col("x") == 0) | (F.min(node) < F.max(node))).alias("met")).where(F.col("n") > cell_rows))
        if depth >= DEEPEST or large.isEmpty():
            return reduce(DataFrame.unionByName, [*fit, cell])
        fit.append(cell.join(large.select(*by), by, "left_anti").select(cell.columns))
        # a large cell in which only one of the nodes has rows holds no pair
        rows = _deeper(rows.join(large.where("met").select(*by), by, "left_semi"), depth, STEP, bits)
        depth += STEP


def join_cells(rows: np.ndarray, bits: int, nearest: bool = False) -> tuple[np.ndarray, TrieJoin]:
    """Join rows (trie, depth, lo, x, turned), sorted by all; the pairs of rows tied, as (2, n), and the join.

    The pairs are stars, or with ``nearest`` the nearest pairs that tie as much.
    """
    trie, depth, lo, x, turned = rows
    u = turned.view(np.uint64)
    join, found = TrieJoin(u, bits), [np.empty((2, 0), np.int64)]
    new = np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)] if len(u) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(u)] if len(first) else first
    # rows of a cell sort by fingerprint, so those of its lesser node come first
    own = (u >> (64 - depth).astype(np.uint64)).view(np.int64) if len(u) else lo
    lower = np.r_[0, np.cumsum(own == lo)]
    middle = first + lower[last] - lower[first]
    for d in np.unique(depth[first]).tolist():
        at = depth[first] == d
        a0, am, a1 = first[at], middle[at], last[at]
        alone = x[a0] == 0
        pairs = np.stack([a0, np.where(alone, a1, am), np.where(alone, a0, am), a1, np.bitwise_count(x[a0]).astype(np.int64)])
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])]
        for i, j in join.walk(d, pairs, lambda k: budget(k, bits)):
            if nearest:
                found.append(np.stack(join.nearest(i, j)))
            else:
                join.tie(i, j)
    if nearest:
        return np.concatenate(found, axis=1), join
    tied = np.flatnonzero(join.label != np.arange(len(u)))
    return np.stack([tied, join.label[tied]]), join


def near_edges(fps: DataFrame, bits: int = BITS, cell_rows: int = CELL_ROWS, nearest: bool = False) -> DataFrame:
    """Edges (a, b) that tie together all distinct fingerprints within ``bits``.

    ``fps`` holds distinct signed fingerprints in column fp. Each cell returns a
    star for each of its linked sets, or with ``nearest`` the nearest pairs that tie
    the set, not all pairs: no connection is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
            if (kept[0][:4, 0] == kept[-1][:4, -1]).all():
                continue  # perhaps one long cell: go on gathering it
            rows = np.concatenate(kept, axis=1)
            tail = int(np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))[-1]) + 1
            yield edges_of(rows[:, :tail])
            kept = [rows[:, tail:]]
        if kept:
            yield edges_of(np.concatenate(kept, axis=1))

    def edges_of(rows: np.ndarray) -> pa.RecordBatch:
        (i, j), _ = join_cells(rows, bits, nearest)
        back = (LEADING * rows[0][i]).astype(np.uint64)
        a, b = (_back(rows[4][k].view(np.uint64), back).view(np.int64) for k in (i, j))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    by = ["trie", "depth", "lo", "x"]
    # the sign bit is turned for sorting, so that rows come in unsigned order
    unsigned = F.col("turned").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return map_batches(cells(fps, bits, cell_rows).repartition(*by).sortWithinPartitions(*by, unsigned).select(*by, "turned"), run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): every document with its near-duplicate class.

    component_id is the least doc_id reachable over links of at most ``bits``
    differing bits. A null or empty text has fingerprint zero and links like any
    other; rows with a null doc_id keep it and never name a class unless all of
    the class lack one; repeated rows each come back; columns other than doc_id
    and text are not read; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    classes = named(first, connected_components(near_edges(first.select("fp"), bits)), "fp")
    return prints.join(classes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def named(nodes: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """(node, root, component_id) of all ``nodes`` (node, least_id), given the components (node, component) of those with links."""
    labels = labels.withColumnRenamed("node", node)
    tied = cut(nodes.join(labels, node, "left").select(node, "least_id", F.coalesce("component", node).alias("root")))
    # written out, so that the join below deals both sides anew and may split a large class
    least = cut(tied.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return tied.join(least, "root").select(node, "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: the least doc_id of each.

    Classes are those of ``jaccard.near_duplicates``: the trie join finds texts
    whose fingerprints of five-word shingles are near, and their whole shingle
    sets, at least four fifths alike, decide. All columns stay as they are. Where
    different texts share a doc_id each counts for itself; of rows that repeat
    doc_id and text one stays. Rows with a null doc_id stay.
    """
    from palimpsest.llm import jaccard

    rows = jaccard.near_duplicates(docs)
    # several texts under the id of their class: the least hash stands for them
    stands = rows.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("n"))
    shared = cut(stands.where("n > 1"))
    gone = rows.where("doc_id <> component_id").select("doc_id", "text_hash")
    if shared.isEmpty():
        return without_keys(docs, gone)
    again = rows.where("doc_id = component_id").join(shared.select("doc_id", "root", F.col("text_hash").alias("kept")), ["doc_id", "root"])
    kept = without_keys(docs, gone.union(again.where("text_hash <> kept").select("doc_id", "text_hash")))
    repeated = cut(again.where("text_hash = kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return kept
    keyed = kept.withColumn("__text_hash", F.xxhash64("text"))
    many = repeated.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"))
    on = (keyed["doc_id"] == F.col("__doc_id")) & (keyed["__text_hash"] == F.col("__hash"))
    one = keyed.join(many, on, "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return keyed.join(many, on, "left_anti").unionByName(one).select(docs.columns)
