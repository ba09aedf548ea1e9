"""Near-duplicates by fingerprints, decided by the Jaccard similarity of shingle sets.

Two texts are linked if their sets of five-word shingles are at least four fifths
alike. Texts with equal sets are one node. The trie join proposes pairs: texts have
three fingerprints, by different mixtures of the same shingle hashes, and a pair is
proposed where one of these is within ``BITS``. Of the pairs in a cell only those
come out that tie its rows together, nearest first, so that their number follows the
rows even where all are near. Each is then checked on the whole sets, which gives
parts of classes.

Fingerprints bound no similarity, so a prefix filter finds the links between parts
that are left: with all shingles in one order, two sets four fifths alike share one
among the first n - ceil(0.8 n) + 1 of each, and meet in its bucket. Shingles that a
sample of the texts shows often come last in that order, which keeps buckets small
and loses nothing. First each row meets a few rows of its bucket's largest part;
what these leave apart then meets every row of another part. Pairs go, before their
whole sets decide, where places or parity bits show that they cannot be alike
enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, scratch, slices, staged
from palimpsest.llm.components import connected_components
from palimpsest.llm.simhash import named, near_edges
from palimpsest.llm.trie import digests, majority
from palimpsest.workers import map_batches

SHINGLE = 5
#: Links have a similarity of at least this fraction.
ALIKE, OF = 4, 5
#: Fingerprints of a text, and bits in which one of them may differ. At the least similarity 9.7 of 64 bits differ, give or take 2.9.
PRINTS, BITS = 3, 8
#: Ids up to so many are broadcast to fetch texts.
FEW_IDS = 1_000_000
#: One id of so many is looked at for frequent shingles; from how often on they are; how many are kept.
SAMPLE, OFTEN, MOST = 16, 3, 200_000
#: Words of 64 parity bits of a set.
PARITY = 16
#: Rows of the largest part of a bucket that every other row meets first, and pairs held before they are made distinct.
HUBS, _PAIRS = 4, 1 << 18


def grams(h: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text without words has one of its own."""
    return np.unique(h.view(np.int64)) if len(h) else np.zeros(1, np.int64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes behind fingerprint ``k``; the first are those of the shingles."""
    if not k:
        return h
    x = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return x ^ (x >> np.uint64(29)) ^ (x << np.uint64(17))


def _node(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 42) - (1 << 63)


def _parity(found: np.ndarray) -> np.ndarray:
    """For each of so many bits, whether an odd number of the hashes falls on it."""
    odd = np.bincount(found & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, ``late`` ones last; sets that are alike enough share one of them."""
    last = late[np.minimum(np.searchsorted(late["key"], found), len(late) - 1)] if len(late) else np.zeros(len(found), late.dtype)
    n = np.where(last["key"] == found, last["n"], 0)
    order = np.argsort(n, kind="stable") if n.any() else slice(None)
    return found[order][: len(found) - -(-ALIKE * len(found) // OF) + 1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")


def sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, grams): the shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grams(digests(t, shingle)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "grams"])

    return map_batches(_texts(docs), run, "node long, grams array<long>")


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """(key, n) of the shingles that a sample of the texts shows often, by key. Any of them, and any n, give the same links."""
    some = sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), shingle)
    often = some.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    most = often.orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    out = np.empty(most.num_rows, [("key", np.int64), ("n", np.int64)])
    out["key"], out["n"] = (most.column(c).to_numpy() for c in ("key", "n"))
    return np.sort(out, order="key")


def prints(docs: DataFrame, shingle: int = SHINGLE, late: np.ndarray | None = None) -> DataFrame:
    """(row, doc_id, text_hash, node, fp0, fp1, .., size, prefix, parity): a row a text, its set and its fingerprints."""
    names = [f"fp{k}" for k in range(PRINTS)]
    late = np.empty(0, [("key", np.int64), ("n", np.int64)]) if late is None else late
    known = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            hashes = [digests(t, shingle) for t in batch.column(2).to_pylist()]
            fps = [np.array([majority(mixed(h, k)) for h in hashes], np.uint64).view(np.int64) for k in range(PRINTS)]
            found = [grams(h) for h in hashes]
            prefix = [_prefix(x, known.value) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(found)), pa.int64()),
                    *(batch.column(i) for i in range(2)),
                    pa.array([_node(x) for x in found], pa.int64()),
                    *map(pa.array, fps),
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())),
                    pa.array(list(map(_parity, found)), pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "text_hash", "node", *names, "size", "prefix", "parity"],
            )
            row += len(found)

    return map_batches(_texts(docs), run, f"row long, doc_id long, text_hash long, node long, {', '.join(f'{n} long' for n in names)}, size long, prefix array<long>, parity array<long>")


def candidates(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): pairs of nodes of which one fingerprint, of (node, fp0, ..), is within ``bits``."""
    found = None
    for k in range(PRINTS):
        fp = nodes.select("node", F.col(f"fp{k}").alias("fp"))
        # written out, so that the joins below deal both sides anew and may split a frequent fingerprint
        first = cut(fp.groupBy("fp").agg(F.min("node").alias("rep")))
        equal = fp.join(first, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        of = lambda side: first.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}"))  # noqa: B023, E731
        near = near_edges(first.select("fp"), bits, nearest=True).distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        pairs = equal.union(near)
        found = pairs if found is None else found.union(pairs)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of longs sorted by their first column, as arrays (columns, rows) that hold whole buckets."""
    kept: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        if kept[0][0, 0] == kept[-1][0, -1]:
            continue  # one bucket as yet
        rows = np.concatenate(kept, axis=1)
        tail = int(np.searchsorted(rows[0], rows[0, -1]))
        yield rows[:, :tail]
        kept = [rows[:, tail:]]
    if kept:
        yield np.concatenate(kept, axis=1)


def shared(prefixes: DataFrame) -> DataFrame:
    """(key, node, size, at): of the shingles in the prefixes, (node, size, prefix) once each, those that several have, and their place."""
    names = ["key", "node", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            same = rows[0, 1:] == rows[0, :-1]
            held = rows[:, np.r_[False, same] | np.r_[same, False]]
            if held.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)

    rows = prefixes.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", "size", F.col("at").cast("long").alias("at"))
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, ", ".join(f"{n} long" for n in names))


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first rows of runs, and the run of each row, given where one begins."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def _meeting(rows: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) that meet in buckets of (key, node, size, at, part), sorted by key and part."""
    n = rows.shape[1]
    first, bucket = _runs(np.r_[True, rows[0, 1:] != rows[0, :-1]])
    last = np.r_[first[1:], n]
    start, run = _runs(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[4, 1:] != rows[4, :-1])])
    length = np.diff(np.r_[start, n])
    # the largest part of each bucket
    by_length = np.lexsort((length, bucket[start]))
    main = by_length[np.r_[bucket[start][by_length][1:] != bucket[start][by_length][:-1], True]]
    from_, to = start[main], start[main] + length[main]
    other = np.flatnonzero(run != main[bucket])
    if not whole:
        for k in range(HUBS):
            # rows of other places in other buckets, so that a row meets many of a group
            at = (rows[0, other] ^ rows[1, other]).astype(np.uint64) % np.uint64(1 << 20)
            size = (to - from_)[bucket[other]]
            yield other, from_[bucket[other]] + (at.astype(np.int64) + k) % size
        return
    # every other row meets its bucket's largest part, and the parts behind its own
    for begin, end in ((from_[bucket[other]], to[bucket[other]]), ((start + length)[run[other]], last[bucket[other]])):
        count = end - begin
        for k in range(0, len(other), 1024):
            here, left = slice(k, k + 1024), count[k : k + 1024]
            for lo in range(0, int(left.max(initial=0)), 256):
                some = np.clip(left - lo, 0, 256)
                yield np.repeat(other[here], some), np.repeat(begin[here] + lo, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)


def apart(rows: DataFrame, whole: bool) -> DataFrame:
    """(a, b): pairs of nodes of different parts that share a bucket of (key, node, size, at, part) and can be alike enough.

    All of them if ``whole``, else for each row some with its bucket's largest part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rows in _buckets(batches):
            for i, j in _meeting(rows, whole):
                # in the bucket of the first shingle they share, sets share no more than what is left of either
                most = np.minimum(rows[2, i] - rows[3, i], rows[2, j] - rows[3, j])
                ok = (rows[4, i] != rows[4, j]) & ((ALIKE + OF) * most >= ALIKE * (rows[2, i] + rows[2, j]))
                a, b = rows[1, i[ok]], rows[1, j[ok]]
                if len(a):
                    held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                if sum(x.shape[1] for x in held) > _PAIRS:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    if held[0].shape[1] > _PAIRS // 2:
                        yield batch(held.pop())
        if held:
            yield batch(np.unique(np.concatenate(held, axis=1), axis=1))

    def batch(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    rows = rows.select("key", "node", "size", "at", "part")
    return map_batches(rows.repartition("key").sortWithinPartitions("key", "part"), run, "a long, b long").distinct()


def likely(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be alike enough by the parity bits of (node, size, parity).

    A shingle in only one of the sets changes one bit at most.
    """
    of = lambda side, n: bits.select(F.col("node").alias(side), F.col("size").alias(f"n{n}"), F.col("parity").alias(f"p{n}"))
    both = pairs.join(of("a", 1), "a").join(of("b", 2), "b")
    differ = F.aggregate(F.zip_with("p1", "p2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("n1") + F.col("n2")
    return both.where((ALIKE + OF) * (total - differ) >= 2 * ALIKE * total).select("a", "b")


def alike(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets, (node, grams) once each, are alike enough."""
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where((ALIKE + OF) * common >= ALIKE * (F.size("x") + F.size("y"))).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, text_hash, root, component_id): every document with an id, with its class.

    root names the class, component_id is its least doc_id (not its only name
    where different texts share an id), text_hash is xxhash64 of the text. Null
    and empty texts are alike. Rows with a null doc_id cannot be named and link nothing.
    """
    with scratch(docs.sparkSession):
        return staged(_classes(docs, shingle, bits), "classes", keep=True)


def _classes(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    texts = staged(prints(docs, shingle, frequent(docs, shingle)), "prints")
    nodes = cut(texts.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), *(F.min(f"fp{k}").alias(f"fp{k}") for k in range(PRINTS))))

    def links(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = cut(wanted.join(nodes, "node").select(F.col("least_id").alias("doc_id")).distinct())
        few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
        found = staged(sets(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), shingle).dropDuplicates(["node"]), "sets")
        return cut(alike(pairs, found))

    near = cut(candidates(nodes, bits))
    tied = links(near)
    once = texts.join(nodes.select("row"), "row", "left_semi")
    rows, parity = staged(shared(once), "buckets"), once.select("node", "size", "parity")
    for whole in (False, True):
        parts = connected_components(tied)
        named_rows = rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
        tried = cut(apart(named_rows, whole).join(near, ["a", "b"], "left_anti"))
        more = cut(likely(tried, parity))
        near, tied = near.union(tried), tied.union(links(more))
    classes = named(nodes.select("node", "least_id"), connected_components(tied), "node")
    return texts.select("doc_id", "text_hash", "node").join(classes, "node").select("doc_id", "text_hash", "root", "component_id")
