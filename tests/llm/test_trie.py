"""The trie join of op9, from single cells to the classes of all documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.trie import TrieJoin, digests, majority
from tests.llm.test_operators import cluster, components


def group(c):
    return {frozenset(x for x in c if c[x] == r) for r in set(c.values())}


@pytest.mark.parametrize("cell_rows", [200_000, 60])
@pytest.mark.parametrize("seed", range(2))
def test_edges_against_all_pairs(spark, seed, cell_rows):
    fps = cluster(seed)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), cell_rows=cell_rows).collect()
    back = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges]
    assert all((a ^ b).bit_count() < 64 for a, b in back)
    assert group(components(back, fps)) == group(components(links, fps))


def test_a_hot_cell_goes_deeper(spark):
    """Thousands of fingerprints around one centre: cells split, and nothing is lost."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(3000)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    whole, split = (simhash.cells(df, cell_rows=n) for n in (10**6, 400))
    assert split.agg(F.max("depth")).first()[0] > whole.agg(F.max("depth")).first()[0]
    edges = [(r["a"], r["b"]) for r in simhash.near_edges(df, cell_rows=400).collect()]
    assert len(group(components(edges, [r[0] for r in df.collect()]))) == 1


def test_all_pairs_of_nodes_in_one_trie():
    fps = np.array(cluster(7), np.uint64)
    join, n = TrieJoin(fps, 4, np.zeros(0, int) if not len(fps) else np.arange(len(fps))), len(fps)
    found = {(int(a), int(b)) for i, j in join.walk(0, np.array([[0], [n], [0], [n], [0]]), lambda _: 4) for a, b in zip(i, j)}
    assert found == {(a, b) for a in range(n) for b in range(a + 1, n) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert join.expanded > 100


def test_one_large_node():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)

    def labels(u):
        join = TrieJoin(u, 4)
        for i, j in join.walk(0, np.array([[0], [len(u)], [0], [len(u)], [0]]), lambda _: 4):
            join.tie(i, j)
        return join.label.tolist()

    near = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 2), dtype=np.uint64), axis=1))
    assert len(set(labels(near))) == 1
    apart = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    assert len(set(labels(apart))) == len(apart)


def test_the_trie_does_the_pruning_at_sf01(spark):
    """Node pairs are expanded on real data, and far fewer row pairs are compared than there are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = spark.createDataFrame([(r[0],) for r in simhash.fingerprints(docs).select("fp").distinct().collect()], "fp long")
    rows = simhash.cells(fps).collect()
    rows = np.array(sorted((r["trie"], r["depth"], r["lo"], r["x"], r["turned"] % (1 << 64)) for r in rows), object).T
    data = np.stack([rows[i].astype(np.int64) for i in range(4)] + [rows[4].astype(np.uint64).view(np.int64)])
    _, join = simhash.join_cells(data, 4)
    assert join.expanded > 10_000


def test_components_of_the_query_are_those_of_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: majority(digests(t.encode() if t else None, 4)) for d, t in texts.items()}
    ids = sorted(fp)
    links = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = components(links, ids)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf).collect()}
    assert got == {d: (fp[d], want[d]) for d in ids}


def test_components_of_a_long_chain(spark):
    """Many rounds, one after the other: plans must not grow from round to round."""
    from palimpsest.llm.components import connected_components

    rng, ids = random.Random(1), list(range(3000))
    rng.shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    for _ in range(2):
        got = connected_components(edges)
        assert got.agg(F.max("component"), F.count("*")).first()[:] == (0, 3000)
        edges = edges.union(got.select(F.col("node").alias("a"), F.col("component").alias("b")))
