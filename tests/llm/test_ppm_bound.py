"""The bound of the broadcast trie changes no score of op10."""

import pytest

from palimpsest.llm import ppm


def test_bounded_trie_scores_as_the_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(1000, None), (1001, "never seen before: zq ☃"), (1002, "\x00\x01")], "doc_id long, text string"))
    train = docs.where("doc_id < 20")
    trie = ppm.Trie()
    for r in train.collect():
        trie.learn(r["text"].encode().lower())
    texts = {r["doc_id"]: (r["text"] or "").encode().lower() for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, train, pairs=3000).collect()}
    some = sorted(texts, key=lambda d: len(texts[d]))[:12] + [1000, 1001, 1002]
    assert got.keys() == texts.keys()
    assert [got[d] for d in some] == pytest.approx([trie.score(texts[d], learn=False) for d in some], abs=1e-3)
