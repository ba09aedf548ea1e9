"""The pipeline's near-duplicate stage against all pairs."""

import random

import pytest

import corpus_pipeline
from palimpsest.llm import jaccard


def classes(texts, shingle=5):
    """Brute force: doc_id to the least id over links of Jaccard similarity 0.8 or more."""

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w)} if len(w) <= shingle else {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}

    sets, label = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, set()).add(d)
    for a in sorted(sets):
        for b in {x for g in sets[a] for x in holders[g] if x > a}:
            i = len(sets[a] & sets[b])
            if 5 * i >= 4 * (len(sets[a]) + len(sets[b]) - i) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if x == hi else x for d, x in label.items()}
    return label


def made(seed, n=30):
    """Groups of edited copies of varied distance, exact copies, and a passage that most texts share."""
    rng, out = random.Random(seed), ["", None, "a", "A", "one two three"]
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(6, 200))] + (passage if rng.random() < 0.7 else [])
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return dict(enumerate(out))


def recall(got, want):
    """The share of texts with a near copy that are in one class with it; no class may join what brute force tells apart."""
    assert all(want[d] == want[c] for d, c in got.items())
    tied = [d for d, c in want.items() if d != c]
    return sum(got[d] != d for d in tied) / len(tied)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    texts = made(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert got.keys() == texts.keys() and recall(got, classes(texts)) > 0.8


def test_the_stage_keeps_one_of_each_class(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = classes({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf).select("doc_id").collect()}
    assert {d for d, c in want.items() if d == c} <= kept
    assert len(kept - set(want.values())) < 0.1 * sum(d != c for d, c in want.items())


def test_candidates_follow_the_rows(spark):
    """Near copies by the hundred and texts that share a passage: few pairs, not all."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = {d: " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(30)]) for d in range(300)}
    texts |= {1000 + d: " ".join(passage * 2 + [f"v{rng.randrange(3)}"] + [f"u{i}" for i in range(100)] + [f"z{d}"]) for d in range(300)}
    got = jaccard.candidates(jaccard.prints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert 299 <= got.count() < 20 * len(texts)
