"""The near-duplicate stage leaves out no link of brute force."""

import random

import numpy as np
import pytest

from palimpsest.llm import jaccard
from tests.llm.test_jaccard import classes, made


def pairs_near_the_limit(n=60, words=120):
    """Pairs of a similarity from 0.8 to 0.87, and as many a little below 0.8."""
    rng, out = random.Random(5), []
    for k in range(n):
        base = [f"a{k}x{i}" for i in range(words)]
        # one change spoils five shingles: 116 of them, so that 2 changes leave 0.84 and 3 leave 0.77
        at = rng.sample(range(10, words - 10, 12), 2 + k % 2)
        out += [" ".join(base), " ".join("other" + w if i in at else w for i, w in enumerate(base))]
    return dict(enumerate(out))


@pytest.mark.parametrize("texts", [made(1), made(2), pairs_near_the_limit()], ids=["made 1", "made 2", "limit"])
def test_every_link_counts(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert got == want and sum(d != c for d, c in want.items()) >= 20


def test_shingles_told_late_change_nothing(spark, monkeypatch):
    """Frequent shingles come last in the order; which ones the sample shows does not matter."""
    texts = made(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    assert len(jaccard.frequent(df)) > 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == want


def test_rows_of_different_parts_all_meet():
    rng = np.random.default_rng(0)
    rows = np.stack([rng.integers(0, 12, 3000), np.arange(3000), np.full(3000, 9), np.zeros(3000, int), rng.integers(0, 5, 3000) ** 2])
    rows = rows[:, np.lexsort((rows[4], rows[0]))]
    i, j = np.triu_indices(rows.shape[1], 1)
    apart = (rows[0, i] == rows[0, j]) & (rows[4, i] != rows[4, j])
    want = set(zip(i[apart].tolist(), j[apart].tolist()))
    pairs = lambda whole: {(min(p), max(p)) for a, b in jaccard._meeting(rows, whole) for p in zip(a.tolist(), b.tolist())}
    assert pairs(True) == want
    assert pairs(False) < want and len(pairs(False)) <= jaccard.HUBS * rows.shape[1]
