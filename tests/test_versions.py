import random

import pytest

from palimpsest.plans.fixtures import tree
from palimpsest.schema import StoreError
from palimpsest.versions import VersionTree, ancestry, health_counts, leaves, live_parents


def test_numbering_of_the_fixture():
    assert tree().numbering() == {1: (1, 8), 2: (2, 8), 3: (6, 8), 4: (3, 5), 5: (7, 8), 6: (4, 5), 7: (8, 8), 8: (5, 5)}


def grow(seed, n=30):
    rng, t = random.Random(seed), VersionTree()
    t.add(1, 0)
    for v in range(2, n):
        t.add(v, rng.choice([x for x in t.versions if not t.versions[x].deleted]))
        if rng.random() < 0.2:
            gone = rng.choice([x for x in t.versions if not t.versions[x].deleted])
            if gone != 1:
                t.delete(gone)
    return t


@pytest.mark.parametrize("seed", range(3))
def test_frames_agree_with_the_walked_tree(spark, seed):
    t = grow(seed)
    f = t.frame(spark).cache()
    assert {(r["qv"], r["v"]) for r in ancestry(f).collect()} == {(v, a) for v in t.versions for a in t.ancestors(v)}
    assert {tuple(r) for r in leaves(f).collect()} == {(v, t.is_mutable(v), t.is_leaf(v)) for v in t.versions}
    assert {tuple(r) for r in live_parents(f).collect()} == {(v, t.live_parent(v)) for v in t.versions}
    assert health_counts(f).first().asDict() == t.health()


def test_refusals():
    t = tree()
    with pytest.raises(StoreError):
        t.add(9, 77)
    t.delete(8)
    with pytest.raises(StoreError):
        t.delete(8)
    with pytest.raises(StoreError):
        t.add(9, 8)
    big = VersionTree()
    big.add(1, 0)
    for v in range(2, 201):
        big.add(v, 1)
    with pytest.raises(StoreError):
        big.add(201, 1)


def test_a_long_chain_of_deleted_versions():
    from palimpsest.versions import Version, VersionTree

    t = VersionTree({v: Version(v, v - 1, deleted=v > 1) for v in range(1, 20_001)})
    assert t.health() == {"live": 1, "deleted": 0, "dead": 19_999, "total": 20_000}
    assert t.is_leaf(1)
