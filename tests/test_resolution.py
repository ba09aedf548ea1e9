"""Reads, counters and merges against a model that walks the log one entry at a time."""

import random

import pytest

from palimpsest.operators import compaction, reads, resolve
from palimpsest.schema import StoreError
from palimpsest.versions import VersionTree

OPS = ["VALUE", "TOMBSTONE", "COUNTER_SET", "COUNTER_ADD"]
SCHEMA = "seq long, v long, d0 long, op string, n long, uts long"


def history(seed, ops=OPS, n=250, keys=6):
    rng, t, rows = random.Random(seed), VersionTree(), []
    t.add(1, 0, 0)
    for seq in range(n):
        leaves = [v for v in t.versions if t.is_mutable(v)]
        if rng.random() < 0.04 and len(t.versions) < 12:
            t.add(len(t.versions) + 1, rng.choice(list(t.versions)), seq)
            continue
        rows.append((seq, rng.choice(leaves), rng.randrange(keys), rng.choice(ops), rng.randrange(100), rng.randrange(60)))
    return t, rows


def seen(t, rows, q):
    up = set(t.ancestors(q))
    return [r for r in rows if r[1] in up]


def read(entries, timestamped=False):
    best = max(entries, key=lambda r: (r[5], r[0]) if timestamped else r[0], default=None)
    return None if best is None or best[3] == "TOMBSTONE" else best


def read_count(entries):
    total = 0
    for i, r in enumerate(sorted(entries, reverse=True)):
        if r[3] == "COUNTER_ADD":
            total += r[4]
        elif r[3] == "COUNTER_SET":
            return total + r[4]
        elif i == 0:
            return None if r[3] == "TOMBSTONE" else r[4]
        else:
            return total
    return total if entries else None


def views(t, rows, how, versions=None):
    out = {}
    for q in versions or t.versions:
        for k in {r[2] for r in rows}:
            x = how([r for r in seen(t, rows, q) if r[2] == k])
            if x is not None:
                out[q, k] = x
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("timestamped", [False, True])
def test_visible(spark, seed, timestamped):
    t, rows = history(seed, ["VALUE", "VALUE", "TOMBSTONE"])
    got = resolve.visible(spark.createDataFrame(rows, SCHEMA), t.frame(spark), ["d0"], timestamped=timestamped).collect()
    want = views(t, rows, lambda e: read(e, timestamped))
    assert {(r["qv"], r["d0"]): r["seq"] for r in got} == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("pieces", [1, 3, 64])
def test_counters(spark, pieces):
    t, rows = history(5)
    log = resolve.lineage(spark.createDataFrame(rows, SCHEMA), t.frame(spark))
    got = {(r["qv"], r["d0"]): r["n"] for r in resolve.count(log, ["qv", "d0"], pieces).where("op <> 'TOMBSTONE'").collect()}
    assert got == views(t, rows, read_count)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", ["plain", "timestamped", "counter"])
def test_merges_change_no_read(spark, seed, kind):
    t, rows = history(seed + 10, OPS if kind == "counter" else ["VALUE", "VALUE", "TOMBSTONE"])
    rng = random.Random(seed)
    inner = [v for v in t.versions if not t.is_mutable(v) and v != 1]
    for v in rng.sample(inner, len(inner) // 2):
        t.delete(v)
    frame, log = t.frame(spark), spark.createDataFrame(rows, SCHEMA)
    merged = compaction.merge(log, frame, ["d0"], timestamped=kind == "timestamped", counter=kind == "counter", oldest=True, now=10_000)
    assert merged.count() < log.count()
    live = [v for v in t.versions if not t.versions[v].deleted]
    if kind == "counter":
        got = {(r["qv"], r["d0"]): r["n"] for r in resolve.counters(merged, frame, ["d0"]).collect() if r["qv"] in live}
        assert got == views(t, rows, read_count, live)
    else:
        got = resolve.visible(merged, frame, ["d0"], timestamped=kind == "timestamped").collect()
        want = views(t, rows, lambda e: read(e, kind == "timestamped"), live)
        assert {(r["qv"], r["d0"]): r["seq"] for r in got if r["qv"] in live} == {k: v[0] for k, v in want.items()}


def test_partial_merge_keeps_tombstones(spark):
    t = VersionTree()
    t.add(1, 0)
    log = spark.createDataFrame([(1, 1, 0, "VALUE", 1, 0), (2, 1, 0, "TOMBSTONE", 0, 0)], SCHEMA)
    assert [r["op"] for r in compaction.merge(log, t.frame(spark), ["d0"]).collect()] == ["TOMBSTONE"]
    assert compaction.merge(log, t.frame(spark), ["d0"], oldest=True).count() == 0


def test_empty_log(spark):
    t = VersionTree()
    t.add(1, 0)
    none = spark.createDataFrame([], SCHEMA)
    assert resolve.visible(none, t.frame(spark), ["d0"]).count() == 0
    assert resolve.counters(none, t.frame(spark), ["d0"]).count() == 0
    assert compaction.merge(none, t.frame(spark), ["d0"], oldest=True).count() == 0


def test_hot_counter_folds_in_pieces(spark):
    t = VersionTree()
    t.add(1, 0)
    log = spark.range(5000).selectExpr("id as seq", "1L as v", "0L as d0", "if(id = 1000, 'COUNTER_SET', 'COUNTER_ADD') as op", "1L as n", "0L as uts")
    assert resolve.fold_pieces(log, ["d0"]).count() == 64
    assert resolve.counters(log, t.frame(spark), ["d0"]).first()["n"] == 4000


def test_point_read_pushes_its_key_into_the_scan(spark, tmp_path, capsys):
    t, rows = history(1)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/log")
    reads.get(spark.read.parquet(f"{tmp_path}/log"), t.frame(spark), 1, {"d0": 3}).explain("formatted")
    assert "EqualTo(d0,3)" in capsys.readouterr().out


def test_contiguity(spark):
    schema = "array_id long, data_age long, is_barrier boolean, merge_state string"
    arrays = spark.createDataFrame([(1, 1, False, "idle"), (2, 2, False, "idle"), (3, 3, True, "barrier"), (4, 4, False, "input"), (5, 5, False, "idle"), (6, 6, False, "idle"), (7, 7, False, "idle")], schema)
    compaction.check_contiguous(arrays, [1, 2])
    for chosen, code in (([], 101), ([9], 107), ([2, 5], 114), ([4, 5], 108), ([5, 7], 110)):
        with pytest.raises(StoreError) as e:
            compaction.check_contiguous(arrays, chosen)
        assert e.value.code == code


def test_paging_covers_all_rows(spark):
    rows = spark.createDataFrame([(i % 4, i) for i in range(23)], "a long, b long")
    got, last = [], None
    while page := reads.page(rows, ["a", "b"], 5, last).collect():
        got += [tuple(r) for r in page]
        last = list(got[-1])
    assert got == sorted((i % 4, i) for i in range(23))
