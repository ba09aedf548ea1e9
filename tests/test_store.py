import pytest
from pyspark.sql import functions as F

from palimpsest.schema import WRITES, StoreError
from palimpsest.sources import streamin
from palimpsest.store import Store
from palimpsest.streaming.ingest import ingest, read_log


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", clock=iter(range(1000, 10_000)).__next__)


def rows(spark, *items):
    return spark.createDataFrame([(i, [k.encode() for k in keys], v.encode(), uts) for i, (keys, v, uts) in enumerate(items)], "i long, dims array<binary>, value binary, uts long")


def content(df):
    return {tuple(bytes(d).decode() for d in r["dims"]): bytes(r["value"]).decode() for r in df.collect()}


def refused(code):
    class Check:
        def __enter__(self):
            self.raises = pytest.raises(StoreError)
            self.info = self.raises.__enter__()

        def __exit__(self, *args):
            out = self.raises.__exit__(*args)
            assert self.info.value.code == code
            return out

    return Check()


def test_write_read_snapshot_clone(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    store.put("c", rows(spark, (["a"], "1", 0), (["b"], "2", 0), (["a"], "3", 0), (["x", "y"], "4", 0)), order="i")
    assert content(store.get("c", [b"a"])) == {("a",): "3"}
    assert content(store.scan("c", [None], [None])) == {("a",): "3", ("b",): "2"}
    old = store.snapshot("c")
    assert old == root
    store.remove("c", rows(spark, (["a"], "", 0)))
    assert content(store.get("c", [b"a"])) == {}
    assert store.get("c", [b"a"], tombstones=True).count() == 1
    branch = store.clone(old)
    store.attach("d", branch)
    store.put("d", rows(spark, (["b"], "9", 0)))
    assert content(store.scan("d", [b"a"], [b"z"])) == {("a",): "3", ("b",): "9"}
    assert content(store.scan("c", [b"a"], [b"z"])) == {("b",): "2"}
    assert content(store.multi_get("d", rows(spark, (["b"], "", 0), (["q"], "", 0)))) == {("b",): "9"}
    before = content(store.scan("c", [None], [None])), content(store.scan("d", [None], [None]))
    arrays = [r["array_id"] for r in store.arrays().collect()]
    store.merge(tree, arrays)
    assert store.arrays().count() == 1
    assert (content(store.scan("c", [None], [None])), content(store.scan("d", [None], [None]))) == before
    asked = {r["name"]: (r["gets"], r["puts"], r["range_queries"]) for r in store.collections().collect()}
    assert asked == {"c": (3, 2, 4), "d": (1, 1, 3)}
    assert store.vertrees().first()["arrays"] == 1
    assert store.versions(tree).count() == 3
    assert store.events().where("cmd = 'MERGE_WORK_FINISHED'").count() == 1


def test_user_timestamps(spark, store):
    _, root = store.create_vertree()
    store.attach("t", root)
    store.put("t", rows(spark, (["k"], "new", 10)))
    store.put("t", rows(spark, (["k"], "late", 5)))
    assert content(store.get("t", [b"k"])) == {("k",): "new"}


def test_user_timestamps_only_as_asked(spark, store):
    _, root = store.create_vertree()
    store.attach("t", root)
    store.put("t", rows(spark, (["k"], "x", 10)))
    assert store.get("t", [b"k"]).first()["uts"] is None
    assert store.get("t", [b"k"], user_timestamps=True).first()["uts"] == 10
    assert store.scan("t", [None], [None], user_timestamps=True).first()["uts"] == 10
    assert store.multi_get("t", rows(spark, (["k"], "", 0)), user_timestamps=True).first()["uts"] == 10
    _, plain = store.create_vertree(timestamped=False)
    store.attach("p", plain)
    with refused("EINVAL"):
        store.get("p", [b"k"], user_timestamps=True)


def test_a_merge_counts_what_it_drops(spark, store):
    tree, root = store.create_vertree()
    store.attach("t", root)
    store.put("t", rows(spark, (["a"], "1", 50), (["b"], "1", 5)))
    store.snapshot("t")
    child = store.state()["collections"]["t"]["version"]
    store.put("t", rows(spark, (["a"], "2", 7), (["b"], "2", 9), (["b"], "3", 10)))  # a's is older than what it would hide
    dead = store.clone(root)
    store.attach("d", dead)
    store.put("d", rows(spark, (["c"], "1", 99), (["c"], "2", 100)))
    store.detach("d")
    store.delete_version(dead)
    before = content(store.scan("t", [None], [None]))
    merge = store.merge_start(tree, [r["array_id"] for r in store.arrays().collect()])
    while not store.merge_work(merge, 3):
        pass
    assert content(store.scan("t", [None], [None])) == before == {("a",): "1", ("b",): "3"}
    counted = {r["v"]: (r["vertree"], r["version_deletes"], r["timestamp_rejects"]) for r in store.versions(tree).collect()}
    assert counted == {root: (tree, 0, 0), child: (tree, 0, 1), dead: (tree, 1, 0)}


def test_requests_outlive_a_process(spark, store):
    _, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    array = store.put("c", rows(spark, (["a"], "1234", 0)))
    store.put_chunks("c", spark.createDataFrame([([b"k"], 0, b"x" * 600)], "dims array<binary>, chunk_no long, chunk binary"))
    store.get("c", [b"a"])
    store.get_chunks("c", [b"k"], 100)
    store.save_requests()
    r = Store(spark, store.root).collections().first()
    assert (r["gets"], r["big_gets"], r["puts"], r["big_puts"]) == (1, 1, 1, 1)
    assert r["puts_size"] == store.arrays().where(F.col("array_id") == array).first()["nr_bytes"] and r["big_puts_size"] > 600
    store.detach("c")
    store.attach("c", root)
    assert store.collections().first()["gets"] == 0


def test_events_as_a_stream(spark, store, tmp_path):
    def taken():
        q = store.event_stream().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        return [r["cmd"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()]

    tree, _ = store.create_vertree()
    assert taken() == ["VERSION_TREE_CREATED"]
    # a writer that fails between the catalogue and its event: the next one writes it
    kept, store._publish_event = store._publish_event, lambda state: None
    store.set_discard_period(tree, 5)
    store._publish_event = kept
    store.destroy_vertree(tree)
    assert taken() == ["VERSION_TREE_CREATED", "TOMBSTONE_DISCARD_SET", "VERSION_TREE_DESTROYED"]
    assert [r["event_id"] for r in store.events().orderBy("event_id").collect()] == [1, 2, 3]


def test_counters(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("n", root)
    one = lambda n: spark.createDataFrame([([b"k"], n)], "dims array<binary>, n long")
    store.count("n", one(5), add=False)
    store.count("n", one(2))
    store.snapshot("n")
    store.count("n", one(10))
    assert store.read_counters("n").first()["n"] == 17
    store.merge(tree, [r["array_id"] for r in store.arrays().collect()])
    assert store.read_counters("n").first()["n"] == 17
    with refused("EINVAL"):
        store.write("n", spark.createDataFrame([([b"k"], "COUNTER_ADD")], "dims array<binary>, op string"))


def test_values_beside_counters_survive_a_merge(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("m", root)
    store.put("m", rows(spark, (["v"], "kept", 0), (["w"], "old", 0)))
    store.count("m", spark.createDataFrame([([b"k"], 4), ([b"w"], 2)], "dims array<binary>, n long"))
    store.snapshot("m")
    store.count("m", spark.createDataFrame([([b"k"], 3)], "dims array<binary>, n long"))
    before = {(bytes(r["dims"][0]), r["op"], r["n"]) for r in store.read_counters("m").collect()}
    store.merge(tree, [r["array_id"] for r in store.arrays().collect()])
    assert {(bytes(r["dims"][0]), r["op"], r["n"]) for r in store.read_counters("m").collect()} == before
    assert (b"k", "COUNTER_SET", 7) in before
    assert content(store.get("m", [b"v"])) == {("v",): "kept"}


def test_refusals(spark, store):
    tree, root = store.create_vertree()
    other, other_root = store.create_vertree()
    with refused("ENOTCONN"):
        store.get("nobody", [b"a"])
    store.attach("c", root)
    with refused("EEXIST"):
        store.attach("c", other_root)
    with refused("EUNATCH"):
        store.clone(root)
    with refused("EBADE"):
        store.reattach("c", other_root)
    store.snapshot("c")
    store.attach("frozen", root)
    with refused("EROFS"):
        store.put("frozen", rows(spark, (["a"], "", 0)))
    with refused("EROFS"):
        store.snapshot("frozen")
    with refused("EBUSY"):
        store.destroy_vertree(tree)
    with refused("EINVAL"):
        store.put("c", rows(spark, ([], "", 0)))
    store.destroy_vertree(other)
    with refused(201):
        store.set_discard_period(other, 5)
    store.detach("frozen")
    store.delete_version(root)
    with refused("ECANCELED"):
        store.clone(root)


def test_only_one_of_two_writers_wins(spark, store):
    first, second = store.state(), store.state()
    store._change(first, "A")
    with refused(4):
        store._change(second, "B")


def test_incremental_backup(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    store.put("c", rows(spark, (["a"], "1", 0)))
    store.backup_start(tree)
    store.put("c", rows(spark, (["b"], "2", 0)))
    assert content(store.backup_rows(tree)) == {("a",): "1"}
    with refused("EBUSY"):
        store.backup_start(tree)
    with refused(114):
        store.merge(tree, [r["array_id"] for r in store.arrays().where("not is_barrier").collect()])
    store.backup_finish(tree)
    store.remove("c", rows(spark, (["a"], "", 0)))
    store.backup_start(tree)
    assert {(bytes(r["dims"][0]), r["op"]) for r in store.backup_rows(tree).collect()} == {(b"b", "VALUE"), (b"a", "TOMBSTONE")}
    store.backup_finish(tree, succeeded=False)
    store.backup_start(tree)
    assert store.backup_rows(tree).count() == 2


def test_literal_batch():
    batch = b""
    for key, value in ((b"a", b"hello"), (b"b", b"world")):
        wire = (17).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(8) + (20 << 8).to_bytes(4, "little") + key
        assert len(wire) == 21 and streamin.encode_key([key]) == wire
        batch += b"\x01" + bytes(8) + (21).to_bytes(4, "little") + (5).to_bytes(8, "little") + wire + value
    batch += bytes(21)
    assert list(streamin.decode_batch(batch)) == [([b"a"], b"hello", 0), ([b"b"], b"world", 0)]
    assert streamin.encode_batch([([b"a"], b"hello", 0), ([b"b"], b"world", 0)]) == batch


@pytest.mark.parametrize(("kind", "key", "value", "code"), [(3, 21, 1, "EINVAL"), (1, 600, 1, "E2BIG"), (1, 21, 600, "ENOSPC"), (1, 21, 5, "EINVAL")])
def test_bad_batches(kind, key, value, code):
    with refused(code):
        list(streamin.decode_batch(streamin.HEADER.pack(kind, 0, key, value)))


def test_bulk_load(spark, store, tmp_path):
    _, root = store.create_vertree()
    store.attach("c", root)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.bin").write_bytes(streamin.encode_batch([([b"a", b"b"], b"v", 7)]))
    batches = spark.read.format("binaryFile").load(f"file://{tmp_path}/in")
    assert streamin.read_batches(spark, f"file://{tmp_path}/in").count() == 1
    assert store.stream_in("c", batches, abort=True) == 0
    assert store.arrays().count() == 0
    assert store.stream_in("c", batches) > 0
    assert content(store.scan("c", [b"a", None], [b"a", None])) == {("a", "b"): "v"}
    assert store.stream_in("c", batches.limit(0)) == 0


def test_large_values(spark, store):
    _, root = store.create_vertree()
    store.attach("c", root)
    parts = spark.createDataFrame([([b"k"], 1, b"world", 77), ([b"k"], 0, b"hello " * 100, 5)], "dims array<binary>, chunk_no long, chunk binary, uts long")
    store.put_chunks("c", parts)
    got = store.get("c", [b"k"], user_timestamps=True)
    assert content(got) == {("k",): "hello " * 100 + "world"} and got.first()["uts"] == 77
    with refused("EINVAL"):
        store.put_chunks("c", parts.where("chunk_no = 1"))


def test_reads_give_counts(spark, store):
    _, root = store.create_vertree(timestamped=False)
    store.attach("n", root)
    for n, add in ((5, False), (5, True), (5, True)):
        store.count("n", spark.createDataFrame([([b"k"], n)], "dims array<binary>, n long"), add=add)
    store.put("n", rows(spark, (["v"], "plain", 0)))
    keys = spark.createDataFrame([([b"k"],), ([b"v"],)], "dims array<binary>")
    for out in (store.get("n", [b"k"]), store.scan("n", [b"a"], [b"m"]), store.multi_get("n", keys).where("op <> 'VALUE'")):
        assert [(r["op"], r["n"]) for r in out.collect()] == [("COUNTER_SET", 15)]
    assert content(store.scan("n", [b"v"], [None])) == {("v",): "plain"}


def test_streaming(spark, store, tmp_path):
    _, root = store.create_vertree()
    store.attach("c", root)
    data = spark.createDataFrame([([b"a"], "VALUE", b"1", None, 1), ([b"b"], "VALUE", b"2", None, 1)], WRITES)
    data.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        ingest(read_log(spark, f"file://{tmp_path}/in"), store, "c", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert content(store.scan("c", [None], [None])) == {("a",): "1", ("b",): "2"}
    assert store.log(store.collections().first()["vertree"]).agg(F.count(F.lit(1))).first()[0] == 2


def test_reads_skip_arrays_and_row_groups(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    store.put("c", rows(spark, (["a"], "1", 0), (["c"], "2", 0)))
    store.put("c", rows(spark, (["m"], "3", 0), (["p"], "4", 0)))
    assert len(store.log(tree, low=b"b", high=b"d").inputFiles()) < len(store.log(tree).inputFiles())
    assert store.log(tree, low=b"x").count() == 0
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = "".join(x for x in store.get("c", [b"m"])._jdf.queryExecution().explainString(mode).splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(first" in plan and "LessThanOrEqual(first" in plan
    assert content(store.scan("c", [b"b"], [b"n"])) == {("c",): "2", ("m",): "3"}
    assert [bytes(r["dims"][0]) for r in store.page("c", [None], [None], 2, last=[b"a"]).collect()] == [b"c", b"m"]
    assert [bytes(r["chunk"]) for r in store.get_chunks("c", [b"p"], 1).collect()] == [b"4"]


def test_merge_in_steps(spark, store):
    tree, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    for k in "ab":
        store.put("c", rows(spark, *(([f"{i}"], k, 0) for i in range(20))))
    arrays = [r["array_id"] for r in store.arrays().collect()]
    merge = store.merge_start(tree, arrays)
    with refused(108):
        store.merge(tree, arrays)
    assert not store.merge_work(merge, 3)
    half = store.merges().first()
    assert 0 < half["done"] < half["total"] == 40
    assert content(store.scan("c", [None], [None])) == {(f"{i}",): "b" for i in range(20)}
    assert store.merge_work(merge)
    assert store.merges().count() == 0 and store.arrays().count() == 1
    assert content(store.scan("c", [None], [None])) == {(f"{i}",): "b" for i in range(20)}
    with refused(112):
        store.merge_work(merge)


def computed(spark, rows):
    """The rows, and an accumulator of how many of them were computed."""
    n = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            n.add(part.num_rows)
            yield part

    return rows.mapInArrow(run, rows.schema), n


def test_a_write_has_no_pass_of_its_own_for_checks(spark, store, tmp_path):
    _, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    some, n = computed(spark, rows(spark, *(([f"{i:03}"], "v", 0) for i in range(100))))
    array = store.put("c", some, order="i")
    assert n.value == 200  # for the ranges, and for the run
    assert store.arrays().where(F.col("array_id") == array).first()["item_count"] == 100
    for bad, why in (([], "no dimensions"), (["x" * 600], "ENAMETOOLONG")):
        with pytest.raises(StoreError, match=why):
            store.put("c", rows(spark, (["a"], "v", 0), (bad, "v", 0)), order="i")
    with pytest.raises(StoreError, match="null dimension"):
        store.put("c", spark.createDataFrame([([b"a", None], b"v")], "dims array<binary>, value binary"))
    with pytest.raises(StoreError, match="a counter needs"):
        store.count("c", spark.createDataFrame([([b"a"], None)], "dims array<binary>, n long"))
    assert store.arrays().count() == 1 and len([d for d in (tmp_path / "store" / "arrays").glob("*/*") if d.is_dir()]) == 1
    assert len(content(store.scan("c", [None], [None]))) == 100


def test_a_write_of_one_version_reads_no_other(spark):
    from palimpsest.plans.store_queries import history

    writes = history(spark, "/root/testdata/sf0.001")[1]["writes"]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = writes.where("v = 8")._jdf.queryExecution().explainString(mode)
    assert [x for x in plan.splitlines() if x.startswith("PartitionFilters") and "= 8)" in x]


def test_a_bulk_load_decodes_once(spark, store, tmp_path):
    _, root = store.create_vertree()
    store.attach("c", root)
    batch = streamin.encode_batch([([b"a"], b"1", 5), ([b"b"], b"2", 5), ([b"a"], b"3", 5)])
    some, n = computed(spark, spark.createDataFrame([(batch,)], "content binary"))
    assert store.stream_in("c", some) > 0
    assert n.value == 1
    assert content(store.scan("c", [None], [None])) == {("a",): "3", ("b",): "2"}
    assert not list((tmp_path / "store" / "staged").glob("*"))


def test_reads_fold_only_where_counters_are(spark, store):
    plan = lambda: store.scan("c", [None], [None])._jdf.queryExecution().optimizedPlan().toString()
    _, root = store.create_vertree(timestamped=False)
    store.attach("c", root)
    store.put("c", rows(spark, (["a"], "1", 0)))
    assert "Window" not in plan()
    store.count("c", spark.createDataFrame([([b"k"], 4)], "dims array<binary>, n long"))
    store.count("c", spark.createDataFrame([([b"k"], 3)], "dims array<binary>, n long"))
    assert "Window" in plan()
    assert store.get("c", [b"k"]).first()["n"] == 7
    state = store.state()
    for a in state["arrays"].values():  # a catalogue from before counters were told
        del a["counters"]
    store._put_state(state)
    assert "Window" in plan() and store.get("c", [b"k"]).first()["n"] == 7
