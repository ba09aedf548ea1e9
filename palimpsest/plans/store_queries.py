"""Queries over a real store, built from the operation log of the fixtures.

The store is written once for a session and table folder, into the folder that
``spark.checkpoint.dir`` names. Queries that change something work on a fork: a
catalogue of its own over the same immutable arrays.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.fixtures import TREE, log, sql, table
from palimpsest.schema import COUNTER_ADD, TOMBSTONE, VALUE
from palimpsest.sources import streamin
from palimpsest.store import Store

_built: dict[tuple[str, str], tuple[Store, dict]] = {}
_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder; on a machine of its own (tests) in a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        base = named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        _folders[app] = f"{base}/stores-{uuid.uuid4().hex[:8]}" if named else base
        atexit.register(_remove_quietly, spark, _folders[app])
    return f"{_folders[app]}/{uuid.uuid4().hex[:8]}"


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone
        pass


def _dim(c: str) -> Column:
    """Numbers as eight bytes, which sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _key(*d: int) -> list[bytes]:
    return [x.to_bytes(8, "big") for x in d]


def _numbers(rows: DataFrame, *rest: str | Column) -> DataFrame:
    back = lambda i: F.conv(F.hex(F.col("dims")[i]), 16, 10).cast("long")
    return rows.select(back(0).alias("d0"), back(1).alias("d1"), *rest)


def _valued(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.when(F.col("op") == VALUE, F.col("n").cast("string").cast("binary")))


def _writes(rows: DataFrame) -> DataFrame:
    return _valued(rows.select("seq", F.array(_dim("d0"), _dim("d1")).alias("dims"), "op", "n", "uts", "v"))


def _kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The writes in files of their versions, so that a write of one version reads no others."""
    path = folder(spark)
    rows.drop("value").write.partitionBy("v").parquet(path)
    return _valued(spark.read.schema(rows.drop("value").schema).parquet(path))


def history(spark: SparkSession, sf_dir: str) -> tuple[Store, dict]:
    """The store and what its parts are: tree, versions and arrays by the fixture's numbers, and all writes.

    Branch "a" goes on to version 7, branch "b" to 8; "t" is a tree of user timestamps
    that took all values first and all tombstones later.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at in _built:
        return _built[at]
    store = Store(spark, folder(spark), clock=lambda: 1_000)
    rows = _kept(spark, _writes(log(spark, sf_dir, counters=True)))
    tree, root = store.create_vertree(timestamped=False)
    ids, arrays, name = {1: root}, {}, {1: "a"}
    store.attach("a", root)
    for v, parent in TREE:
        if v not in ids:
            name[v] = "b" if v == 4 else name[parent]
            if v == 4:  # the second branch, beside what "a" went on to
                ids[v] = store.clone(ids[parent])
                store.attach("b", ids[v])
            else:
                store.snapshot(name[v])
                ids[v] = store.state()["collections"][name[v]]["version"]
        arrays[v] = store.write(name[v], rows.where(F.col("v") == v), order="seq")
    stamped, top = store.create_vertree()
    store.set_discard_period(stamped, 60)
    store.attach("t", top)
    # without counters, all that is no tombstone is a value
    store.put("t", _valued(rows.where(F.col("op") != TOMBSTONE).withColumn("op", F.lit(VALUE))), order="seq")
    store.remove("t", rows.where(F.col("op") == TOMBSTONE), order="seq")
    _built[at] = store, {"tree": tree, "stamped": stamped, "versions": ids, "arrays": arrays, "writes": rows}
    return _built[at]


def fork(spark: SparkSession, sf_dir: str) -> tuple[Store, dict]:
    store, parts = history(spark, sf_dir)
    state = store.state()
    out = Store(spark, folder(spark), clock=lambda: 1_000)
    out._write(1, {k: x for k, x in state.items() if k != "number"})
    return out, parts


def _named(spark: SparkSession, numbers: dict, id_name: str) -> DataFrame:
    """Fixture numbers of a store's versions or arrays, at most a few."""
    return F.broadcast(spark.createDataFrame([(k, x) for k, x in numbers.items()], f"v long, {id_name} long"))


ALL = [None, None]
#: The events of ``history`` in order.
HISTORY = (
    *("VERSION_TREE_CREATED", "COLLECTION_ATTACHED", "NEW_TREE_ADDED"),
    *("COLLECTION_SNAPSHOT", "NEW_TREE_ADDED") * 2,
    *("CLONE", "COLLECTION_ATTACHED", "NEW_TREE_ADDED"),
    *("COLLECTION_SNAPSHOT", "NEW_TREE_ADDED") * 4,
    *("VERSION_TREE_CREATED", "TOMBSTONE_DISCARD_SET", "COLLECTION_ATTACHED", "NEW_TREE_ADDED", "NEW_TREE_ADDED"),
)


def scan_a_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What branch "b" sees: values and whole counts."""
    return _numbers(history(spark, sf_dir)[0].scan("b", ALL, ALL), "op", "n")


def range_of_a_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(history(spark, sf_dir)[0].scan("a", [_key(10)[0], None], [_key(29)[0], None]), "op", "n")


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(history(spark, sf_dir)[0].get("a", _key(0, 2), tombstones=True), F.col("op") == TOMBSTONE)


def many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("d0"), (F.col("o_orderkey") % 7).alias("d1")).select(F.array(_dim("d0"), _dim("d1")).alias("dims"))
    return _numbers(history(spark, sf_dir)[0].multi_get("a", wanted), "op", "n")


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(history(spark, sf_dir)[0].page("b", ALL, ALL, 25, last=_key(12, 3)), "op", "n")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and removals with user timestamps: the greatest wins, whatever came last."""
    return _numbers(history(spark, sf_dir)[0].scan("t", ALL, ALL, user_timestamps=True), F.col("value").cast("string").alias("value"), "uts")


def stepwise_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch "b" after all arrays were merged in two steps, with a write of another branch between them."""
    store, p = fork(spark, sf_dir)
    merge = store.merge_start(p["tree"], list(p["arrays"].values()))
    store.merge_work(merge, 3)
    store.remove("a", p["writes"].where("v = 7").drop("op"))
    store.merge_work(merge)
    return _numbers(store.scan("b", ALL, ALL), "op", "n")


def merges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of the arrays of versions 3 to 6, as it begins."""
    store, p = fork(spark, sf_dir)
    store.merge_start(p["tree"], [p["arrays"][v] for v in (3, 4, 5, 6)])
    return store.merges().select(F.size("in_arrays").alias("inputs"), "done", "total", "percent")


def arrays_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, p = fork(spark, sf_dir)
    store.merge_start(p["tree"], [p["arrays"][v] for v in (3, 4, 5, 6)])
    barrier = store.backup_start(p["tree"])
    own = _named(spark, p["arrays"] | {9: barrier}, "array_id")
    return store.arrays().join(own, "array_id").select("v", "merge_state", "item_count", "min_user_ts", "max_user_ts")


def vertrees_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir)[0].vertrees().select("timestamped", "discard_s", F.col("arrays").cast("long").alias("arrays"), "item_count")


def versions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, p = history(spark, sf_dir)
    own = _named(spark, p["versions"], "id")
    return store.versions(p["tree"]).withColumnRenamed("v", "id").join(own, "id").select("v", "is_leaf", "keys", "tombstones", "tombstone_deletes", "key_replaces")


def collections_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their requests: eight writes of the history, then two reads of a key, a range and a write, seen by another process."""
    store, p = fork(spark, sf_dir)
    for d in (1, 2):
        store.get("a", _key(d, 0))
    store.scan("b", ALL, ALL)
    store.detach("t")
    store.attach("old", p["versions"][3])
    store.count("b", p["writes"].where(F.col("op") == COUNTER_ADD).drop("op"))
    store.save_requests()
    store = Store(spark, store.root)
    return store.collections().join(_named(spark, p["versions"], "version"), "version").select("name", F.col("v").alias("version"), "read_only", "gets", "puts", "range_queries")


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir)[0].events().groupBy("cmd").agg(F.count(F.lit(1)).alias("n"))


def dropped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of all arrays dropped of the deleted version 7, by the versions view."""
    store, p = fork(spark, sf_dir)
    store.detach("a")
    store.delete_version(p["versions"][7])
    store.merge(p["tree"], list(p["arrays"].values()))
    own = _named(spark, p["versions"], "id")
    return store.versions(p["tree"]).withColumnRenamed("v", "id").join(own, "id").select("v", F.col("vertree").eqNullSafe(p["tree"]).alias("in_tree"), "version_deletes", "timestamp_rejects")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's events as a stream brings them."""
    store, _ = history(spark, sf_dir)
    out = f"{folder(spark)}/events"
    started = store.event_stream(max_files=10).writeStream.format("parquet").option("checkpointLocation", f"{out}-at").option("path", out).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(out).select("event_id", "cmd")


def reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch "b" put back to version 4."""
    store, p = fork(spark, sf_dir)
    store.reattach("b", p["versions"][4])
    return _numbers(store.scan("b", ALL, ALL), "op", "n")


def version_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch "b" after version 7 was deleted and all arrays were merged, with the entries left of 7."""
    store, p = fork(spark, sf_dir)
    store.detach("a")
    store.delete_version(p["versions"][7])
    store.merge(p["tree"], list(p["arrays"].values()))
    left = store.log(p["tree"]).agg(F.count_if(F.col("v") == p["versions"][7]).alias("of_deleted"))
    return _numbers(store.scan("b", ALL, ALL), "op", "n").crossJoin(F.broadcast(left))  # one row


def tree_destroyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, p = fork(spark, sf_dir)
    store.detach("t")
    store.destroy_vertree(p["stamped"])
    return store.vertrees().crossJoin(store.arrays().agg(F.sum("item_count").alias("items"))).select("timestamped", "items")  # one row each


def bulk_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed batches: one load that is given up, then one that is kept."""
    store = Store(spark, folder(spark), clock=lambda: 1_000)
    store.attach("c", store.create_vertree()[1])
    rows = table(spark, sf_dir, "events").select(F.array(_dim("event_id"), _dim("user_id")).alias("dims"), F.col("props").cast("binary").alias("value"), ((F.col("event_id") * 7919) % 10007).alias("uts"))
    batches = streamin.encode(rows, per_batch=500)
    column = batches.columns[0]
    store.stream_in("c", batches, column, abort=True)
    store.stream_in("c", batches, column)
    return _numbers(store.scan("c", ALL, ALL, user_timestamps=True), F.col("value").cast("string").alias("value"), "uts")


def second_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup that succeeds, writes, one that fails, and what the third then selects."""
    store, p = fork(spark, sf_dir)
    store.backup_start(p["tree"])
    store.backup_finish(p["tree"])
    rows = p["writes"]
    store.remove("a", rows.where("v = 7").drop("op"), order="seq")
    store.backup_start(p["tree"])
    store.backup_finish(p["tree"], succeeded=False)
    store.write("b", rows.where("v = 8"), order="seq")
    store.backup_start(p["tree"])
    return _numbers(store.backup_rows(p["tree"]), "op")


def array_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a read sees which took the list of arrays before a write, and one after it."""
    store, p = fork(spark, sf_dir)
    before = store.state()
    store.write("b", p["writes"].where("v = 8"), order="seq")
    old = store.log(p["tree"], before).agg(F.count(F.lit(1)).alias("before"))
    return old.crossJoin(store.log(p["tree"]).agg(F.count(F.lit(1)).alias("after")))  # one row each


def queries(count_sql, counted: str) -> dict:  # noqa: ANN001
    """name -> (query, SQL); ``count_sql`` and ``counted`` give the SQL of counted reads."""
    at = lambda v, more="": count_sql(f"(SELECT * FROM anc WHERE qv = {v}{more})", counted)
    every = lambda body: sql(body, counters=True)
    best = "(SELECT *, row_number() OVER (PARTITION BY d0, d1 ORDER BY uts DESC, op = 'TOMBSTONE' DESC, seq DESC) AS rn FROM log)"
    return {
        "store_scan": (scan_a_branch, at(8)),
        "store_range": (range_of_a_branch, at(7, " AND d0 BETWEEN 10 AND 29")),
        "store_get": (lambda s, d: point(s, d).toDF("d0", "d1", "is_tombstone"), every("SELECT d0, d1, op = 'TOMBSTONE' AS is_tombstone FROM anc WHERE qv = 7 AND d0 = 0 AND d1 = 2 QUALIFY row_number() OVER (ORDER BY seq DESC) = 1")),
        "store_multi_get": (many_keys, at(7, " AND (d0, d1) IN (SELECT (o_custkey % 50, o_orderkey % 7) FROM orders)")),
        "store_page": (next_page, at(8, " AND (d0 > 12 OR d0 = 12 AND d1 > 3)") + " ORDER BY d0, d1 LIMIT 25"),
        "store_timestamped": (stamped, sql(f"SELECT d0, d1, CAST(n AS VARCHAR) AS value, uts FROM {best} WHERE rn = 1 AND op <> 'TOMBSTONE'")),
        "store_merge_stepwise": (stepwise_merge, at(8)),
        "sys_merges": (merges_view, every("SELECT 4 AS inputs, CAST(0 AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS total, CAST(0 AS BIGINT) AS percent FROM log WHERE v BETWEEN 3 AND 6")),
        "sys_arrays": (
            arrays_view,
            every("SELECT v, CASE WHEN v BETWEEN 3 AND 6 THEN 'input' ELSE 'idle' END AS merge_state, CAST(count(*) AS BIGINT) AS item_count, min(uts) AS min_user_ts, max(uts) AS max_user_ts FROM log GROUP BY v UNION ALL SELECT 9, 'barrier', 0, NULL, NULL"),
        ),
        "sys_vertrees": (
            vertrees_view,
            every("SELECT false AS timestamped, CAST(0 AS BIGINT) AS discard_s, CAST(count(DISTINCT v) AS BIGINT) AS arrays, CAST(count(*) AS BIGINT) AS item_count FROM log UNION ALL SELECT true, 60, count(DISTINCT op = 'TOMBSTONE'), count(*) FROM log"),
        ),
        "store_versions": (
            versions_view,
            every(
                """, s AS (SELECT v, op, lead(op) OVER (PARTITION BY v, d0, d1 ORDER BY seq) AS nxt FROM log)
SELECT CAST(w.v AS BIGINT) AS v, w.o = w.r AS is_leaf, CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt IS NULL) AS BIGINT) AS keys, CAST(count(*) FILTER (op = 'TOMBSTONE' AND nxt IS NULL) AS BIGINT) AS tombstones,
  CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt = 'TOMBSTONE') AS BIGINT) AS tombstone_deletes, CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt <> 'TOMBSTONE') AS BIGINT) AS key_replaces
FROM ver w LEFT JOIN s ON s.v = w.v GROUP BY ALL"""
            ).replace(")\n, s AS", "),\ns AS"),
        ),
        "sys_collections": (
            collections_view,
            "SELECT * FROM (VALUES ('a', CAST(7 AS BIGINT), false, CAST(2 AS BIGINT), CAST(5 AS BIGINT), CAST(0 AS BIGINT)), ('b', 8, false, 0, 4, 1), ('old', 3, true, 0, 0, 0)) AS c(name, version, read_only, gets, puts, range_queries)",
        ),
        "events_log": (
            events_view,
            "SELECT cmd, CAST(n AS BIGINT) AS n FROM (VALUES ('VERSION_TREE_CREATED', 2), ('COLLECTION_ATTACHED', 3), ('COLLECTION_SNAPSHOT', 6), ('CLONE', 1), ('NEW_TREE_ADDED', 10), ('TOMBSTONE_DISCARD_SET', 1)) AS e(cmd, n)",
        ),
        "events_stream": (
            streamed_events,
            "SELECT CAST(event_id AS BIGINT) AS event_id, cmd FROM (VALUES " + ", ".join(f"({k}, '{cmd}')" for k, cmd in enumerate(HISTORY, 1)) + ") AS e(event_id, cmd)",
        ),
        "store_version_deletes": (
            dropped_view,
            every("SELECT CAST(w.v AS BIGINT) AS v, true AS in_tree, CAST(count(DISTINCT (d0, d1)) FILTER (w.v = 7) AS BIGINT) AS version_deletes, CAST(0 AS BIGINT) AS timestamp_rejects FROM ver w LEFT JOIN log s ON s.v = w.v GROUP BY ALL"),
        ),
        "store_reattach": (reattached, at(4)),
        "store_delete_version": (version_deleted, count_sql("(SELECT * FROM anc WHERE qv = 8)", counted + ", CAST(0 AS BIGINT) AS of_deleted")),
        "store_destroy_tree": (tree_destroyed, every("SELECT false AS timestamped, CAST(count(*) AS BIGINT) AS items FROM log")),
        "store_bulk_load": (bulk_loaded, "SELECT event_id AS d0, user_id AS d1, props AS value, CAST((event_id * 7919) % 10007 AS BIGINT) AS uts FROM events"),
        "store_backup": (second_backup, every("SELECT d0, d1, CASE v WHEN 7 THEN 'TOMBSTONE' ELSE op END AS op FROM log WHERE v IN (7, 8)")),
        "store_array_snapshot": (array_snapshot, every("SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(*) + count(*) FILTER (v = 8) AS BIGINT) AS after FROM log")),
    }
