"""The engine's operators as queries over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.operators import compaction, reads, resolve, stats
from palimpsest.plans import store_queries
from palimpsest.plans.fixtures import DAY_S, KEYS, log, sql, table, tree, versions
from palimpsest.schema import TOMBSTONE
from palimpsest.sources import streamin
from palimpsest.versions import VersionTree, ancestry, health_counts, leaves, live_parents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


_NEWEST = "row_number() OVER (PARTITION BY qv, d0, d1 ORDER BY seq DESC)"
_BY_UTS = "row_number() OVER (PARTITION BY qv, d0, d1 ORDER BY uts DESC, seq DESC)"


def _newest(columns: str, where: str, order: str = _NEWEST, tombstones: bool = False) -> str:
    return f"SELECT {columns} FROM (SELECT *, {order} AS rn FROM anc) WHERE rn = 1 AND {where}" + ("" if tombstones else " AND op <> 'TOMBSTONE'")


# point reads


@query(sql(_newest("d0, d1, op, n, seq", "qv = 7 AND d0 = 0 AND d1 = 2")))
def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get(log(spark, sf_dir), tree(), 7, {"d0": 0, "d1": 2}).select("d0", "d1", "op", "n", "seq")


@query("SELECT CAST(count(*) AS BIGINT) AS found FROM events WHERE user_id = 0 AND event_id % 7 = 99")
def get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get(log(spark, sf_dir), tree(), 8, {"d0": 0, "d1": 99}).agg(F.count(F.lit(1)).alias("found"))


@query(sql(_newest("d0, d1, op = 'TOMBSTONE' AS is_tombstone, seq", "qv = 8 AND d0 BETWEEN 0 AND 9", tombstones=True)))
def get_tombstone_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reads.scan(log(spark, sf_dir), tree(), 8, KEYS, [0, None], [9, None], tombstones=True)
    return out.select("d0", "d1", "is_tombstone", "seq")


@query(sql(_newest("d0, d1, n, uts, seq", "qv = 8 AND d0 = 0 AND d1 = 4", _BY_UTS)))
def get_timestamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get(log(spark, sf_dir), tree(), 8, {"d0": 0, "d1": 4}, timestamped=True).select("d0", "d1", "n", "uts", "seq")


@query(sql(_newest("d0, d1, n, seq", "qv = 6 AND (d0, d1) IN (SELECT o_custkey % 50, o_orderkey % 7 FROM orders WHERE o_orderpriority LIKE '1%')")))
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select((F.col("o_custkey") % 50).alias("d0"), (F.col("o_orderkey") % 7).alias("d1"))
    return reads.multi_get(log(spark, sf_dir), tree(), 6, wanted, KEYS).select("d0", "d1", "n", "seq")


# ranges


@query(sql(_newest("d0, d1, n, seq", "qv = 7 AND d0 BETWEEN 3 AND 12")))
def range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 7, KEYS, [3, None], [12, None]).select("d0", "d1", "n", "seq")


@query(sql(_newest("d0, d1, n, seq", "qv = 7 AND d0 BETWEEN 2 AND 90 AND d1 BETWEEN 1 AND 3")))
def range_hypercube_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 7, KEYS, [2, 1], [90, 3]).select("d0", "d1", "n", "seq")


@query("SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_custkey BETWEEN 10 AND 90 AND o_orderkey BETWEEN 100 AND 9000")
def range_hypercube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("o_custkey"), F.col("o_orderkey")]
    return table(spark, sf_dir, "orders").where(K.in_box(keys, [10, 100], [90, 9000])).select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query(sql(_newest("d0, d1, n, seq", "qv = 5 AND d0 <= 7")))
def range_open_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 5, KEYS, [None, None], [7, None]).select("d0", "d1", "n", "seq")


@query(sql(_newest("d0, d1, n, seq", "qv = 5 AND d0 >= 8 AND d1 >= 5")))
def range_open_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 5, KEYS, [8, 5], [None, None]).select("d0", "d1", "n", "seq")


@query(sql(_newest("d0, d1", "qv = 8")))
def range_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 8, KEYS, [None, None], [None, None], values=False)


@query(sql(_newest("d0, d1, op, n", "qv = 6 AND d1 = 3", tombstones=True)))
def range_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(log(spark, sf_dir), tree(), 6, KEYS, [None, 3], [None, 3], tombstones=True).select("d0", "d1", "op", "n")


@query(sql(_newest("d0, d1, uts", "qv = 8 AND d0 < 40", _BY_UTS)))
def range_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reads.scan(log(spark, sf_dir), tree(), 8, KEYS, [None, None], [39, None], timestamped=True, user_timestamps=True)
    return out.select("d0", "d1", "uts")


@query("SELECT doc_id, lang, CASE WHEN octet_length(encode(text)) <= 512 THEN text END AS value FROM documents WHERE lang BETWEEN 'de' AND 'es'")
def range_inline_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.lit(1).cast("long").alias("v"), F.col("doc_id").alias("seq"), F.lit("VALUE").alias("op"), F.col("text").cast("binary").alias("value"))
    out = reads.scan(docs, tree(), 1, ["lang", "doc_id"], ["de", None], ["es", None], out_of_line=False)
    return out.select("doc_id", "lang", F.col("value").cast("string").alias("value"))


@query(sql(_newest("d0, d1, n", "qv = 8 AND (d0 > 4 OR (d0 = 4 AND d1 > 3))") + " ORDER BY d0, d1 LIMIT 25"))
def range_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.scan(log(spark, sf_dir), tree(), 8, KEYS, [None, None], [None, None])
    return reads.page(rows, KEYS, 25, [4, 3]).select("d0", "d1", "n")


@query(sql("SELECT seq, d0, d1, op, n FROM log WHERE v = 6"))
def scan_matching_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.matching(log(spark, sf_dir), 6).select("seq", *KEYS, "op", "n")


# keys


def _mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one to three dimensions."""
    part = lambda c, n: F.substring(F.col(c).cast("string"), 1, n).cast("binary")
    dims = F.slice(F.array(part("user_id", 9), F.col("event_type").cast("binary"), part("event_id", 2)), 1, (1 + F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dims.alias("dims"))


_MIXED = "k AS (SELECT event_id, ([CAST(user_id AS VARCHAR), event_type, substr(CAST(event_id AS VARCHAR), 1, 2)])[1:1 + event_id % 3] AS dims FROM events)"


@query(f"WITH {_MIXED} SELECT event_id, CAST(dense_rank() OVER (PARTITION BY dims[1] ORDER BY len(dims), dims) AS BIGINT) AS place FROM k")
def key_order_by_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    group = Window.partitionBy(F.col("dims")[0]).orderBy(K.order_key(F.col("dims")))
    return _mixed_keys(spark, sf_dir).select("event_id", F.dense_rank().over(group).cast("long").alias("place"))


@query(f"WITH {_MIXED} SELECT dims[1] AS prefix, CAST(count(*) AS BIGINT) AS keys FROM k GROUP BY 1")
def key_strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = K.strip(F.col("dims"), 1)[0].cast("string")
    return _mixed_keys(spark, sf_dir).groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("keys"))


@query(f"WITH {_MIXED} SELECT CAST(len(dims) AS BIGINT) AS n_dims, CAST(count(*) AS BIGINT) AS keys FROM k GROUP BY 1")
def key_dims_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_keys(spark, sf_dir).groupBy(K.n_dims(F.col("dims")).cast("long").alias("n_dims")).agg(F.count(F.lit(1)).alias("keys"))


@query(f"WITH {_MIXED} SELECT event_id, array_to_string(list_concat(dims[1:1], (['x', 'y', 'z'])[2:3]), '/') AS melded FROM k")
def key_meld(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.array(*(F.lit(x).cast("binary") for x in "xyz"))
    melded = K.meld(F.col("dims"), other, 1)
    return _mixed_keys(spark, sf_dir).select("event_id", F.array_join(F.transform(melded, lambda d: d.cast("string")), "/").alias("melded"))


@query("SELECT event_id, CASE WHEN NOT user_id BETWEEN 5 AND 60 THEN 0 WHEN NOT event_id % 7 BETWEEN 2 AND 4 THEN 1 END AS outside FROM events")
def key_bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("user_id"), F.col("event_id") % 7]
    return table(spark, sf_dir, "events").select("event_id", K.outside(keys, [5, 2], [60, 4]).alias("outside"))


@query(f"WITH {_MIXED} SELECT event_id, true AS same, CAST(dense_rank() OVER (PARTITION BY dims[1] ORDER BY len(dims), dims) AS BIGINT) AS place FROM k")
def key_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    keys = _mixed_keys(spark, sf_dir).withColumn("packed", K.pack_udf("dims"))
    group = Window.partitionBy(F.col("dims")[0]).orderBy("packed")
    return keys.select("event_id", (K.unpack_udf("packed") == F.col("dims")).alias("same"), F.dense_rank().over(group).cast("long").alias("place"))


@query(f"WITH {_MIXED} SELECT CAST(count(DISTINCT dims) AS BIGINT) AS hashes, CAST(count(DISTINCT dims[1:2]) AS BIGINT) AS prefixes FROM k")
def key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _mixed_keys(spark, sf_dir).select(K.key_hash(F.col("dims")).alias("h"), K.key_hash(F.col("dims"), 2).alias("p"))
    return keys.agg(F.countDistinct("h").alias("hashes"), F.countDistinct("p").alias("prefixes"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) + 20 > 512 THEN 'ENAMETOOLONG' END AS reason FROM documents")
def key_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.array(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", K.validate(dims).alias("reason"))


# versions


@query(sql("SELECT q.v AS qv, a.v AS v FROM ver a JOIN ver q ON q.o BETWEEN a.o AND a.r"))
def version_ancestry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry(versions(spark)).select(F.col("qv").cast("int"), F.col("v").cast("int"))


@query(sql("SELECT v, NOT EXISTS (SELECT 1 FROM ver c WHERE c.parent = x.v) AS mutable, NOT EXISTS (SELECT 1 FROM ver c WHERE c.o > x.o AND c.o <= x.r AND NOT c.deleted) AS leaf FROM ver x", deleted=(5, 7)))
def version_leaf_mutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(versions(spark, (5, 7))).select(F.col("v").cast("int"), "mutable", "leaf")


@query(sql("SELECT v, coalesce((SELECT arg_max(a.v, a.o) FROM ver a WHERE a.o < x.o AND x.o <= a.r AND NOT a.deleted), 0) AS live_parent FROM ver x", deleted=(3, 5)))
def version_live_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_parents(versions(spark, (3, 5))).select(F.col("v").cast("int"), F.col("live_parent").cast("int"))


@query(
    sql(
        "SELECT CAST(count(*) FILTER (NOT deleted) AS BIGINT) AS live, CAST(count(*) FILTER (deleted AND NOT leaf) AS BIGINT) AS deleted, CAST(count(*) FILTER (deleted AND leaf) AS BIGINT) AS dead, CAST(count(*) AS BIGINT) AS total "
        "FROM (SELECT *, NOT EXISTS (SELECT 1 FROM ver c WHERE c.o > x.o AND c.o <= x.r AND NOT c.deleted) AS leaf FROM ver x)",
        deleted=(3, 5, 8),
    )
)
def version_health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_counts(versions(spark, (3, 5, 8)))


@query(sql("SELECT v, o, rank() OVER (ORDER BY o DESC) AS newest_first FROM ver"))
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    return versions(spark).select(F.col("v").cast("int"), F.col("o").cast("int"), F.rank().over(Window.orderBy(F.col("o").desc())).cast("long").alias("newest_first"))


@query(
    sql(
        "SELECT coalesce(x.d0, y.d0) AS d0, coalesce(x.d1, y.d1) AS d1, x.seq AS old_seq, y.seq AS new_seq FROM "
        + "(" + _newest("d0, d1, seq", "qv = 2") + ") x FULL JOIN (" + _newest("d0, d1, seq", "qv = 6") + ") y ON x.d0 = y.d0 AND x.d1 = y.d1 WHERE x.seq IS DISTINCT FROM y.seq"
    )
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between a version and a later one: both views from one pass."""
    both = resolve.visible(log(spark, sf_dir), versions(spark).where("v in (1, 2, 4, 6)"), KEYS).where("qv in (2, 6)")
    out = both.groupBy(*KEYS).agg(F.max(F.when(F.col("qv") == 2, F.col("seq"))).alias("old_seq"), F.max(F.when(F.col("qv") == 6, F.col("seq"))).alias("new_seq"))
    return out.where(~F.col("old_seq").eqNullSafe(F.col("new_seq")))


@query(sql("SELECT qv, CAST(count(*) AS BIGINT) AS keys, CAST(sum(n) AS BIGINT) AS total FROM (" + _newest("qv, n", "qv IN (3, 4)") + ") GROUP BY qv"))
def clone_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches of one version see its data and their own, not each other's."""
    seen = resolve.visible(log(spark, sf_dir), versions(spark), KEYS).where("qv in (3, 4)")
    return seen.groupBy(F.col("qv").cast("int")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("total"))


@query(sql(_newest("qv, d0, d1, n, seq", "true")))
def visible_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.visible(log(spark, sf_dir), versions(spark), KEYS).select(F.col("qv").cast("int"), *KEYS, "n", "seq")


# counters

_COUNT = """, b AS (SELECT *, max(CASE WHEN op <> 'COUNTER_ADD' THEN seq END) OVER (PARTITION BY qv, d0, d1) AS bs, max(seq) OVER (PARTITION BY qv, d0, d1) AS ls FROM {0}),
c AS (SELECT qv, d0, d1, max(CASE WHEN seq = ls THEN op END) AS last_op, max(CASE WHEN seq = ls THEN n END) AS last_n,
  CAST(sum(CASE WHEN op IN ('COUNTER_ADD', 'COUNTER_SET') AND seq >= coalesce(bs, -1) THEN n ELSE 0 END) AS BIGINT) AS total FROM b GROUP BY qv, d0, d1)
SELECT {1} FROM c WHERE last_op <> 'TOMBSTONE'"""
_COUNTED = "d0, d1, CASE WHEN last_op = 'VALUE' THEN 'VALUE' ELSE 'COUNTER_SET' END AS op, CASE WHEN last_op = 'VALUE' THEN last_n ELSE total END AS n"


def _count_sql(source: str, columns: str) -> str:
    return sql("SELECT 1", counters=True).rsplit("SELECT 1", 1)[0].rstrip() + _COUNT.format(source, columns)


@query(_count_sql("anc", "qv, " + _COUNTED))
def counter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.counters(log(spark, sf_dir, counters=True), versions(spark), KEYS).select(F.col("qv").cast("int"), *KEYS, "op", "n")


@query(_count_sql("(SELECT *, v AS qv FROM log WHERE v = 2)", _COUNTED))
def counter_one_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.count(log(spark, sf_dir, counters=True).where("v = 2"), KEYS).where(F.col("op") != TOMBSTONE)


@query(
    sql(
        """, b AS (SELECT *, max(CASE WHEN op <> 'COUNTER_ADD' THEN seq END) OVER (PARTITION BY d0, d1, v) AS bs FROM log)
SELECT d0, d1, CAST(v AS BIGINT) AS v, max(bs) AS base_seq, CAST(sum(CASE WHEN op = 'COUNTER_ADD' AND seq > coalesce(bs, -1) THEN n ELSE 0 END) AS BIGINT) AS added FROM b GROUP BY d0, d1, v""",
        counters=True,
    ).replace(")\n, b AS", "),\nb AS")
)
def counter_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each key and version as one composite: the last base and the sum behind it."""
    parts = resolve.fold_pieces(log(spark, sf_dir, counters=True), ["v", *KEYS], 1)
    return parts.select(*KEYS, "v", F.col("base.seq").alias("base_seq"), "added")


@query(_count_sql("(SELECT * FROM anc WHERE qv = 7 AND data_age >= 2)", _COUNTED))
def counter_multi_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.counters(log(spark, sf_dir, counters=True).where("data_age >= 2"), tree(), KEYS, 7).select(*KEYS, "op", "n")


@query(_count_sql("(SELECT * FROM anc WHERE qv = 8 AND d0 BETWEEN 1 AND 30 AND d1 <= 2)", _COUNTED))
def counter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan_counters(log(spark, sf_dir, counters=True), tree(), 8, KEYS, [1, None], [30, 2]).select(*KEYS, "op", "n")


@query(_count_sql("(SELECT *, 1 AS qv FROM log)", _COUNTED))
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with values, tombstones and counters in three arrays over a snapshot, read by a scan."""
    import uuid

    from palimpsest.store import Store

    shared = spark.conf.get("spark.checkpoint.dir", None) or "/tmp"
    store = Store(spark, f"{shared.rstrip('/')}/palimpsest-store-{uuid.uuid4().hex}")
    _, root = store.create_vertree(timestamped=False)
    store.attach("events", root)
    dims = F.array(*(F.col(k).cast("string").cast("binary") for k in KEYS))
    rows = log(spark, sf_dir, counters=True).select(dims.alias("dims"), "op", "n", "seq", "data_age")
    for part in ("data_age < 3", "data_age between 3 and 5", "data_age > 5"):
        store.write("events", rows.where(part), order="seq")
        if part == "data_age < 3":
            store.snapshot("events")
    out = store.scan("events", [None, None], [None, None])
    d = lambda i: F.col("dims")[i].cast("string").cast("long")
    return out.select(d(0).alias("d0"), d(1).alias("d1"), "op", "n")


# timestamps


@query(sql(_newest("qv, d0, d1, n, uts, seq", "true", _BY_UTS)))
def timestamp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.visible(log(spark, sf_dir), versions(spark), KEYS, timestamped=True).select(F.col("qv").cast("int"), *KEYS, "n", "uts", "seq")


@query(
    sql("SELECT l.seq, l.d0, l.d1 FROM log l JOIN ver q ON q.v = l.v WHERE EXISTS (SELECT 1 FROM log e JOIN ver a ON a.v = e.v WHERE e.d0 = l.d0 AND e.d1 = l.d1 AND q.o BETWEEN a.o AND a.r AND e.seq < l.seq AND e.uts > l.uts)")
)
def timestamp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.timestamp_rejects(log(spark, sf_dir), versions(spark), KEYS).select("seq", *KEYS)


# merges

_DISTINCT = ", e AS (SELECT x.*, w.o, w.r, w.deleted FROM (SELECT *, row_number() OVER (PARTITION BY d0, d1, v ORDER BY {0} DESC) AS rn FROM log{1}) x JOIN ver w ON w.v = x.v WHERE rn = 1)"
_UPPER = "(SELECT arg_max({0}, a.o) FROM e a WHERE a.d0 = e.d0 AND a.d1 = e.d1 AND a.o < e.o AND e.o <= a.r)"


def _merge_sql(body: str, order: str = "seq", where: str = "", **kwargs: object) -> str:
    return sql("SELECT 1", **kwargs).rsplit("SELECT 1", 1)[0].rstrip() + _DISTINCT.format(order, where) + body


def _distinct(spark: SparkSession, sf_dir: str, timestamped: bool = False) -> DataFrame:
    return compaction.distinct_entries(log(spark, sf_dir), KEYS, timestamped)


@query(_merge_sql(" SELECT seq, d0, d1, v FROM e x WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.d0 = x.d0 AND a.d1 = x.d1 AND a.o < x.o AND x.o <= a.r AND a.uts > x.uts)", "uts DESC, seq"))
def resolver_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.resolve_timestamps(_distinct(spark, sf_dir, True), versions(spark), KEYS).select("seq", *KEYS, "v")


@query(_merge_sql(f" SELECT seq, d0, d1, v FROM e WHERE NOT (op = 'TOMBSTONE' AND coalesce({_UPPER.format('a.op')}, 'TOMBSTONE') = 'TOMBSTONE')"))
def tombstone_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.discard_tombstones(_distinct(spark, sf_dir), versions(spark), KEYS).select("seq", *KEYS, "v")


@query(
    _merge_sql(
        f""" SELECT seq, d0, d1, v FROM e WHERE NOT (op = 'TOMBSTONE' AND coalesce({_UPPER.format('a.op')}, 'TOMBSTONE') = 'TOMBSTONE'
  AND v IN (1, 2, 3, 4) AND uts <= 6000 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.d0 = e.d0 AND x.d1 = e.d1 AND e.o < x.o AND x.o <= e.r AND x.uts < e.uts))""",
        "uts DESC, seq",
    )
)
def tombstone_discard_timestamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 1 to 4 were frozen by day 6; it is day 8 and two hours, the period is two days."""
    rows = _distinct(spark, sf_dir, True)
    out = compaction.discard_tombstones(rows, versions(spark), KEYS, timestamped=True, now=8 * DAY_S + 7200, period=2 * DAY_S, least_other_uts=6000)
    return out.select("seq", *KEYS, "v")


_NEEDED = """ SELECT seq, d0, d1, v FROM e WHERE NOT deleted OR EXISTS (SELECT 1 FROM ver w WHERE NOT w.deleted AND w.o BETWEEN e.o AND e.r
  AND NOT EXISTS (SELECT 1 FROM e x WHERE x.d0 = e.d0 AND x.d1 = e.d1 AND e.o < x.o AND x.o <= e.r AND w.o BETWEEN x.o AND x.r))"""


@query(_merge_sql(_NEEDED, deleted=(3, 5)))
def deleted_version_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.collect_deleted(_distinct(spark, sf_dir), versions(spark, (3, 5)), KEYS).select("seq", *KEYS, "v")


@query(
    _merge_sql(
        f""", kept AS ({_NEEDED.replace(" SELECT seq, d0, d1, v FROM e", "SELECT seq FROM e")})
SELECT CAST(v AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS version_deletes, CAST(0 AS BIGINT) AS timestamp_rejects FROM e WHERE seq NOT IN (SELECT seq FROM kept) GROUP BY v""",
        deleted=(3, 5),
    )
)
def merge_discard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collecting deleted versions 3 and 5 drops, by version."""
    before, gone = _distinct(spark, sf_dir), versions(spark, (3, 5))
    return stats.discard_stats(before, compaction.collect_deleted(before, gone, KEYS), KEYS, gone, timestamped=False)


@query(_count_sql("(SELECT * FROM anc WHERE qv IN (1, 2, 4, 6, 7, 8))", "qv, " + _COUNTED))
def counter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters read from a merge that dropped versions 3 and 5: the same as from the whole log."""
    rows, gone = log(spark, sf_dir, counters=True), versions(spark, (3, 5))
    merged = compaction.merge(rows, gone, KEYS, counter=True, oldest=True)
    return resolve.counters(merged, gone, KEYS).where("qv not in (3, 5)").select(F.col("qv").cast("int"), *KEYS, "op", "n")


@query(sql("SELECT seq, d0, d1, v, 3 AS data_age FROM (SELECT *, row_number() OVER (PARTITION BY d0, d1, v ORDER BY seq DESC) AS rn FROM log WHERE data_age IN (3, 4)) WHERE rn = 1"))
def merge_two_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = log(spark, sf_dir).where("data_age in (3, 4)")
    age = compaction.merge_age(two.select("data_age").distinct())
    return compaction.merge(two, versions(spark), KEYS).drop("data_age").join(F.broadcast(age)).select("seq", *KEYS, "v", F.col("data_age").cast("int"))


@query(sql("SELECT seq FROM (SELECT *, row_number() OVER (PARTITION BY d0, d1, v ORDER BY seq DESC) AS rn FROM log) WHERE rn > 1"))
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.shadowed(log(spark, sf_dir), KEYS).select("seq")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = log(spark, sf_dir).select("data_age").distinct()
    return ages.select(F.col("data_age").alias("array_id"), "data_age", F.col("data_age").isin(3, 7).alias("is_barrier"), F.col("data_age").isin(4, 6, 8).alias("chosen"))


@query(sql("SELECT CAST(count(*) FILTER (data_age IN (4, 6, 8)) AS BIGINT) AS chosen, CAST(count(*) FILTER (data_age = 5) AS BIGINT) AS gaps, CAST(count(*) FILTER (data_age = 7) AS BIGINT) AS barriers FROM (SELECT DISTINCT data_age FROM log)"))
def merge_contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.contiguity(_arrays(spark, sf_dir))


@query(
    _merge_sql(
        f""", k AS (SELECT * FROM e WHERE NOT (op = 'TOMBSTONE' AND coalesce({_UPPER.format('a.op')}, 'TOMBSTONE') = 'TOMBSTONE')),
g AS (SELECT k.*, q.v AS qv FROM k JOIN ver q ON q.o BETWEEN k.o AND k.r)
SELECT qv, d0, d1, seq FROM (SELECT *, row_number() OVER (PARTITION BY qv, d0, d1 ORDER BY seq DESC) AS n1 FROM g) WHERE n1 = 1 AND op <> 'TOMBSTONE'"""
    )
)
def merge_keeps_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a fully merged tree."""
    merged = compaction.merge(log(spark, sf_dir), versions(spark), KEYS, oldest=True)
    return resolve.visible(merged, versions(spark), KEYS).select(F.col("qv").cast("int"), *KEYS, "seq")


# arrays, backup, bulk load and values


@query(
    sql(
        "SELECT data_age, CAST(sum(items) AS BIGINT) AS item_count, CAST(sum(items * 32) AS BIGINT) AS nr_bytes, min(lo) AS min_user_ts, max(hi) AS max_user_ts, max(versions) AS max_versions_per_key "
        "FROM (SELECT data_age, d0, d1, count(*) AS items, min(uts) AS lo, max(uts) AS hi, count(DISTINCT v) AS versions FROM log GROUP BY ALL) GROUP BY data_age"
    )
)
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.array_stats(log(spark, sf_dir), KEYS, key_bytes=32)


@query(sql("SELECT data_age, max(uts) AS max_user_ts FROM log WHERE d0 = 0 GROUP BY data_age HAVING max(uts) > 8000"))
def array_prune_by_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stats.array_stats(log(spark, sf_dir).where("d0 = 0"), KEYS)
    return stats.may_hold_newer(arrays, 8000).select("data_age", "max_user_ts")


@query(sql("SELECT seq, d0, d1, op, data_age FROM log WHERE data_age > 3 AND data_age < 7"))
def incremental_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.backup_rows(log(spark, sf_dir), 3, 7).select("seq", *KEYS, "op", "data_age")


@query("SELECT event_id, event_type AS kind, props AS value, CAST((event_id * 7919) % 10007 AS BIGINT) AS uts FROM events")
def streamin_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as packed batches and decoded again."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.array(F.col("event_id").cast("string").cast("binary"), F.col("event_type").cast("binary")).alias("dims"), F.col("props").cast("binary").alias("value"), ((F.col("event_id") * 7919) % 10007).alias("uts"))
    out = streamin.decode(streamin.encode(rows, per_batch=500))
    return out.select(F.col("dims")[0].cast("string").cast("long").alias("event_id"), F.col("dims")[1].cast("string").alias("kind"), F.col("value").cast("string").alias("value"), "uts")


@query(
    "SELECT page_id, n AS chunk_no, substr(html, CAST(n * 700 + 1 AS BIGINT), 700) AS chunk FROM (SELECT page_id, html, unnest(range(0, greatest(CAST(ceil(length(html) / 700.0) AS BIGINT), 1))) AS n FROM (SELECT page_id, regexp_replace(html, '[^\\x20-\\x7E]', '', 'g') AS html FROM pages))"
)
def bigvalue_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut into chunks, put together and cut again; bytes of ASCII, so that SQL can count them."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"[^\x20-\x7E]", "").cast("binary").alias("value"))
    whole = reads.assemble(reads.chunks(pages, "page_id", "value", 300), "page_id")
    return reads.chunks(whole, "page_id", "value", 700).select("page_id", "chunk_no", F.col("chunk").cast("string").alias("chunk"))


@query("SELECT CASE WHEN octet_length(encode(text)) > 512 THEN 'OUT_OF_LINE' ELSE 'INLINE' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def value_tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("value"))
    kind = resolve.value_kind(F.lit("VALUE"), F.col("value"))
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).cast("long").alias("bytes"))


# statistics and views


@query(
    sql(
        """, s AS (SELECT v, op, lead(op) OVER (PARTITION BY v, d0, d1 ORDER BY seq) AS nxt FROM log)
SELECT CAST(w.v AS BIGINT) AS v, w.parent, w.o = w.r AS is_leaf, CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt IS NULL) AS BIGINT) AS keys, CAST(count(*) FILTER (op = 'TOMBSTONE' AND nxt IS NULL) AS BIGINT) AS tombstones,
  CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt = 'TOMBSTONE') AS BIGINT) AS tombstone_deletes, CAST(count(*) FILTER (op <> 'TOMBSTONE' AND nxt <> 'TOMBSTONE') AS BIGINT) AS key_replaces
FROM ver w LEFT JOIN s ON s.v = w.v GROUP BY ALL"""
    ).replace(")\n, s AS", "),\ns AS")
)
def sys_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stats.version_stats(log(spark, sf_dir), KEYS)
    out = versions(spark).join(counted, "v", "left").na.fill(0, ["keys", "tombstones", "tombstone_deletes", "key_replaces"])
    return out.select("v", F.col("parent").cast("int"), "is_leaf", "keys", "tombstones", "tombstone_deletes", "key_replaces")


@query(
    "SELECT user_id, ts AS begun, ended FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS ended FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND nk = 'purchase'"
)
def trace_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.intervals(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", "view", "purchase")


@query(
    "SELECT from_site, to_site, CAST(count(*) AS BIGINT) AS n, min(us) AS least, max(us) AS most, CAST(sum(us) // count(*) AS BIGINT) AS mean FROM (SELECT lag(event_type) OVER w AS from_site, event_type AS to_site, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_site IS NOT NULL GROUP BY ALL"
)
def trace_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timelines(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def trace_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rates(table(spark, sf_dir, "events"), "ts", "1 day").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


@query(sql(_newest("d0, d1, seq", "qv = 8")))
def array_sorted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read over arrays that are scanned and sorted one by one and then merged."""
    rows = log(spark, sf_dir)
    parts = [rows.where(F.col("data_age") == a).sortWithinPartitions(*KEYS, F.col("v").desc()) for a in range(11)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return resolve.visible(whole, tree(), KEYS, 8).select("d0", "d1", "seq")


for _name, (_query, _sql) in store_queries.queries(_count_sql, _COUNTED).items():
    QUERIES[_name], ORACLES[_name] = _query, _sql


__all__ = ["ORACLES", "QUERIES", "VersionTree", "tree"]
