"""Version tree and operation log derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.versions import VersionTree

#: Fixed values: (version, parent) in the order of making.
TREE = ((1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6))
KEYS = ["d0", "d1"]
DAY_S = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(deleted: tuple[int, ...] = ()) -> VersionTree:
    """The tree, with versions made a day apart from time 0 on."""
    t = VersionTree()
    for v, parent in TREE:
        t.add(v, parent, v * DAY_S)
    for v in deleted:
        t.delete(v)
    return t


def versions(spark: SparkSession, deleted: tuple[int, ...] = ()) -> DataFrame:
    return tree(deleted).frame(spark)


def log(spark: SparkSession, sf_dir: str, counters: bool = False) -> DataFrame:
    """seq, d0, d1, op, n, uts, v, data_age; without ``counters`` every write is a value or tombstone."""
    day, odd = F.dayofmonth("ts"), (F.col("event_id") % 2).cast("long")
    kind = F.col("event_type")
    plain = F.when(kind == "error", "TOMBSTONE").otherwise("VALUE")
    op = F.when(kind == "signup", "COUNTER_SET").when(kind == "error", "TOMBSTONE").when(kind == "purchase", "VALUE").otherwise("COUNTER_ADD") if counters else plain
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("d0"), (F.col("event_id") % 7).alias("d1"), op.alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("n"), ((F.col("event_id") * 7919) % 10007).alias("uts"),
        F.when(day <= 5, 1).when(day <= 10, 2).when(day <= 15, 3 + odd).when(day <= 20, 5 + odd).otherwise(7 + odd).cast("long").alias("v"),
        F.floor((day - 1) / 3).cast("long").alias("data_age"),
    )


_OP = {
    False: "CASE event_type WHEN 'error' THEN 'TOMBSTONE' ELSE 'VALUE' END",
    True: "CASE event_type WHEN 'signup' THEN 'COUNTER_SET' WHEN 'error' THEN 'TOMBSTONE' WHEN 'purchase' THEN 'VALUE' ELSE 'COUNTER_ADD' END",
}


def sql(body: str, counters: bool = False, deleted: tuple[int, ...] = ()) -> str:
    """A query over ver(v, parent, o, r, deleted) and log, for DuckDB."""
    rows = ", ".join(f"({v}, {p}, {o}, {r}, {str(v in deleted).lower()})" for (v, p), (o, r) in zip(TREE, ((1, 8), (2, 8), (6, 8), (3, 5), (7, 8), (4, 5), (8, 8), (5, 5))))
    return f"""WITH ver(v, parent, o, r, deleted) AS (VALUES {rows}),
log AS (SELECT event_id AS seq, user_id AS d0, event_id % 7 AS d1, {_OP[counters]} AS op,
  CAST(round(value * 100) AS BIGINT) AS n, (event_id * 7919) % 10007 AS uts,
  CASE WHEN extract(day FROM ts) <= 5 THEN 1 WHEN extract(day FROM ts) <= 10 THEN 2 WHEN extract(day FROM ts) <= 15 THEN 3 + event_id % 2
       WHEN extract(day FROM ts) <= 20 THEN 5 + event_id % 2 ELSE 7 + event_id % 2 END AS v,
  CAST(floor((extract(day FROM ts) - 1) / 3) AS BIGINT) AS data_age FROM events),
anc AS (SELECT l.*, q.v AS qv, a.o AS ao FROM log l JOIN ver a ON l.v = a.v JOIN ver q ON q.o BETWEEN a.o AND a.r)
{body}"""
