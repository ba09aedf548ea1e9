"""Statistics of arrays and versions, incremental backup and trace queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.schema import COUNTER_ADD, COUNTER_SET, TOMBSTONE


def array_stats(log: DataFrame, keys: list[str], by: str = "data_age", key_bytes: int = 0) -> DataFrame:
    """Items, bytes (a counter counts 16), user timestamps and versions of a key, per array."""
    size = F.when(F.col("op").isin(COUNTER_SET, COUNTER_ADD), 16).otherwise(F.coalesce(F.length("value"), F.lit(0)) if "value" in log.columns else F.lit(0))
    per_key = log.groupBy(by, *keys).agg(
        F.countDistinct("v").alias("versions"), F.count(F.lit(1)).alias("items"), F.sum(size + key_bytes).alias("bytes"), F.min("uts").alias("lo"), F.max("uts").alias("hi")
    )
    return per_key.groupBy(by).agg(
        F.sum("items").alias("item_count"), F.sum("bytes").alias("nr_bytes"), F.min("lo").alias("min_user_ts"), F.max("hi").alias("max_user_ts"), F.max("versions").alias("max_versions_per_key")
    )


def may_hold_newer(arrays: DataFrame, uts: int) -> DataFrame:
    """Arrays that can still change a read whose best user timestamp so far is ``uts``."""
    return arrays.where(F.col("max_user_ts") > uts)


def backup_rows(log: DataFrame, after: int, before: int) -> DataFrame:
    """The rows of the arrays between two barriers, tombstones included; the ages reach the scan."""
    return log.where((F.col("data_age") > after) & (F.col("data_age") < before))


def version_stats(log: DataFrame, keys: list[str], timestamped: bool = False) -> DataFrame:
    """Per version, what merging all its entries counts.

    An entry added counts as key or tombstone; one that the next newer entry of
    its key and version shadows is taken off again, as a replaced key or a
    tombstone's delete.
    """
    order = ["uts", "seq"] if timestamped else ["seq"]
    nxt = F.lead("op").over(Window.partitionBy("v", *keys).orderBy(*order))
    rows = log.select("v", (F.col("op") == TOMBSTONE).alias("dead"), nxt.alias("nxt"))
    key, gone = ~F.col("dead"), F.col("nxt").isNotNull()
    count = lambda c: F.count_if(c)
    return rows.groupBy("v").agg(
        (count(key) - count(key & gone)).alias("keys"),
        (count(F.col("dead")) - count(F.col("dead") & gone)).alias("tombstones"),
        count(key & (F.col("nxt") == TOMBSTONE)).alias("tombstone_deletes"),
        count(key & (F.col("nxt") != TOMBSTONE)).alias("key_replaces"),
    )


def discard_stats(before: DataFrame, after: DataFrame, keys: list[str], versions: DataFrame, timestamped: bool) -> DataFrame:
    """(v, version_deletes, timestamp_rejects): what a merge dropped, by cause.

    ``before`` has one entry a key and version. Tombstones that go from a tree of user
    timestamps may have gone by age, so they are no rejects.
    """
    gone = before.join(after.select(*keys, "v"), [*keys, "v"], "left_anti").join(F.broadcast(versions.select("v", "deleted")), "v")
    return gone.groupBy("v").agg(F.count_if("deleted").alias("version_deletes"), F.count_if(~F.col("deleted") & (F.col("op") != TOMBSTONE) & F.lit(timestamped)).alias("timestamp_rejects"))


def intervals(events: DataFrame, by: list[str], time: str, kind: str, start: str, end: str) -> DataFrame:
    """(by.., begun, ended): every start with the end that follows it next in its group."""
    group = Window.partitionBy(*by).orderBy(time, "event_id")
    rows = events.where(F.col(kind).isin(start, end)).select(*by, time, kind, F.lead(kind).over(group).alias("next_kind"), F.lead(time).over(group).alias("ended"))
    return rows.where((F.col(kind) == start) & (F.col("next_kind") == end)).select(*by, F.col(time).alias("begun"), "ended")


def timelines(events: DataFrame, by: list[str], time: str, site: str) -> DataFrame:
    """(from_site, to_site, n, least, most, mean): microseconds between neighbouring checkpoints."""
    group = Window.partitionBy(*by).orderBy(time, "event_id")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    steps = events.select(F.lag(site).over(group).alias("from_site"), F.col(site).alias("to_site"), (micros - F.lag(micros).over(group)).alias("us")).where("from_site is not null")
    return steps.groupBy("from_site", "to_site").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("least"), F.max("us").alias("most"), F.expr("sum(us) div count(us)").alias("mean"))


def rates(events: DataFrame, time: str, width: str) -> DataFrame:
    """(bucket, n): events in tumbling windows."""
    return events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "n")
