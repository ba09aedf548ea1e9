"""Reads: point, multi-key, range and hypercube, paging and value chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import after, in_box
from palimpsest.operators.resolve import counters, visible
from palimpsest.schema import MAX_INLINE_BYTES, TOMBSTONE, StoreError
from palimpsest.versions import VersionTree


def get(log: DataFrame, versions: DataFrame | VersionTree, version: int, key: dict, timestamped: bool = False, tombstones: bool = False) -> DataFrame:
    """The entry of one key that a version sees; no row if there is none.

    The key's values reach the scan as pushed filters.
    """
    for name, x in key.items():
        log = log.where(F.col(name) == F.lit(x))
    return visible(log, versions, list(key), version, timestamped, tombstones)


def multi_get(log: DataFrame, versions: DataFrame | VersionTree, version: int, wanted: DataFrame, keys: list[str], timestamped: bool = False) -> DataFrame:
    """The entries of many keys at once: a semi join before anything is resolved."""
    return visible(log.join(wanted.select(*keys).distinct(), keys, "left_semi"), versions, keys, version, timestamped)


def check_bounds(keys: list[str], low: list, high: list) -> None:
    if not (len(keys) == len(low) == len(high)) or not keys:
        raise StoreError("EINVAL", "bounds must have the dimensions of the key")


def scan(
    log: DataFrame, versions: DataFrame | VersionTree, version: int, keys: list[str], low: list, high: list, *,
    timestamped: bool = False, tombstones: bool = False, values: bool = True, out_of_line: bool = True, user_timestamps: bool = False, tree_timestamped: bool | None = None,
) -> DataFrame:
    """The visible entries inside an inclusive box, one bound a dimension, None open.

    Options are those of a cursor: keys only, with or without values larger than
    an inline one, with user timestamps (null if not asked for), with tombstones
    (flagged). Order it by the key columns, or page with ``page``.
    """
    check_bounds(keys, low, high)
    if user_timestamps and tree_timestamped is False:
        raise StoreError("EINVAL", "the tree has no user timestamps")
    inside = log.where(in_box([F.col(k) for k in keys], low, high))
    out = visible(inside, versions, keys, version, timestamped, tombstones)
    if tombstones:
        out = out.withColumn("is_tombstone", F.col("op") == TOMBSTONE)
    if not values:
        return out.select(*keys, *(["is_tombstone"] if tombstones else []))
    if not out_of_line and "value" in out.columns:
        out = out.withColumn("value", F.when(F.length("value") <= MAX_INLINE_BYTES, F.col("value")))
    if not user_timestamps and "uts" in out.columns:
        out = out.withColumn("uts", F.lit(None).cast("long"))
    return out


def scan_counters(log: DataFrame, versions: DataFrame | VersionTree, version: int, keys: list[str], low: list, high: list) -> DataFrame:
    """(keys.., op, n) of the counters inside a box."""
    check_bounds(keys, low, high)
    return counters(log.where(in_box([F.col(k) for k in keys], low, high)), versions, keys, version)


def page(rows: DataFrame, keys: list[str], size: int, last: list | None = None) -> DataFrame:
    """The next ``size`` rows in key order behind the key ``last``; a top-k, no full sort."""
    if last is not None:
        rows = rows.where(after([F.col(k) for k in keys], last))
    return rows.orderBy(*keys).limit(size)


def chunks(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, chunk_no, chunk): values cut into pieces of ``size`` bytes; empty ones give one."""
    n = F.greatest(F.ceil(F.length(value) / size), F.lit(1))
    parts = rows.select(key, value, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_no"))
    return parts.select(key, "chunk_no", F.substring(F.col(value), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def assemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, value), and uts where the chunks have it (the greatest): chunks put together in order. One value is one group."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    joined = F.aggregate(ordered, F.lit(b""), lambda out, c: F.concat(out, c["chunk"]))
    return parts.groupBy(key).agg(joined.alias("value"), *([F.max("uts").alias("uts")] if "uts" in parts.columns else []))
