"""Merging arrays: duplicate elimination and collection of what no read needs.

``merge`` first keeps one entry of each (key, version), a plain aggregate. What
else may go depends only on the entries of one key, at most one a version, so
these meet in one row as an array (bounded by the live versions of a tree) and
are judged by array functions. Reads give the same before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import newest, one_version_counts
from palimpsest.schema import COUNTER_ADD, COUNTER_SET, TOMBSTONE, StoreError


def check_contiguous(arrays: DataFrame, chosen: list[int]) -> None:
    """Refuse arrays that are no unbroken run of mergeable ones, newest first.

    Errors: 101 none chosen, 107 unknown, 108 already merging, 110 a gap, 114
    beyond a backup barrier. The catalogue of arrays is small.
    """
    if not chosen:
        raise StoreError(101)
    rows = arrays.orderBy(F.col("data_age").desc(), F.col("array_id").desc()).collect()
    at = {r["array_id"]: i for i, r in enumerate(rows)}
    if any(a not in at for a in chosen):
        raise StoreError(107)
    spots = sorted(at[a] for a in chosen)
    run = rows[spots[0] : spots[-1] + 1]
    if any(r["is_barrier"] for r in run):
        raise StoreError(114)
    if any(r["merge_state"] != "idle" for r in run if r["array_id"] in chosen):
        raise StoreError(108)
    if len(run) != len(set(chosen)):
        raise StoreError(110)


def contiguity(arrays: DataFrame, chosen: str = "chosen") -> DataFrame:
    """(chosen, gaps, barriers): what ``check_contiguous`` looks at, as a query."""
    span = arrays.where(chosen).agg(F.min("data_age").alias("lo"), F.max("data_age").alias("hi"))
    inside = arrays.join(F.broadcast(span), F.col("data_age").between(F.col("lo"), F.col("hi")))
    return inside.agg(F.count_if(F.col(chosen)).alias("chosen"), F.count_if(~F.col(chosen) & ~F.col("is_barrier")).alias("gaps"), F.count_if("is_barrier").alias("barriers"))


def distinct_entries(log: DataFrame, keys: list[str], timestamped: bool = False, counter: bool = False) -> DataFrame:
    """One entry for each key and version: the newest, or the folded counter."""
    return one_version_counts(log, keys) if counter else newest(log, [*keys, "v"], timestamped)


def shadowed(log: DataFrame, keys: list[str], timestamped: bool = False) -> DataFrame:
    """The entries that ``distinct_entries`` leaves out."""
    kept = distinct_entries(log, keys, timestamped).select(F.col("seq").alias("__seq"))
    return log.join(kept, log["seq"] == kept["__seq"], "left_anti")


def _per_key(rows: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., es): the entries of each key with their place in the version tree."""
    place = versions.select("v", "o", "r", "deleted", *(c for c in ("is_leaf", "is_mutable", "immute_ts") if c in versions.columns))
    rows = rows.join(F.broadcast(place), "v")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("o", *(c for c in rest if c != "o"))).alias("es"))


def _unpack(grouped: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    flat = grouped.select(*keys, F.explode("es").alias("e"))
    return flat.select(*(c if c in keys else F.col("e")[c].alias(c) for c in columns))


def _above(x: Column, e: Column) -> Column:
    """x is a strict ancestor of e."""
    return (x["o"] < e["o"]) & (e["o"] <= x["r"])


def _nearest_above(es: Column, e: Column) -> Column:
    """The nearest strict ancestor's entry, or null."""
    return F.array_max(F.filter(es, lambda x: _above(x, e)))


def resolve_timestamps(rows: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Without the entries that an ancestor's entry of the key outdates; counters stay."""
    grouped = _per_key(rows, versions, keys)
    outdated = lambda e: F.exists("es", lambda x: _above(x, e) & (x["uts"] > e["uts"]))
    counter = lambda e: e["op"].isin(COUNTER_SET, COUNTER_ADD)
    return _unpack(grouped.withColumn("es", F.filter("es", lambda e: counter(e) | ~outdated(e))), rows.columns, keys)


def discard_tombstones(rows: DataFrame, versions: DataFrame, keys: list[str], *, timestamped: bool = False, now: int = 0, period: int = 0, least_other_uts: int | None = None) -> DataFrame:
    """Without the tombstones that hide nothing; only for merges with the oldest array.

    One goes if its nearest ancestor's entry is missing or a tombstone. In a
    timestamped tree its version must also have been frozen for longer than
    ``period``, no array outside may hold an older timestamp, and no entry of a
    version below may have a smaller one: that would come back.
    """
    grouped = _per_key(rows, versions, keys)

    def goes(e: Column) -> Column:
        up = _nearest_above(F.col("es"), e)
        out = (e["op"] == TOMBSTONE) & (up.isNull() | (up["op"] == TOMBSTONE))
        if timestamped:
            frozen = ~e["is_mutable"] & (F.lit(now) - F.coalesce(e["immute_ts"], F.lit(now)) > period)
            out = out & frozen & ~F.exists("es", lambda x: _above(e, x) & (x["uts"] < e["uts"]))
            if least_other_uts is not None:
                out = out & (e["uts"] <= least_other_uts)
        return out

    return _unpack(grouped.withColumn("es", F.filter("es", lambda e: ~goes(e))), rows.columns, keys)


def _needed(es: Column, live: Column) -> Column:
    """The entries of which a live version's nearest entry is one, flagged in ``keep``."""

    def keep(e: Column) -> Column:
        reads = lambda w: (e["o"] <= w) & (w <= e["r"]) & ~F.exists(es, lambda x: _above(e, x) & (x["o"] <= w) & (w <= x["r"]))
        return ~e["deleted"] | F.exists(live, reads)

    return F.transform(es, lambda e: e.withField("keep", keep(e)))


def collect_deleted(rows: DataFrame, versions: DataFrame, keys: list[str], counter: bool = False) -> DataFrame:
    """Without the entries of deleted versions that no live version reads.

    With ``counter`` they are folded first into the ADDs that build on them.
    """
    live = F.array(*(F.lit(r["o"]) for r in versions.where("not deleted").select("o").collect())).cast("array<bigint>")
    grouped = _per_key(rows, versions, keys).withColumn("es", _needed(F.col("es"), live))
    if counter:
        grouped = grouped.withColumn("es", F.transform("es", lambda e: _push_down(F.col("es"), e)))
    return _unpack(grouped.withColumn("es", F.filter("es", lambda e: e["keep"])), rows.columns, keys)


def _push_down(es: Column, e: Column) -> Column:
    """An ADD with the dropped entries above it folded in, up to one that stays."""
    up = F.reverse(F.array_sort(F.filter(es, lambda x: _above(x, e))))
    start = F.struct(e["n"].alias("n"), e["op"].alias("op"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        add, put = x["op"] == COUNTER_ADD, x["op"] == COUNTER_SET
        on = ~acc["done"] & ~x["keep"]
        return F.struct(
            F.when(on & (add | put), acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"),
            F.when(on & ~add, F.lit(COUNTER_SET)).otherwise(acc["op"]).alias("op"),
            (acc["done"] | x["keep"] | ~add).alias("done"),
        )

    folded = F.aggregate(up, start, step)
    return F.when(e["op"] == COUNTER_ADD, e.withField("n", folded["n"]).withField("op", folded["op"])).otherwise(e)


def merge(log: DataFrame, versions: DataFrame, keys: list[str], *, timestamped: bool = False, counter: bool = False, oldest: bool = False, now: int = 0, period: int = 0, least_other_uts: int | None = None) -> DataFrame:
    """The entries of the arrays in ``log`` as one array holds them.

    ``counter`` is for logs with any counter entries, of whatever keys; it is
    right for others too, at the price of a sort. ``oldest`` tells that nothing
    older lies outside: only then may tombstones and entries of deleted versions go.
    """
    out = distinct_entries(log, keys, timestamped, counter)
    if timestamped and not counter:
        out = resolve_timestamps(out, versions, keys)
    if oldest:
        if not (timestamped and counter):
            out = discard_tombstones(out, versions, keys, timestamped=timestamped, now=now, period=period, least_other_uts=least_other_uts)
        out = collect_deleted(out, versions, keys, counter)
    return out


def merge_age(arrays: DataFrame) -> DataFrame:
    """The age of a merge's output: the least of its inputs'."""
    return arrays.agg(F.min("data_age").alias("data_age"))
