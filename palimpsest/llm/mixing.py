"""Mixing sources to target weights along a training curriculum; DataFrame functions only.

Every source has a share of the mix and a schedule, its relative weight over
training time from 0 to 1. The integral of the schedule says which part of the
source's tokens has been read by each time; inverted, it gives every copy of a
document the time at which it is read. Sorting by that range-partitions the mix.

Order within a source is by a keyed hash of doc_id and text. Running sums go in two steps,
over 4096 hash buckets of a source and inside each bucket, so that a source with
a third of all rows still spreads over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import SPACE, cut, staged

#: Fixed values of the mix: weights by turns, the size of the mix, and copies at most.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Schedules by turns, as (time, relative weight) knots: fading, growing and even sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
SEED = "mix"


def word_count(text: Column) -> Column:
    """The number of words of a text; zero for null."""
    inside = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, SPACE))).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, nth, source_size, target): targets that fill caps of ``repeats`` times a size.

    Sources sort by the ratio of cap to weight. Those that fill up are the first
    ones, and one pass of running sums finds where the rest, sharing by weight
    what is left, stay below their caps. One row a source meets in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("nth"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    t = t.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(float(repeats))).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    whole = Window.partitionBy(F.lit(0))
    t = t.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = F.col("left") / F.col("rest")
    t = t.select("*", F.when(level * F.col("weight") < F.col("cap"), level).alias("level"))
    # levels fall after the first source that does not fill up: its level is the greatest, and holds for all
    t = t.select("*", F.max("level").over(whole).alias("common"))
    return t.select("source", "nth", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), "cap").alias("target"))


def _segments(schedule: tuple) -> Column:
    """The pieces of a schedule with their cumulative shares, as an array of structs."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1, w0, w1, total, total := total + (w0 + w1) / 2 * (t1 - t0)))
    names = ("t0", "t1", "w0", "w1", "f0", "f1")
    return F.array(*(F.struct(*(F.lit(float(v / total if k[0] == "f" else v)).alias(k) for k, v in zip(names, p)), F.lit(float(total)).alias("total")) for p in pieces))


def reading_time(share: Column, segments: Column) -> Column:
    """The time by which a share of a source's tokens has been read: the inverted integral."""
    s = F.element_at(F.filter(segments, lambda x: (share <= x["f1"]) | (x["t1"] >= 1.0)), 1)
    need = (share - s["f0"]) * s["total"]  # area wanted inside the piece
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    # w0 x + slope x^2 / 2 = need, in the form that holds for any slope
    return s["t0"] + 2 * need / (s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * need, F.lit(0.0))))


def _key(seed: str) -> Column:
    """The order inside a source; texts without an id do not all have one key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules: tuple = SCHEDULES, seed: str = SEED) -> DataFrame:
    """One row a document: size, source_size, target, copies, taken and its reading times.

    Returns doc_id, text_hash (xxhash64), source, size, source_size, target, copies, taken (size times
    copies) and positions (array, one time in [0, 1] a copy). Copies are whole
    documents: all as often as the target holds the source, and one more for the
    first documents in hash order up to the rest of the target, which is met to
    within half of one document. Sizes count words; null and empty texts have
    none and are taken with no words. Null sources are one source, the last.
    Rows that repeat a doc_id are documents of their own. Reruns agree, as all
    order is by hash of doc_id and text. An empty table gives an empty result.
    """
    sizes = staged(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key")), "sizes")
    # a broadcast bounded by the number of sources is left to the planner
    sources = targets(sizes, weights, share, repeats)
    rows = sizes.select("*", F.substring("key", 1, 3).alias("bucket"))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bucket.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    offsets = offsets.join(sources, offsets["source"].eqNullSafe(sources["source"])).select(offsets["source"].alias("of_source"), F.col("bucket").alias("of_bucket"), "offset", "nth", "source_size", "target")
    inner = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("doc_id", "text_hash", "source", "bucket", "size", F.coalesce(inner, F.lit(0)).alias("inner"))
    rows = rows.join(offsets, rows["source"].eqNullSafe(F.col("of_source")) & (rows["bucket"] == F.col("of_bucket")))
    start = F.col("offset") + F.col("inner")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("full") < repeats) & (F.col("start") + F.col("size") / 2 <= rest)
    rows = rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", "nth", start.alias("start"), full.cast("int").alias("full"))
    rows = rows.select("*", (F.col("full") + F.when(more, 1).otherwise(0)).alias("copies"))
    parts = F.element_at(F.array(*(_segments(s) for s in schedules)), (F.col("nth") % len(schedules) + 1).cast("int"))
    demand = lambda k: F.least((k * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.greatest("target", F.lit(1.0)), F.lit(1.0))
    times = F.when(F.col("copies") < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: reading_time(demand(k), parts)))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), times.alias("positions"))


def in_order(rows: DataFrame, time: str, partitions: int | None = None) -> DataFrame:
    """Rows range-sorted by a reading time in [0, 1]; those without one are dealt out and come last in each range.

    Partitions hold equal ranges of time, known without sampling.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.when(F.col(time).isNotNull(), F.least(F.floor(F.col(time) * n), F.lit(n - 1)))  # least() alone would pass over a null
    at = F.coalesce(own, F.pmod(F.xxhash64(*rows.columns), F.lit(n))).cast("int")
    return rows.repartitionById(n, at).sortWithinPartitions(F.col(time).asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, partitions: int | None = None, **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its plan has copies, in reading order.

    Columns stay as they are. Rows are told apart by doc_id and text, so rows that
    share or lack an id are taken by their own plans. Rows that repeat both are
    taken as often as their plans together: all alike, and what is left over by one
    of them.
    """
    shape = staged(plan(docs, **options).select("doc_id", "text_hash", "copies", "positions"), "plan")
    most = options.get("repeats", REPEATS)
    times = F.array(*(F.min(F.get("positions", F.lit(k))) for k in range(most)))
    shape = shape.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows"), times.alias("__times"))
    shape = shape.where("__all > 0").select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"), F.expr("cast(__all div __rows as int)").alias("__each"), F.expr("__all % __rows").alias("__more"), "__times")
    on = lambda d: d["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(d["text"]) == F.col("__hash"))
    rows = docs.join(shape, on(docs)).withColumn("__time", F.explode(F.slice("__times", 1, F.col("__each")))).select(*docs.columns, "__time")
    left = cut(shape.where("__more > 0").drop("__each"))
    if not left.isEmpty():
        one = docs.join(left, on(docs)).dropDuplicates(["__doc_id", "__hash"])
        more = one.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__more")))).withColumn("__time", F.array_max("__times"))
        rows = rows.unionByName(more.select(*docs.columns, "__time"))
    return in_order(rows, "__time", partitions).select(docs.columns)
