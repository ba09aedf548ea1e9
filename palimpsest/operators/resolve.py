"""Resolution: which entry of a key a version sees.

A log row is (key columns.., v, seq, op, n, uts, ..). Inside one lineage a deeper
version means a later write, so seq orders all entries that a version can see.
Answers come from aggregates that combine before the shuffle; counters fold in
ordered pieces of the log first, so that a hot key never meets in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.schema import COUNTER_ADD, COUNTER_SET, TOMBSTONE, VALUE
from palimpsest.versions import VersionTree

#: Pieces of the log in which counters fold before they are put together.
PIECES = 64


def lineage(log: DataFrame, versions: DataFrame | VersionTree, version: int | None = None) -> DataFrame:
    """Log rows with each version qv that sees them (all versions, or one).

    For one version of a tree at hand its ancestors are literals, which reach the
    scan. Otherwise the version table (at most 50,000 rows) is broadcast.
    """
    if isinstance(versions, VersionTree):
        if version is not None:
            return log.where(F.col("v").isin(versions.ancestors(version))).withColumn("qv", F.lit(version).cast("long"))
        versions = versions.frame(log.sparkSession)
    a = versions.select(F.col("v"), F.col("o").alias("ao"), F.col("r").alias("ar"))
    q = versions.select(F.col("v").alias("qv"), F.col("o").alias("qo"))
    if version is not None:
        q = q.where(F.col("qv") == version)
    pairs = q.join(a, F.col("qo").between(F.col("ao"), F.col("ar"))).select("qv", "v")
    return log.join(F.broadcast(pairs), "v")


def matching(log: DataFrame, version: int) -> DataFrame:
    """The entries written at exactly one version; the equality reaches the scan."""
    return log.where(F.col("v") == version)


def newest(rows: DataFrame, by: list[str], timestamped: bool = False) -> DataFrame:
    """The winning row of each group: greatest seq, or greatest (uts, seq)."""
    order = ["uts", "seq"] if timestamped else ["seq"]
    rest = [c for c in rows.columns if c not in by and c not in order]
    best = F.max(F.struct(*order, F.struct(*rest).alias("rest")))
    out = rows.groupBy(*by).agg(best.alias("best"))
    return out.select(*by, *(f"best.{c}" for c in order), *(F.col("best.rest")[c].alias(c) for c in rest)).select(rows.columns)


def visible(log: DataFrame, versions: DataFrame | VersionTree, keys: list[str], version: int | None = None, timestamped: bool = False, tombstones: bool = False) -> DataFrame:
    """What each version sees of each key: columns qv, then those of the log.

    Tombstones hide their key, unless asked for.
    """
    seen = lineage(log, versions, version)
    out = newest(seen, ["qv", *keys], timestamped)
    return out if tombstones else out.where(F.col("op") != TOMBSTONE)


def read(log: DataFrame, versions: DataFrame | VersionTree, keys: list[str], version: int, timestamped: bool = False, tombstones: bool = False, counted: bool = True) -> DataFrame:
    """As ``visible``, with counters as a read gives them: op COUNTER_SET and the whole count in n.

    A log without any counter need not be folded: ``counted`` false.
    """
    seen = lineage(log, versions, version)
    by = ["qv", *keys]
    out = newest(seen, by, timestamped)
    if not counted:
        return out if tombstones else out.where(F.col("op") != TOMBSTONE)
    counts = count(seen, by).where(F.col("op") == COUNTER_SET).select(*by, F.col("n").alias("__n"))
    is_counter = F.col("op").isin(COUNTER_SET, COUNTER_ADD)
    out = out.join(counts, by, "left").withColumn("n", F.when(is_counter, F.col("__n")).otherwise(F.col("n"))).withColumn("op", F.when(is_counter, COUNTER_SET).otherwise(F.col("op"))).select(out.columns)
    return out if tombstones else out.where(F.col("op") != TOMBSTONE)


def latest(log: DataFrame, keys: list[str], timestamped: bool = False, tombstones: bool = False) -> DataFrame:
    """The winning row of each key where all rows belong to one lineage."""
    out = newest(log, keys, timestamped)
    return out if tombstones else out.where(F.col("op") != TOMBSTONE)


def fold_pieces(rows: DataFrame, by: list[str], pieces: int = PIECES, log: DataFrame | None = None) -> DataFrame:
    """Composite counters: one row a group and piece of the log.

    base is the last entry of the piece that is no ADD (seq, op, n and all other
    columns; null if there is none), added the sum of ADDs behind it, last the newest seq. Composites of
    two neighbouring pieces make one by the same rule, so any grouping of pieces
    gives the same count. Pieces are equal ranges of seq over ``log`` (or ``rows``).
    """
    if pieces > 1:
        ends = (rows if log is None else log).agg(F.min("seq").alias("__lo"), F.max("seq").alias("__hi"))
        piece = F.expr(f"(seq - __lo) div ((__hi - __lo) div {pieces} + 1)")  # divides first, so that no span overflows
        rows = rows.join(F.broadcast(ends)).withColumn("piece", piece).drop("__lo", "__hi")
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    entry = ["seq", "op", "n", *(c for c in rows.columns if c not in {*by, "seq", "op", "n", "piece"})]
    is_add = F.col("op") == COUNTER_ADD
    group = Window.partitionBy(*by, "piece")
    rows = rows.withColumn("base_seq", F.max(F.when(~is_add, F.col("seq"))).over(group))
    return rows.groupBy(*by, "piece").agg(
        F.max(F.when(~is_add, F.struct(*entry))).alias("base"),
        F.coalesce(F.sum(F.when(is_add & (F.col("seq") > F.coalesce("base_seq", F.lit(-1))), F.col("n"))), F.lit(0)).alias("added"),
        F.max("seq").alias("last"),
        F.count(F.when(is_add & (F.col("seq") > F.coalesce("base_seq", F.lit(-1))), 1)).alias("adds"),
    )


def combine(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., base, added, adds, last): the composites of all pieces put together.

    At most one row a piece meets in a group.
    """
    at = F.max(F.when(F.col("base").isNotNull(), F.struct("piece", "base"))).over(Window.partitionBy(*by))
    parts = parts.withColumn("at", at).withColumn("newest", F.max("last").over(Window.partitionBy(*by)))
    parts = parts.where(F.col("at").isNull() | (F.col("piece") >= F.col("at.piece")))
    return parts.groupBy(*by).agg(F.sum("added").alias("added"), F.sum("adds").alias("adds"), F.max("at.base").alias("base"), F.max("newest").alias("last"))


def count(rows: DataFrame, by: list[str], pieces: int = PIECES, log: DataFrame | None = None) -> DataFrame:
    """(by.., op, n): what a read of each counter gives.

    The newest entry decides: a tombstone gives op TOMBSTONE, a value VALUE with
    its n; otherwise the ADDs behind the last other entry are summed, from the n of a
    SET or else from 0. Sums wrap like 64-bit integers only beyond their range,
    where Spark raises an error instead.
    """
    total = combine(fold_pieces(rows, by, pieces, log), by)
    kind = F.col("base.op")
    plain = (F.col("adds") == 0) & kind.isin(VALUE, TOMBSTONE)
    return total.select(*by, F.when(plain, kind).otherwise(COUNTER_SET).alias("op"), F.when(plain, F.col("base.n")).otherwise(F.col("added") + F.when(kind == COUNTER_SET, F.col("base.n")).otherwise(0)).alias("n"))


def counters(log: DataFrame, versions: DataFrame | VersionTree, keys: list[str], version: int | None = None) -> DataFrame:
    """(qv, keys.., op, n) of every key that each version sees, tombstones left out."""
    seen = lineage(log, versions, version)
    return count(seen, ["qv", *keys], log=log).where(F.col("op") != TOMBSTONE)


def one_version_counts(log: DataFrame, keys: list[str], pieces: int = PIECES) -> DataFrame:
    """The entries of each key and version folded into one, as a merge stores them.

    Columns are those of ``log``. A value or tombstone that is newest stays as it
    is. Without a base the sum stays an ADD, to be added to what ancestors hold;
    otherwise it is a SET. Sums have null in the other columns.
    """
    total = combine(fold_pieces(log, ["v", *keys], pieces), ["v", *keys])
    kind, added = F.col("base.op"), F.col("adds") > 0
    whole = F.coalesce(~added & kind.isin(VALUE, TOMBSTONE), F.lit(False))
    folded = {
        "op": F.when(kind.isNull(), COUNTER_ADD).when(whole, kind).otherwise(COUNTER_SET),
        "n": F.when(whole, F.col("base.n")).otherwise(F.col("added") + F.when(kind == COUNTER_SET, F.col("base.n")).otherwise(0)),
        "seq": F.col("last"),
    }
    out = {c: folded.get(c, F.when(whole, F.col("base")[c])) for c in log.columns if c not in ("v", *keys)}
    return total.select(*(F.col(c) if c in ("v", *keys) else out[c].alias(c) for c in log.columns))


def timestamp_rejects(log: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Writes older by user timestamp than an earlier write that their version sees.

    A store that resolves in memory rejects such a write; here all rows stay and
    lose at read time, which gives the same answers.
    """
    pairs = versions.select(F.col("v"), F.col("o").alias("qo"))
    a = versions.select(F.col("v").alias("av"), F.col("o").alias("ao"), F.col("r").alias("ar"))
    pairs = pairs.join(a, F.col("qo").between(F.col("ao"), F.col("ar"))).select(F.col("v"), "av")
    up = log.join(F.broadcast(pairs.withColumnsRenamed({"v": "qv", "av": "v"})), "v")
    order = Window.partitionBy("qv", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # every version's view of the key, with the greatest earlier timestamp; its own rows are judged
    seen = up.withColumn("best", F.max("uts").over(order))
    return seen.where((F.col("qv") == F.col("v")) & (F.col("best") > F.col("uts"))).select(log.columns)


def value_kind(op: Column, value: Column, inline: int = 512) -> Column:
    """The kind of value that a read returns."""
    return F.when(op == TOMBSTONE, "TOMBSTONE").when(op.isin(COUNTER_SET, COUNTER_ADD), "INLINE_COUNTER").when(F.length(value) > inline, "OUT_OF_LINE").otherwise("INLINE")
