"""The version tree: numbering, ancestry, deletion and health.

The tree lives on the driver (at most 50,000 versions ever). Queries get it as a
small DataFrame whose intervals answer ancestry: c is an ancestor of v, or v
itself, if v.o lies between c.o and c.r.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import MAX_LIVE_VERSIONS, MAX_VERSIONS, VERSIONS, StoreError


#: Trees up to so many versions are written into the plan.
INLINE_ROWS = 1000


@dataclass
class Version:
    v: int
    parent: int
    deleted: bool = False
    creation_ts: int | None = None
    immute_ts: int | None = None


@dataclass
class VersionTree:
    """Versions of one tree in the order of their making; version 0 is never made."""

    versions: dict[int, Version] = field(default_factory=dict)

    def children(self, v: int) -> list[int]:
        """Newest first."""
        return sorted((x.v for x in self.versions.values() if x.parent == v), reverse=True)

    def add(self, v: int, parent: int, now: int | None = None) -> Version:
        if parent and parent not in self.versions:
            raise StoreError(10)
        if parent and self.versions[parent].deleted:
            raise StoreError("ECANCELED", "the parent is deleted")
        if sum(not x.deleted for x in self.versions.values()) >= MAX_LIVE_VERSIONS or v > MAX_VERSIONS:
            raise StoreError("E2BIG", "too many versions")
        if parent and self.versions[parent].immute_ts is None:
            self.versions[parent].immute_ts = now
        self.versions[v] = Version(v, parent, creation_ts=now)
        return self.versions[v]

    def numbering(self) -> dict[int, tuple[int, int]]:
        """{version: (o, r)}: first visit, and the last number below, newest child first."""
        kids: dict[int, list[int]] = {}
        for x in sorted(self.versions):
            kids.setdefault(self.versions[x].parent, []).append(x)
        order: dict[int, int] = {}
        last: dict[int, int] = {}
        stack = [(x, False) for x in kids.get(0, [])]
        while stack:
            v, done = stack.pop()
            if done:
                last[v] = len(order)
                continue
            order[v] = len(order) + 1
            stack.append((v, True))
            stack += [(c, False) for c in kids.get(v, [])]  # the newest is popped first
        return {v: (order[v], last[v]) for v in order}

    def is_mutable(self, v: int) -> bool:
        """Without any child, so that it can be written."""
        return not any(x.parent == v for x in self.versions.values())

    def leaves(self) -> set[int]:
        """The versions below which all, if anything, is deleted; one pass from the deepest up."""
        order = sorted((o, v) for v, (o, _) in self.numbering().items())
        alive: set[int] = set()
        for _, v in reversed(order):
            x = self.versions[v]
            if not x.deleted or v in alive:
                alive.add(x.parent)
        return set(self.versions) - alive

    def is_leaf(self, v: int) -> bool:
        return v in self.leaves()

    def live_parent(self, v: int) -> int:
        v = self.versions[v].parent
        while v and self.versions[v].deleted:
            v = self.versions[v].parent
        return v

    def ancestors(self, v: int) -> list[int]:
        """The version and those above it, nearest first."""
        if v not in self.versions:
            raise StoreError(10)
        out = []
        while v:
            out.append(v)
            v = self.versions[v].parent
        return out

    def delete(self, v: int) -> bool:
        """Mark as deleted; true if no live version is left, so that the tree goes."""
        if v not in self.versions or self.versions[v].deleted:
            raise StoreError(10)
        self.versions[v].deleted = True
        return all(x.deleted for x in self.versions.values())

    def health(self) -> dict[str, int]:
        """live; deleted (others below still need its data) and dead (a logical leaf)."""
        out, leaves = {"live": 0, "deleted": 0, "dead": 0, "total": len(self.versions)}, self.leaves()
        for x in self.versions.values():
            out["live" if not x.deleted else "dead" if x.v in leaves else "deleted"] += 1
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        numbers, leaves, parents = self.numbering(), self.leaves(), {x.parent for x in self.versions.values()}
        rows = [(x.v, x.parent, *numbers[x.v], x.deleted, x.v in leaves, x.v not in parents, self.live_parent(x.v), x.creation_ts, x.immute_ts) for x in self.versions.values()]
        if not rows or len(rows) > INLINE_ROWS:
            return spark.createDataFrame(rows, VERSIONS)
        # an inline table takes part in planning and needs no job of its own
        text = {bool: lambda x: str(x).lower(), int: lambda x: f"{x}L", type(None): lambda _: "CAST(NULL AS BIGINT)"}
        return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(text[type(x)](x) for x in r) + ')' for r in rows)} AS t({', '.join(VERSIONS.names)})")


def ancestry(versions: DataFrame) -> DataFrame:
    """(qv, qo, v, o): every version with each of its ancestors and itself."""
    q = versions.select(F.col("v").alias("qv"), F.col("o").alias("qo"))
    return q.join(F.broadcast(versions.select("v", "o", "r")), F.col("qo").between(F.col("o"), F.col("r"))).select("qv", "qo", "v", "o")


def leaves(versions: DataFrame) -> DataFrame:
    """(v, mutable, leaf): no children at all, and none that is live below."""
    below = versions.select(F.col("o").alias("co"), F.col("deleted").alias("cd"))
    pairs = versions.join(F.broadcast(below), (F.col("co") > F.col("o")) & (F.col("co") <= F.col("r")), "left")
    return pairs.groupBy("v").agg((F.count("co") == 0).alias("mutable"), F.coalesce(F.every("cd"), F.lit(True)).alias("leaf"))


def live_parents(versions: DataFrame) -> DataFrame:
    """(v, live_parent): the nearest ancestor that is not deleted, or 0."""
    up = versions.where("not deleted").select(F.col("v").alias("av"), F.col("o").alias("ao"), F.col("r").alias("ar"))
    pairs = versions.join(F.broadcast(up), (F.col("ao") < F.col("o")) & (F.col("o") <= F.col("ar")), "left")
    return pairs.groupBy("v").agg(F.coalesce(F.max_by("av", "ao"), F.lit(0)).alias("live_parent"))


def health_counts(versions: DataFrame) -> DataFrame:
    """One row: live, deleted, dead, total."""
    state = versions.join(leaves(versions), "v")
    count = lambda c: F.count_if(c)
    return state.agg(
        count(~F.col("deleted")).alias("live"), count(F.col("deleted") & ~F.col("leaf")).alias("deleted"), count(F.col("deleted") & F.col("leaf")).alias("dead"), F.count(F.lit(1)).alias("total")
    )
