"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins on node ids. Nothing is gathered
on the driver but two numbers a round, and no group is collected into a row, so
a node with very many neighbours costs a partial aggregate, not a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, scratch, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is its least node.

    Self loops, repeated and reversed edges and null ends are allowed; loops and
    nulls add nothing. Ids may be of any ordered type. An empty table gives an
    empty result.
    """
    with scratch(edges.sparkSession):
        return staged(_components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), max_rounds), "components", keep=True)


def _components(edges: DataFrame, max_rounds: int) -> DataFrame:
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        # large star: hang every larger neighbour of u on the least node near u
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        # (written out first, so that the join deals both sides anew and may split the rows of a hub)
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: hang the smaller neighbours of u, and u, on the least of them
        root = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(root.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
