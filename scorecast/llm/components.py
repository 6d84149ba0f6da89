"""Connected components of an edge table, as DataFrame rounds.

Alternating large-star and small-star rounds: a round re-hangs every neighbour on the
smallest vertex of its neighbourhood. Edges never exceed the input's count, a hub is
reduced by a map-side minimum and then only probed, and no vertex list reaches the driver:
each round sends back two numbers. Every table of a round is written once to the shared
folder and read by the next, so that a query has one join and its plan and tasks, which the
driver keeps in memory, stay few. The planner knows the written tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm.scratch import forgotten, new_path, released_shuffles, written

#: Edges that one task of a round writes, at most about: few edges are few tasks, whatever the
#: number of shuffle partitions.
TASK_EDGES = 200_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def _written(edges: DataFrame, folder: str, name: str, n: int | None = None) -> DataFrame:
    """``edges`` written; ``n``, where it is known, bounds their number."""
    if n is not None:
        edges = edges.coalesce(max(1, -(-n // TASK_EDGES)))
    with released_shuffles(edges.sparkSession):
        return written(edges, name, f"{folder}/{name}")


def _hang(edges: DataFrame, folder: str, name: str, n: int) -> DataFrame:
    """``edges`` (a, b) with ``m``: the smallest ``b`` of each ``a``."""
    # Written, so that the join deals both sides itself and a hub's rows can be split.
    least = _written(edges.groupBy(F.col("a").alias("_k")).agg(F.min("b").alias("m")), folder, name, n)
    return edges.join(least, F.col("a") == F.col("_k")).drop("_k")


def _edges(of: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """An edge (a, b) between each two columns of ``ends``, for every row of ``of``."""
    pairs = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends]
    return of.select(F.explode(F.array(*pairs)).alias("e")).select("e.a", "e.b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (a, b long) that is not itself the
    smallest vertex of its component; loops and repeated edges are harmless.

    An empty table gives an empty result; null ends are ignored.
    """
    spark = edges.sparkSession
    folder = new_path(spark, "star")
    e = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 folder, "edges")
    state = _state(e)
    while state[0]:
        before, folder, n = folder, new_path(spark, "star"), state[0]
        large = _written(_hang(_edges(e, ("a", "b"), ("b", "a")), folder, "least", 2 * n).filter("b > a")
                         .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), folder, "large", n)
        # A vertex and its other neighbours on the smallest one, whose own edge is a loop.
        e = _written(_edges(_hang(large, folder, "smallest", n), ("a", "m"), ("b", "m")).filter("a <> b").distinct(),
                     folder, "edges", n)
        now = _state(e)
        forgotten(spark, before)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
