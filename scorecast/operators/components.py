"""Connected components of a graph of ids, in rounds whose number grows with the logarithm of
a component's size.

A round hangs the greater neighbours of every vertex on the least vertex of its neighbourhood,
then all of its lesser neighbours. There are never more edges than at the start, a hub is
reduced where its rows lie before they are shuffled, and two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.session import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("x").agg(F.min("y").alias("least"))
    return edges.join(least, "x")


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the least vertex of the component of each vertex of ``edges``
    (x, y long) other than that least vertex itself."""
    pairs = edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    pairs, before = materialize(pairs, "edges"), None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y") % 1_000_003)).first()
        if now == before:
            return pairs.select(F.col("x").alias("vertex"), F.col("y").alias("component"))
        before = now
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        raised = (_least_neighbour(both).filter("y > x").select(F.col("y").alias("x"), F.least("x", "least").alias("y"))
                  .filter("x <> y").distinct())
        lowered = _least_neighbour(raised)
        pairs = materialize(lowered.select("x", F.col("least").alias("y")).unionByName(
            lowered.filter("y <> least").select(F.col("y").alias("x"), F.col("least").alias("y"))).distinct(), "edges")
