"""Connected components of an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round points every node at its smallest neighbour (or itself), follows the pointers
    a few steps, and then draws each edge between the nodes that its ends point at, so a star
    or a chain of a few nodes becomes one node and edges become fewer from round to round.
    Loops and repeated edges do no harm; no edges give no rows. What a round leaves is
    written to the shared folder before the next begins.
    """
    both = lambda rows: materialize(rows.where("a <> b").select("a", "b").union(rows.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now, labels = both(edges), None
    for _ in range(most_rounds):
        points = materialize(now.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "points")
        for _ in range(2):
            onward = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            points = materialize(points.join(onward, "to").select("node", F.col("next").alias("to")), "points")
        if labels is None:
            labels = points.withColumnRenamed("to", "component")
        else:
            moved = labels.join(points.withColumnRenamed("node", "component"), "component", "left")
            labels = materialize(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        left = now.where("a < b").join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        before, now = now, both(left)
        discard(before)
        if now.isEmpty():
            return labels
    raise RuntimeError("components did not settle")
