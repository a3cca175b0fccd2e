"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): equal labels are one component.

    Each round maps every node to the smallest of itself and its neighbours and contracts the
    edges by it, until none is left; with node numbers that are hashes the rounds grow with the
    logarithm of the longest path. A node's neighbours are never gathered, only their minimum.
    Edges may repeat and may be loops; without edges the result is empty.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "hooks")
        moved = to.select(F.col("node").alias("label"), "to")
        named = to.select("node", F.col("to").alias("label")) if labels is None else labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        old, labels = labels, staged(named, "labels")
        at_a, at_b = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        met = edges.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, edges = edges, staged(met, "edges")
        discard(old, to, before)
    discard(edges)
    return labels
