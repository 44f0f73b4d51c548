"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize


def _mark(edges: DataFrame):
    """Number and checksum of the edges: equal marks mean nothing changed."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of comparable node names -> (node, label) with the smallest
    node of each component as its label; nodes without a partner are absent.

    Each round hangs every node's larger neighbours, then its smaller ones,
    below its smallest neighbour.  Rounds grow with the logarithm of the
    longest chain; a node with very many neighbours is summed per task, and its
    edges are joined as plain rows that Spark may split.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "component-edges")
    mark = _mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("u")).select("a", "b", "low")
        small = (small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionAll(small.select("a", F.col("low").alias("b"))).distinct())
        edges = materialize(small, "component-edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    label = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label.unionAll(label.select(F.col("label").alias("node"), "label").distinct())
