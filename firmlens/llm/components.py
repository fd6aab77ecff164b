"""Connected components by contraction, for graphs that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut


def _contracted(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops, each once."""
    edges = edges.where("a != b")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after the links ``a, b`` between nodes have been added.

    In each round every component follows its neighbour of the lowest hash, if that is below
    its own, and edges are drawn between what is left. The hash changes with the round, so a
    path of any order shrinks by a constant share; a star, however large, goes in two or
    three rounds. Minima combine before the shuffle, and every round is written.
    """
    own = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    between = links.join(own("a"), "a").join(own("b"), "b")
    edges = cut(_contracted(between.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn))
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(order("b").alias("order"), F.col("b").alias("to")))
        moves = ways.groupBy("a").agg(best.alias("best"))
        lower = F.col("best.order") < order("a")
        moves = cut(moves.where(lower).select(F.col("a").alias("from"), F.col("best.to").alias("to")))
        for side in ("a", "b"):
            step = moves.select(F.col("from").alias(side), "to")
            edges = edges.join(step, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = cut(_contracted(edges))
        step = moves.select(F.col("from").alias("component"), "to")
        labels = labels.join(step, "component", "left")
        labels = cut(labels.select("node", F.coalesce("to", "component").alias("component")))
    return labels
