"""Connected components by alternating large and small stars, each a grouping and a join; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelspark.llm.common import looked_up, stored


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long), in any direction, repeats and loops allowed: (node, label) for every linked node, label its component's least node.

    A star hangs each node's larger (then smaller) neighbours on the least of its neighbours, so that the number of rounds
    grows with the logarithm of a component's size. Minima are combined before the shuffle, and a hub, whose minimum very many
    rows ask for, is looked up by broadcast. Null ends are dropped; no links give no rows.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = stored(looked_up(both.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = looked_up(large, low, ["a"], "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "links")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free hash: equal for equal sets of edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.coalesce(F.sum(F.shiftright(h, 16)), F.lit(0))).first())
