"""Distributed connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in the
    links ``a``, ``b`` (long).

    Local contraction: in each round every node moves to the neighbour (or
    itself) that comes first in an order drawn anew for the round, and links
    between nodes that have met vanish. The nodes left shrink by a constant
    factor a round whatever the shape of the graph, so rounds grow with its
    logarithm. Each round's tables are written to the shared folder; nothing
    but the emptiness of the links reaches the driver.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = cut(links.filter("a <> b").select(*pair).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    place = nodes.select("id", F.col("id").alias("at"))
    rounds = 0
    while not edges.isEmpty():
        rounds += 1

        def order(c: str, n: int = rounds):
            return F.struct(F.xxhash64(F.lit(n), F.col(c)).alias("h"), F.col(c).alias("to"))

        both = edges.union(edges.select("b", "a"))
        moves = cut(both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a"))).alias("m"))
                    .select(F.col("a").alias("node"), F.col("m.to").alias("to")))
        left = edges.join(moves.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a"), "b")
        left = left.join(moves.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b"))
        edges = cut(left.filter("a <> b").select(*pair).distinct())
        place = cut(place.join(moves.withColumnRenamed("node", "at"), "at", "left")
                    .select("id", F.coalesce("to", "at").alias("at")))
    smallest = place.groupBy("at").agg(F.min("id").alias("component"))
    return place.join(smallest, "at").select("id", "component")
