"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node u the least of u and its neighbours v.

    Stored before it is joined: a hot node's rows then meet it in a plain shuffled join, which
    adaptive execution splits.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
    return stored(least, "least-neighbour")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
    return both.join(_smallest(both), "u").where("v > u and v <> m").selectExpr("v as u", "m as v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges point from u down to v."""
    least = _smallest(edges)
    moved = edges.join(least, "u").where("v <> m").selectExpr("v as u", "m as v")
    return moved.unionByName(least.selectExpr("u", "m as v").where("u <> v")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` has two whole-number columns u and v; direction, repetitions, loops and nulls do not
    matter. Each step keeps at most the number of edges it got, is written to the shared folder, and
    the loop ends when a round changes nothing; only a count and a checksum come to the driver.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = stored(edges.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        edges = stored(_large_star(edges), "large-star")
        edges = stored(_small_star(edges), "small-star")
    roots = edges.select(F.col("v").alias("node")).distinct().selectExpr("node", "node as component")
    return edges.selectExpr("u as node", "v as component").unionByName(roots)
