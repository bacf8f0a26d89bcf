"""Connected components of a graph of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.session import written


def star_round(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges are (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(down, "u").select(F.explode(F.array(
        F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
    )).alias("e")).select("e.*").filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b) that is not the smallest of its own
    component; the component is named by its smallest node. Only counts reach the driver."""
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # Done when all edges are stars: each u once, and no v is a u.
        shape = edges.groupBy("u").count().agg(F.max("count").alias("most")).first()["most"]
        if shape is None or shape == 1 and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = written(star_round(edges), "links")
