"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Written


def connected_components(links: DataFrame, written: Written, name: str) -> DataFrame:
    """(node, label) for each end of `links` (a, b): label is the smallest node that links reach.

    In a large-star step each node ties its larger neighbours to the least node around it, in a small-star
    step the smaller ones; both only sum up by node and join back, so a node of very many links is dealt
    with as a skewed join. Steps go on until each component is a star around its least node; the number of them grows
    with the logarithm of the nodes. Links of a node to itself are ignored; no links give no rows.
    """
    edges = written.table(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    step = 0
    while not all_stars(edges):
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b")
        large = large.distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array(F.col("a"), F.col("b"))).alias("b")).where("a != b")
        edges = written.table(small.distinct(), f"{name}-{step}")
        if step > 1:
            written.drop(f"{name}-{step - 2}")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)


def all_stars(edges: DataFrame) -> bool:
    """Whether each larger end of different links (a, b), a < b, has no other link, so that each smaller end is a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("links")).where("ups > 1 OR (ups = 1 AND links > 1)").isEmpty()
