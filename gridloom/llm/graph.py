"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settled


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v), the label being the least node of its component.

    With ``most_rounds`` it may stop early: nodes of one label are then connected, but a component may still have several.

    Each round hangs nodes onto the least of their neighbours; rounds grow with the logarithm of a
    component's breadth. Minima are summed up before each shuffle, so a node with very many links is no hot spot.
    Links are settled in the shared folder after each round.
    """
    stars = settled(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    turn = 0
    while turn != most_rounds and not _flat(stars):
        turn += 1
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of a node goes to the least node near.
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        hung = large.join(down, F.col("u") == F.col("_u"))
        small = hung.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("l"))
        after = settled(small.select("l.*").filter("u <> v").distinct())
        discard(stars)
        stars = after
    # A node hangs on the least of what it hangs on; one that hangs on nothing is its own label.
    ends = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e"))
    return settled(ends.groupBy(F.col("e.u").alias("node")).agg(F.min("e.v").alias("label")))


def _flat(stars: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and none hangs on one that hangs itself."""
    ends = stars.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs")))).alias("e"))
    per = ends.groupBy("e.x").agg(F.sum("e.hangs").alias("h"), F.count("*").alias("n"))
    return per.filter("h > 1 or (h = 1 and n > 1)").agg(F.count("*")).first()[0] == 0
