"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _links(df: DataFrame) -> DataFrame:
    """Distinct links, the larger node first, without loops."""
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _all_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, or links to larger ones alone: the rounds are done."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 or down = 1 and up = 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v: long), root being the smallest node reachable.

    A round never has more links than the one before; a hub's links meet in joins that Spark can split and in
    partial minima, never in one list. Rounds end as soon as only stars are left, links that are stars take none; that
    is asked with one exchange, of partial sums, where another round to see that nothing changes takes seven and a
    checkpoint. Only a count reaches the driver.
    """
    now = materialise(_links(links), narrow=True)
    while not _all_stars(now):
        now = materialise(_links(_small_star(_links(_large_star(now)))), narrow=True)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
