"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014).

Nothing is collected on the driver but one answer a round, whether all links form stars. Each step is a partially
aggregated minimum per node and a join of the links with it; a node with very many links is an ordinary skewed join.
Every round is written to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node that can be reached."""
    now = written(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        # large-star: each larger neighbour of a node goes to the smallest node around it
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        new = written(small, "links")
        dropped(now.sparkSession, now)
        now = new
    # stars: b is linked with its component's smallest node only
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end: as a < b, a is then the smallest node around."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("as_b"), F.lit(0).alias("as_a")).unionByName(links.select(F.col("a").alias("node"), F.lit(0).alias("as_b"), F.lit(1).alias("as_a")))
    return ends.groupBy("node").agg(F.sum("as_b").alias("as_b"), F.max("as_a").alias("as_a")).where("as_b > 1 or as_b = 1 and as_a = 1").isEmpty()
