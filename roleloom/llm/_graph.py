"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._work import drop, table

c = F.col


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node, which itself points nowhere."""
    again = edges.select(c("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi").limit(1).count()
    return not again and not edges.groupBy("u").count().where("count > 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps until every node points at a node that points nowhere.  A step only takes minima per node and joins
    them back, so a node with very many edges is combined before the shuffle; every step is a new table in the shared folder.
    """
    now = table(edges.where(c("a") != c("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(c("v").alias("u"), c("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v")).where(c("u") != c("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(c("v") == c("m"), c("u")).otherwise(c("v")).alias("u"), c("m").alias("v")).where(c("u") != c("v"))
        small = small.unionByName(down.select("u", c("m").alias("v"))).distinct()
        after = table(small)
        drop(now)
        now = after
    labels = now.groupBy(c("u").alias("node")).agg(F.min("v").alias("component"))
    return labels.unionByName(now.select(c("v").alias("node"), c("v").alias("component")).distinct())
