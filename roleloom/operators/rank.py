"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import materialised

c = F.col
_ROW = 33  # monotonically_increasing_id keeps the row of a partition in its lower 33 bits


def ranked(df: DataFrame, keys: list[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Adds the position (from 1) of every row in the order of ``keys``; rows that are equal in all of them are numbered in any order.

    Spark cuts the rows at sampled bounds into ``ranges`` sorted parts (``spark.sql.shuffle.partitions`` by default) and writes them with their place inside
    the part; the counts of the parts, one row each, give what comes before.  A task sorts its own range and no more.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = materialised(cut).withColumns({"_part": F.shiftright("_at", _ROW), "_place": c("_at").bitwiseAND(F.lit((1 << _ROW) - 1))}).drop("_at")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - c("n")).alias("_before"))  # one row for each range
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, c("_before") + c("_place") + 1).drop("_part", "_place", "_before")


def ranked_within(df: DataFrame, groups: list[str], keys: list[Column], name: str = "position", ranges: int | None = None) -> DataFrame:
    """Adds the position (from 1) of every row inside its group, however many rows one group holds: the global position less that of the group's first row.  Groups are not null."""
    whole = ranked(df, [*[c(g) for g in groups], *keys], "_rank", ranges)
    first = whole.groupBy(*groups).agg(F.min("_rank").alias("_first"))
    return whole.join(first, groups).withColumn(name, c("_rank") - c("_first") + 1).drop("_rank", "_first")
