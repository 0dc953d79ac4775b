"""Which text of one dictionary occurs inside which of another, without pairing all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

c = F.col
GRAM = 3  # the shortest value that may be found inside another one


def _grams(value: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - (GRAM - 1)), lambda i: F.substring(value, i, F.lit(GRAM))))


def contained_values(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) of all distinct values where ``part``, of three characters or more, occurs in ``whole``.  Both sides have one column, ``value``.

    Any gram of a part is also one of its whole, so a part is looked up by one of them: that which the fewest wholes have.
    A part with a gram that no whole has is contained in none.
    """
    long_enough = F.length("value") >= GRAM
    index = wholes.where(long_enough).distinct().select(c("value").alias("whole"), F.explode(_grams(c("value"))).alias("gram"))
    common = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = parts.where(long_enough).distinct().select(c("value").alias("part"), F.explode(_grams(c("value"))).alias("gram"))
    key = asked.join(common, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "gram")).alias("k")).select("part", "k.gram")
    return key.join(index, "gram").where(F.contains("whole", "part")).select("part", "whole")
