"""Crosswalks between value dictionaries: which stated skill a candidate's skill stands for, which title resembles a preferred role.

Profiles and jobs repeat the same few values, so values are compared once, dictionary against
dictionary; a (candidate, job) pair then only looks values up in lists that its profile and its job carry.
Neither join pairs all values: containment meets through one gram of the contained
value, similarity through the rarest features of both texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .containment import contained_values
from .enrich import categorize
from .resolve import similar_titles

c = F.col


def skill_crosswalk(mine: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mine, wanted) of all normalised skills that match by ``T.skill_matches``: equal, or one inside the other.  Both sides have one column, ``value``; nulls and empty texts match nothing."""
    same = mine.where(c("value") != "").distinct().join(wanted.distinct(), "value").select(c("value").alias("mine"), c("value").alias("wanted"))
    inner = contained_values(mine, wanted).select(c("part").alias("mine"), c("whole").alias("wanted"))
    outer = contained_values(wanted, mine).select(c("whole").alias("mine"), c("part").alias("wanted"))
    return same.unionByName(inner).unionByName(outer).distinct()


def with_known(lists: DataFrame, skills: str, wanted: DataFrame, name: str = "known") -> DataFrame:
    """Adds, to rows with a list of normalised ``skills``, all values of ``wanted(value)`` that one of them stands for; lists that are equal are looked up once."""
    distinct = lists.select(c(skills).alias("_list")).distinct()
    each = distinct.select("_list", F.explode("_list").alias("mine"))
    found = each.join(skill_crosswalk(each.select(c("mine").alias("value")), wanted), "mine").groupBy("_list").agg(F.collect_set("wanted").alias(name))
    out = lists.join(found, c(skills) == c("_list"), "left").drop("_list")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def with_similar_roles(jobs: DataFrame, title: str, roles: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Adds, for each of ``levels``, the roles of ``roles(value)`` whose similarity with the normalised ``title`` reaches that level."""
    one = F.lit(0).alias("org_id")  # similar titles are sought inside a group; here all are one
    left, right = roles.select(one, c("value").alias("normalized_title")), jobs.select(one, c(title).alias("normalized_title"))
    near = similar_titles(left.dropna(), right.dropna(), min(levels.values()))
    found = near.groupBy(c("right_title").alias("_title")).agg(*[F.collect_set(F.when(c("score") >= x, c("left_title"))).alias(n) for n, x in levels.items()])
    out = jobs.join(found, c(title) == c("_title"), "left").drop("_title")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in levels})


def with_roles(profiles: DataFrame, roles: str) -> DataFrame:
    """Adds the normalised ``p_roles`` and their ``p_role_categories``; a role is classified once, however many candidates name it, and equal lists are looked up once."""
    distinct = profiles.select(c(roles).alias("_list")).distinct()
    each = distinct.select("_list", F.explode("_list").alias("_role")).withColumn("_role", F.coalesce("_role", F.lit("")))
    named = categorize(each.select("_role").distinct().withColumn("_none", F.lit("")), "_role", "_none", "_none").select("_role", T.normalize_title(c("_role")).alias("n"), "category")
    found = each.join(named, "_role").groupBy("_list").agg(F.collect_set("n").alias("p_roles"), F.collect_set("category").alias("p_role_categories"))
    out = profiles.join(found, c(roles) == c("_list"), "left").drop("_list")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in ("p_roles", "p_role_categories")})
