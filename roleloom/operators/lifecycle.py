"""Status of a job over time, refreshes, misses, run logs, source health, retention, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.dates import hours, ts_lit

c = F.col


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def status_column(now, *, deadline=None, missing=None, review=None, verified=None, discovered=None, manual=None) -> Column:
    """Status from a deadline, misses, review state and times; the first rule that applies wins."""
    now = ts_lit(now)
    deadline = c("deadline") if deadline is None else deadline
    missing = c("missing_runs") if missing is None else missing
    review = c("review_status") if review is None else review
    verified = c("last_verified_at") if verified is None else verified
    discovered = c("first_discovered_at") if discovered is None else discovered
    manual = F.lit(False) if manual is None else manual
    return (F.when(deadline <= now, "EXPIRED")
            .when(missing >= R.REMOVED_AFTER_MISSES, "REMOVED")
            .when(review == "PENDING", "UNVERIFIED")
            .when(deadline.isNull() & ~manual & (verified < now - days(R.UNVERIFIED_AFTER_DAYS)), "UNVERIFIED")
            .when(deadline <= now + hours(R.CLOSING_SOON_HOURS), "CLOSING_SOON")
            .when(discovered >= now - hours(R.NEW_WINDOW_HOURS), "NEW")
            .otherwise("OPEN"))


def compute_status(jobs: DataFrame, now) -> DataFrame:
    return jobs.withColumn("status", status_column(now))


def manual_flags(links: DataFrame) -> DataFrame:
    """Jobs with a link from a real source; every other job counts as manual."""
    return links.groupBy("job_id").agg(F.max(c("source_id").isNotNull()).alias("sourced"))


def refresh_statuses(jobs: DataFrame, links: DataFrame, now, only_upcoming: bool = False) -> DataFrame:
    """Changed statuses of jobs that are not archived."""
    todo = jobs.where(c("archived_at").isNull())
    if only_upcoming:
        t = ts_lit(now)
        near = (c("deadline") <= t + days(4)) | (c("first_discovered_at") >= t - days(3))
        todo = todo.where(near & (c("status") != "EXPIRED"))
    manual = ~F.coalesce(c("sourced"), F.lit(False))
    out = todo.join(manual_flags(links), "job_id", "left").withColumn("new_status", status_column(now, manual=manual))
    return out.where(~c("new_status").eqNullSafe(c("status"))).select("job_id", c("status").alias("old_status"), "new_status")


def missing_runs(runs: DataFrame, jobs: DataFrame, links: DataFrame) -> DataFrame:
    """Jobs that successful, non-empty runs of their sources did not see: counter plus one for each such run since the last sighting.

    Runs after a sighting are those of later days, taken from sums over the days of a source, and the later ones of the same day.
    """
    day = lambda x: F.unix_date(c(x).cast("date"))
    good = runs.where(c("status").isin("SUCCESS", "PARTIAL") & (c("items_found") > 0)).select("source_id", "started_at", day("started_at").alias("day"))
    seen = links.where(c("source_id").isNotNull()).groupBy("source_id", "job_id").agg(F.max("last_seen_at").alias("last_seen_at")).withColumn("day", day("last_seen_at"))
    days_ = good.groupBy("source_id", "day").agg(F.count("*").alias("n")).unionByName(seen.select("source_id", "day", F.lit(0).cast("long").alias("n"))).groupBy("source_id", "day").agg(F.sum("n").alias("n"))
    later = W.partitionBy("source_id").orderBy(c("day").desc()).rowsBetween(W.unboundedPreceding, -1)  # a source's days
    after = days_.select("source_id", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later"))
    # Runs of one source and day, in order, meet the distinct sightings of that day.
    same = (seen.select("source_id", "day", "last_seen_at").distinct().join(good, ["source_id", "day"]).where(c("started_at") > c("last_seen_at"))
            .groupBy("source_id", "day", "last_seen_at").agg(F.count("*").alias("same")))
    missed = (seen.join(after, ["source_id", "day"]).join(same, ["source_id", "day", "last_seen_at"], "left").withColumn("n", c("later") + F.coalesce("same", F.lit(0)))
              .where(c("n") > 0).groupBy("job_id").agg(F.sum("n").alias("misses")))
    return (jobs.where(c("status") != "EXPIRED").join(missed, "job_id")
            .select("job_id", c("missing_runs").alias("before"), (c("missing_runs") + c("misses")).alias("after")))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per run: counts by outcome. ``outcomes(run_id, action, reason, failure)``; one row with ``failure`` marks an aborted run."""
    def n(cond):
        return F.count_if(F.coalesce(cond, F.lit(False)))
    invalid = c("reason").startswith("Invalid")
    g = outcomes.groupBy("run_id").agg(
        n(c("action").isNotNull()).alias("items_found"), n(c("action") == "created").alias("created"),
        n(c("action") == "updated").alias("updated"), n(c("action") == "merged").alias("merged"),
        n(c("action") == "skipped").alias("skipped"), n(invalid).alias("parse_errors"),
        F.max(F.when(c("failure") == "refused", 1).when(c("failure").isNotNull(), 2)).alias("f"))
    return g.withColumn("status", F.when(c("f") == 2, "FAILED").when(c("f") == 1, "SKIPPED")
                        .when(c("parse_errors") > 0, "PARTIAL").otherwise("SUCCESS")).drop("f")


def missed_in_run(runs: DataFrame, links: DataFrame, now) -> DataFrame:
    """(job_id, misses): for each job the sources whose run of this tick had items but did not see it.

    ``runs(source_id, status, items_found)`` are those of the tick, ``links`` the state behind it, in which sightings of the tick carry ``now``.
    """
    ran = runs.where(~c("status").isin("FAILED", "SKIPPED") & (c("items_found") > 0)).select("source_id")
    last = links.join(ran, "source_id").groupBy("source_id", "job_id").agg(F.max("last_seen_at").alias("last_seen_at"))
    return last.where(c("last_seen_at") < ts_lit(now)).groupBy("job_id").agg(F.count("*").alias("misses"))


def sources_after(sources: DataFrame, runs: DataFrame, now) -> DataFrame:
    """The sources that ran in this tick, with their times and failure counts: success sets the count to zero, a failure adds one, a refusal leaves it."""
    t = ts_lit(now)
    ok, failed = c("_status").isin("SUCCESS", "PARTIAL"), c("_status") == "FAILED"
    out = sources.join(runs.select("source_id", c("status").alias("_status")), "source_id")
    failures = F.when(ok, 0).when(failed, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(c("consecutive_failures"))
    return out.withColumns({"last_run_at": t, "last_success_at": F.when(ok, t).otherwise(c("last_success_at")), "consecutive_failures": failures.cast("int")}).drop("_status")


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Failures since the last success per source: two map-side combined aggregates and no per-source window."""
    good = runs.where(c("status").isin("SUCCESS", "PARTIAL")).groupBy("source_id").agg(
        F.max(F.struct("started_at", "run_id")).alias("last_good"))
    # One row per source meets the failures; the count combines map-side, so a source with most of the runs stays cheap.
    bad = runs.where(c("status") == "FAILED").select("source_id", F.struct("started_at", "run_id").alias("at"))
    streak = (bad.join(good, "source_id", "left").where(c("last_good").isNull() | (c("at") > c("last_good")))
              .groupBy("source_id").agg(F.count("*").alias("failures")))
    return (runs.select("source_id").distinct().join(streak, "source_id", "left")
            .select("source_id", F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures")))


def health_column(now) -> Column:
    stale_after = F.expr("INTERVAL '1' MINUTE") * (c("fetch_interval_minutes") * 3)
    return (F.when(c("method") == "MANUAL", "manual").when(~c("enabled"), "disabled").when(c("last_run_at").isNull(), "pending")
            .when(c("consecutive_failures") >= 3, "failing").when(c("consecutive_failures") > 0, "warning")
            .when(c("last_success_at").isNull(), "warning")
            .when(c("last_success_at") + stale_after < ts_lit(now), "warning").otherwise("healthy"))


def source_health(sources: DataFrame, now) -> DataFrame:
    return sources.withColumn("health", health_column(now))


def to_archive(now) -> Column:
    now = ts_lit(now)
    return c("archived_at").isNull() & (
        ((c("status") == "EXPIRED") & (c("deadline") < now - days(90))) | ((c("status") == "REMOVED") & (c("updated_at") < now - days(30))))


def retention(jobs: DataFrame, runs: DataFrame, deliveries: DataFrame, tasks: DataFrame, now) -> DataFrame:
    """How many rows each retention rule archives or prunes."""
    t = ts_lit(now)

    def counted(df: DataFrame, what: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return (counted(jobs.where(to_archive(now)), "archived")
            .unionByName(counted(runs.where(c("started_at") < t - days(90)), "runs"))
            .unionByName(counted(deliveries.where(c("created_at") < t - days(180)), "deliveries"))
            .unionByName(counted(tasks.where(c("started_at") < t - days(90)), "tasks")))


def apply_retention(jobs: DataFrame, now) -> DataFrame:
    return jobs.withColumn("archived_at", F.when(to_archive(now), ts_lit(now)).otherwise(c("archived_at")))
