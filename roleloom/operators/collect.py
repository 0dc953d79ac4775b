"""One tick of collection, from validated postings to alerts, as tables in and changed rows out.

The steps are the library's own operators; this module only joins them up.  Every
table of a tick is written before the next step reads it, so a tick that is run again
after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import ts_lit
from ..sources.registry import validate_postings
from ..sources.tables import materialised, upserted
from . import alerts as A, resolve as X
from .enrich import enrich, new_organizations, resolve_organization
from .lifecycle import missed_in_run, refresh_statuses, run_summary, sources_after
from .match import match_for_jobs

c = F.col
#: Tables that a tick reads and changes, by their keys; ``runs`` and ``sources`` may be left out.
KEYS = {"orgs": ["org_id"], "jobs": ["job_id"], "links": ["external_key"], "queue": ["job_id", "candidate_job_id"], "matches": ["user_id", "job_id"], "notifications": ["dedupe_key"],
        "runs": ["tick", "source_id"], "sources": ["source_id"]}
RUNS = "tick bigint, source_id bigint, started_at timestamp_ntz, status string, items_found bigint, created bigint, updated bigint, merged bigint, skipped bigint, parse_errors bigint"


def _aligned(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with exactly the columns of ``like``; those it lacks are null."""
    return rows.select(*[(c(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _numbered_orgs(fresh: DataFrame, orgs: DataFrame) -> DataFrame:
    """New organisations with a number of their own, made from the slug as job numbers are from the source key."""
    ids = X.new_job_ids(fresh.select(c("org_slug").alias("external_key")), orgs.select(c("org_id").alias("job_id")))
    rows = fresh.join(ids.withColumnsRenamed({"external_key": "org_slug", "job_id": "org_id"}), "org_slug").withColumnRenamed("org_slug", "slug")
    return _aligned(rows, orgs)


def _outcomes(postings: DataFrame, settled: DataFrame, rejected: DataFrame) -> DataFrame:
    """(run_id, action, reason, failure) of every posting and every aborted run of the tick; a run is a source's."""
    done = F.when(c("failed_rule").isNotNull(), "skipped").when(c("action") == "create", "created").when(c("action") == "same-source", "updated").when(c("action") == "merge", "merged").otherwise("skipped")
    rows = postings.join(settled.select("posting_id", "action"), "posting_id", "left").join(rejected.select("posting_id", "failed_rule"), "posting_id", "left")
    none = F.lit(None).cast("string")
    return rows.select(c("source_id").alias("run_id"), F.when(c("failure").isNull(), done).alias("action"), F.when(c("failed_rule").isNotNull(), F.concat(F.lit("Invalid "), "failed_rule")).otherwise(none).alias("reason"), "failure")


def collect_changes(postings: DataFrame, state: dict[str, DataFrame], profiles: DataFrame, prefs: DataFrame, saved: DataFrame, applications: DataFrame, now, tick: int = 0) -> dict[str, DataFrame]:
    """The rows that one tick adds to each table of ``state`` or changes there, plus ``rejected`` postings and the ``decisions`` taken.

    ``postings(posting_id, source_key, source_name, source_id, title, organization_slug, organization_name, source_org_slug, source_url, source_job_id, ...)``; the jobs of
    ``state`` hold the columns of ``resolve.OWNED``, whose fingerprint and content hash are stored.  Postings that are no technology role are left out, and postings of one batch that are the same job make one.
    A row whose ``failure`` is not null (``refused`` or anything else) is no posting but says that its source's run ended that way.  Jobs that a run with items did not see count a miss, statuses follow, and
    each source that ran gets a row in ``runs`` and its health columns in ``sources``.  New jobs and jobs whose deadline moved are scored against all ``profiles``, and alerts tell that score.
    """
    t = ts_lit(now)
    rows = materialised(postings if "failure" in postings.columns else postings.withColumn("failure", F.lit(None).cast("string")))
    good, rejected = validate_postings(rows.where(c("failure").isNull()).drop("failure"))
    placed = materialised(resolve_organization(good, state["orgs"]))
    new_orgs = materialised(_numbered_orgs(new_organizations(placed, state["orgs"]), state["orgs"]))
    orgs = state["orgs"].unionByName(new_orgs)
    enriched = enrich(placed).join(orgs.select("org_id", c("slug").alias("org_slug")), "org_slug")
    incoming = materialised(X.prepare_incoming(enriched))
    stored = materialised(X.with_keys(state["jobs"].join(orgs.select("org_id", c("slug").alias("org_slug")), "org_id")))
    decisions, reviews = X.dedupe_decide(incoming, stored, state["links"], now)
    decisions = materialised(decisions)
    settled = materialised(X.settle(incoming, decisions, stored))
    matched = incoming.join(settled.where(c("action") != "create"), "posting_id").join(stored.select("job_id"), "job_id", "left_semi")
    updated = materialised(X.merge_survivorship(stored, matched, now))
    created = materialised(X.create_jobs(incoming, settled, orgs, now))
    births = _aligned(created.withColumns({"created_at": t, "updated_at": t}), state["jobs"])
    touched = materialised(_aligned(updated.withColumn("updated_at", t), state["jobs"]).unionByName(births))
    seen = incoming.join(settled.select("posting_id", "job_id"), "posting_id").select("external_key", "job_id", "source_id", "source_url", "posting_id")
    known = state["links"].join(seen.select("external_key").distinct(), "external_key", "left_semi")
    links_changed = materialised(_aligned(X.link_upsert(known, seen, now), state["links"]))
    links = upserted(state["links"], links_changed, KEYS["links"])
    runs = materialised(run_summary(_outcomes(rows, settled, rejected)).withColumnRenamed("run_id", "source_id").withColumns({"tick": F.lit(tick).cast("long"), "started_at": t}))
    # All jobs are looked at for misses and statuses; those that change are written.
    marked = state["jobs"].join(touched.select("job_id"), "job_id", "left_anti").withColumn("_new", F.lit(False)).unionByName(touched.withColumn("_new", F.lit(True)))
    marked = marked.join(missed_in_run(runs, links, now), "job_id", "left")
    missed = F.coalesce("misses", F.lit(0).cast("long"))
    marked = marked.withColumn("_missed", F.when(c("status") == "EXPIRED", 0).otherwise(missed)).withColumn("missing_runs", (c("missing_runs") + c("_missed")).cast("int"))
    status = refresh_statuses(marked, links, now).select("job_id", "new_status")
    jobs_changed = marked.join(status, "job_id", "left").where(c("_new") | (c("_missed") > 0) | c("new_status").isNotNull())
    jobs_changed = materialised(jobs_changed.withColumn("status", F.coalesce("new_status", "status")).select(*state["jobs"].columns))
    pairs = reviews.join(settled.where(c("action") == "create").select("posting_id", c("job_id").alias("candidate_job_id")), "posting_id").select("job_id", "candidate_job_id", "score", F.lit("PENDING").alias("status"))
    queue = materialised(_aligned(pairs.join(state["queue"].select("job_id", "candidate_job_id"), ["job_id", "candidate_job_id"], "left_anti"), state["queue"]))
    moved_ids = updated.where("deadline_changed").select("job_id")
    new_jobs = materialised(jobs_changed.join(created.select("job_id"), "job_id", "left_semi"))
    moved = jobs_changed.join(moved_ids, "job_id", "left_semi")
    scored = match_for_jobs(created.select("job_id").unionByName(moved_ids), profiles, jobs_changed, orgs).withColumn("computed_at", t)
    out = {"orgs": new_orgs, "jobs": jobs_changed, "links": links_changed, "queue": queue, "matches": materialised(_aligned(scored, state["matches"]))}
    # Alerts look at the matches of new jobs only; the others are left out before both are joined.
    rated = upserted(*[m.join(F.broadcast(new_jobs.select("job_id")), "job_id", "left_semi").select(*state["matches"].columns) for m in (state["matches"], out["matches"])], KEYS["matches"])
    told = A.notify_new_jobs(new_jobs, orgs, prefs, rated, now).unionByName(A.notify_job_updates(moved, saved, applications)).withColumn("created_at", t)
    out["notifications"] = materialised(_aligned(A.emit_once(told, state["notifications"]), state["notifications"]))
    if "runs" in state:
        out["runs"] = _aligned(runs, state["runs"])
    if "sources" in state:
        out["sources"] = _aligned(sources_after(state["sources"], runs, now), state["sources"])
    return out | {"rejected": rejected, "decisions": settled}


def collect_tick(postings: DataFrame, state: dict[str, DataFrame], profiles: DataFrame, prefs: DataFrame, saved: DataFrame, applications: DataFrame, now, tick: int = 0) -> dict[str, DataFrame]:
    """The whole next state of one tick, plus ``rejected`` and ``decisions``; see ``collect_changes``."""
    out = collect_changes(postings, state, profiles, prefs, saved, applications, now, tick)
    return out | {k: upserted(state[k], out[k], KEYS[k]) if k in out else state[k] for k in state}
