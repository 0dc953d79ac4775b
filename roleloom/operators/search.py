"""Filters, sorts, pages, landing views, counters and top-k reports over the job tables.

Every operator is a lazy DataFrame transformation.  Organisation attributes come
from the organisation dimension; Catalyst broadcasts it while it is below the
session's broadcast limit and falls back to a sort-merge join beyond that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.dates import hours, local_day_key, start_of_local_day, to_local, to_utc, ts_lit
from ..sources.tables import materialised
from .lifecycle import days, health_column
from .rank import ranked, ranked_within

c = F.col
VISIBLE = lambda: c("archived_at").isNull() & (c("review_status") == "APPROVED")


def active_where() -> Column:
    return VISIBLE() & c("status").isin(R.ACTIVE_STATUSES)


# --- S1–S15: one named predicate each ------------------------------------------
def filter_visible(jobs: DataFrame) -> DataFrame:
    return jobs.where(VISIBLE())


def filter_status(jobs: DataFrame, status: str = "active") -> DataFrame:
    if status == "active":
        return jobs.where(c("status").isin(R.ACTIVE_STATUSES))
    return jobs.where(c("status").isin(R.CLOSED_STATUSES)) if status == "expired" else jobs


def with_org(jobs: DataFrame, orgs: DataFrame) -> DataFrame:
    dim = orgs.select("org_id", c("slug").alias("org_slug"), c("name").alias("org_name"), c("short_name").alias("org_short"), c("type").alias("org_type"))
    return jobs.join(dim, "org_id")


def _contains(col: Column, text: str) -> Column:
    return F.coalesce(F.lower(col).contains(text.lower()), F.lit(False))


def filter_text(jobs: DataFrame, orgs: DataFrame, text: str) -> DataFrame:
    """Substring in title, summary, department or organisation, ignoring case; or exactly one of the required skills."""
    hit = reduce(lambda a, b: a | b, [_contains(c(n), text) for n in ("title", "summary", "department", "org_name", "org_short")])
    cols = jobs.columns
    return with_org(jobs, orgs).where(hit | F.array_contains("required_skills", text)).select(*cols)


def filter_org(jobs: DataFrame, orgs: DataFrame, slug: str) -> DataFrame:
    return jobs.join(orgs.where(c("slug") == slug).select("org_id"), "org_id", "left_semi")


def filter_org_type(jobs: DataFrame, orgs: DataFrame, types: list[str]) -> DataFrame:
    return jobs.join(orgs.where(c("type").isin(types)).select("org_id"), "org_id", "left_semi")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def filter_category(jobs: DataFrame, categories: list[str]) -> DataFrame:
    return jobs.where(c("category").isin(categories) | F.arrays_overlap("secondary_categories", _strings(categories)))


def filter_level(jobs: DataFrame, levels: list[str]) -> DataFrame:
    return jobs.where(c("level").isin(levels))


def filter_work_mode(jobs: DataFrame, modes: list[str]) -> DataFrame:
    return jobs.where(c("work_mode").isin(modes))


def filter_location(jobs: DataFrame, place: str) -> DataFrame:
    return jobs.where(_contains(c("location"), place) | _contains(c("location"), "anywhere") | (c("work_mode") == "REMOTE"))


def filter_max_experience(jobs: DataFrame, years: float) -> DataFrame:
    return jobs.where(c("min_experience_years").isNull() | (c("min_experience_years") <= years))


def filter_cgpa(jobs: DataFrame, mine: float) -> DataFrame:
    return jobs.where(c("min_cgpa").isNull() | (c("min_cgpa") <= mine))


def filter_masters(jobs: DataFrame, masters: str) -> DataFrame:
    if masters == "not-required":
        return jobs.where(c("masters_required").isNull() | ~c("masters_required"))
    return jobs.where(c("masters_required")) if masters == "required" else jobs


PUBLISHED_HOURS = {"24h": 24, "7d": 168, "30d": 720}
DEADLINE_DAYS = {"3d": 3, "7d": 7, "30d": 30}


def published_since(within: str, now) -> Column:
    return c("first_discovered_at") >= ts_lit(now) - hours(PUBLISHED_HOURS[within])


def filter_published(jobs: DataFrame, within: str, now) -> DataFrame:
    return jobs.where(published_since(within, now))


def deadline_within(within: str, now) -> Column:
    return c("deadline").between(ts_lit(now), ts_lit(now) + days(DEADLINE_DAYS[within]))


def filter_deadline(jobs: DataFrame, within: str, now) -> DataFrame:
    return jobs.where(deadline_within(within, now))


def filter_match(jobs: DataFrame, matches: DataFrame, user_id, verdicts=(), min_score=None) -> DataFrame:
    m = matches.where(c("user_id") == user_id)
    m = m.where(c("verdict").isin(list(verdicts))) if verdicts else m
    m = m.where(c("score") >= min_score) if min_score is not None else m
    return jobs.join(m.select("job_id"), "job_id", "left_semi")


def apply_filters(jobs: DataFrame, orgs: DataFrame, filters: dict, now, matches: DataFrame | None = None, user_id=None) -> DataFrame:
    """All filters of one search; absent or empty ones do not restrict."""
    f = filters
    out = filter_status(filter_visible(jobs), f.get("status") or "active")
    if f.get("q"):
        out = filter_text(out, orgs, f["q"])
    if f.get("org"):
        out = filter_org(out, orgs, f["org"])
    if f.get("org_type"):
        out = filter_org_type(out, orgs, f["org_type"])
    if f.get("category"):
        out = filter_category(out, f["category"])
    if f.get("level"):
        out = filter_level(out, f["level"])
    if f.get("location"):
        out = filter_location(out, f["location"])
    if f.get("work_mode"):
        out = filter_work_mode(out, f["work_mode"])
    if f.get("max_experience") is not None:
        out = filter_max_experience(out, f["max_experience"])
    if f.get("my_cgpa") is not None:
        out = filter_cgpa(out, f["my_cgpa"])
    if f.get("masters"):
        out = filter_masters(out, f["masters"])
    if f.get("published"):
        out = filter_published(out, f["published"], now)
    if f.get("deadline"):
        out = filter_deadline(out, f["deadline"], now)
    if user_id is not None and (f.get("verdict") or f.get("min_score") is not None):
        out = filter_match(out, matches, user_id, f.get("verdict") or (), f.get("min_score"))
    return out


# --- S16–S19: order, page, decorate ----------------------------------------------
def sort_keys(sort: str) -> list[Column]:
    """Orders for a job list that carries ``org_name``; the job id is always the last tie-break."""
    return {
        "deadline": [c("deadline").asc_nulls_last(), c("first_discovered_at").desc(), c("job_id").desc()],
        "experience": [c("min_experience_years").asc_nulls_last(), c("first_discovered_at").desc(), c("job_id").desc()],
        "organization": [c("org_name").asc(), c("title").asc(), c("job_id").desc()],
        "verified": [c("last_verified_at").desc(), c("job_id").desc()],
        "match": [c("score").desc(), c("computed_at").desc(), c("job_id").desc()],
    }.get(sort, [c("first_discovered_at").desc(), c("job_id").desc()])


def sort_match(jobs: DataFrame, matches: DataFrame, user_id) -> DataFrame:
    mine = matches.where(c("user_id") == user_id).select("job_id", "score", "computed_at", "verdict")
    return jobs.join(mine, "job_id")


def page_of(df: DataFrame, keys: list[Column], page: float | None = 1, size: int = R.PAGE_SIZE, top: int = 10_000) -> DataFrame:
    """One page with its running position.

    A page that ends within the first ``top`` rows comes from a top-k, which no task holds more of; any later one from positions over sampled ranges.
    """
    page = max(1, int(page or 1))
    if page * size <= top:
        first = df.orderBy(*keys).limit(page * size)
        numbered = first.withColumn("rank", F.row_number().over(W.orderBy(*keys)))  # at most ``top`` rows
    else:
        numbered = ranked(df, keys)
    return numbered.where((c("rank") > (page - 1) * size) & (c("rank") <= page * size))


def page_totals(df: DataFrame, size: int = R.PAGE_SIZE) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1).cast("bigint"), F.ceil(c("total") / size)).alias("page_count"))


def decorate(jobs: DataFrame, links: DataFrame, matches: DataFrame, saved: DataFrame, user_id) -> DataFrame:
    """Link count, the viewer's match and saved flag. ``jobs`` is one page or a whole list."""
    counts = links.groupBy("job_id").agg(F.count("*").alias("links"))
    mine = matches.where(c("user_id") == user_id).select("job_id", c("verdict").alias("my_verdict"), c("score").alias("my_score"))
    kept = saved.where(c("user_id") == user_id).select("job_id", F.lit(True).alias("saved"))
    return (jobs.join(counts, "job_id", "left").join(mine, "job_id", "left").join(kept, "job_id", "left")
            .withColumn("links", F.coalesce("links", F.lit(0).cast("bigint"))).withColumn("saved", F.coalesce("saved", F.lit(False))))


def search_jobs(jobs, orgs, links, matches, saved, filters: dict, now, user_id=None) -> tuple[DataFrame, DataFrame]:
    """(page rows, totals) of one search."""
    found = apply_filters(jobs, orgs, filters, now, matches, user_id)
    sort = filters.get("sort") or "newest"
    if sort == "match":
        sort, found = ("match", sort_match(found, matches, user_id)) if user_id is not None else ("newest", found)
    page = page_of(with_org(found, orgs), sort_keys(sort), filters.get("page"))
    if user_id is not None:
        page = decorate(page, links, matches, saved, user_id)
    return page, page_totals(found)


# --- S20: landing pages ------------------------------------------------------------
PRESETS: dict[str, tuple[dict, tuple]] = {
    "all": ({}, ()),
    "new": ({"published": "7d", "sort": "newest"}, ("published",)),
    "closing": ({"deadline": "3d", "sort": "deadline"}, ("deadline",)),
    "public_bank": ({"org_type": ["PUBLIC_BANK", "GOVERNMENT"]}, ("org_type",)),
    "private_bank": ({"org_type": ["PRIVATE_BANK", "FOREIGN_BANK", "NBFI", "FINTECH"]}, ("org_type",)),
    "software": ({"category": R.CATEGORY_GROUPS["software"]}, ("category",)),
    "infrastructure": ({"category": R.CATEGORY_GROUPS["infrastructure"]}, ("category",)),
    "security": ({"category": R.CATEGORY_GROUPS["security"]}, ("category",)),
}


def preset_filters(preset: str, chosen: dict | None = None, org_slug: str | None = None) -> dict:
    """Locked keys always win, other preset keys only fill blanks."""
    values, locked = ({"org": org_slug}, ("org",)) if org_slug else PRESETS[preset]
    out = dict(chosen or {})
    for key, value in values.items():
        if key in locked or out.get(key) in (None, [], ""):
            out[key] = value
    return out


def _selects(filters: dict, now) -> Column:
    """Whether a job with its organisation passes the preset's filters; only those that presets use."""
    out = F.lit(True)
    if filters.get("org"):
        out = out & (c("org_slug") == filters["org"])
    if filters.get("org_type"):
        out = out & c("org_type").isin(filters["org_type"])
    if filters.get("category"):
        out = out & (c("category").isin(filters["category"]) | F.arrays_overlap("secondary_categories", _strings(filters["category"])))
    if filters.get("published"):
        out = out & published_since(filters["published"], now)
    if filters.get("deadline"):
        out = out & deadline_within(filters["deadline"], now)
    return F.coalesce(out, F.lit(False))


def preset_pages(jobs: DataFrame, orgs: DataFrame, now, org_slugs: list[str] | None = None, size: int = R.PAGE_SIZE) -> DataFrame:
    """(preset, total, rank, job_id): the first page of every landing list and of the given organisations, with the number of jobs of the list; one pass over the jobs.

    Each list ranks in two rounds, so that no task sorts a whole list.
    """
    lists = {name: preset_filters(name) for name in PRESETS} | {f"org:{s}": preset_filters("", org_slug=s) for s in org_slugs or []}
    named = F.filter(F.array(*[F.when(_selects(f, now), F.lit(name)) for name, f in lists.items()]), lambda x: x.isNotNull())
    rows = with_org(jobs.where(active_where()), orgs).select("job_id", "first_discovered_at", "deadline", F.explode(named).alias("preset"))
    by_deadline = [name for name, f in lists.items() if f.get("sort") == "deadline"]
    order = [F.when(c("preset").isin(by_deadline), c("deadline")).asc_nulls_last(), c("first_discovered_at").desc(), c("job_id").desc()]
    totals = rows.groupBy("preset").agg(F.count("*").alias("total"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("job_id"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("preset", "_s").orderBy(*order))).where(c("rank") <= size)
    top = salted.withColumn("rank", F.row_number().over(W.partitionBy("preset").orderBy(*order))).where(c("rank") <= size)
    return top.join(totals, "preset").select("preset", "total", "rank", "job_id")


# --- S21–S25: home page -------------------------------------------------------------
def home_stats(jobs: DataFrame, sources: DataFrame, now) -> DataFrame:
    visible = filter_visible(jobs)
    counts = visible.agg(
        F.count_if(c("status").isin(R.ACTIVE_STATUSES)).alias("open_jobs"),
        F.count_if(c("first_discovered_at") >= start_of_local_day(ts_lit(now))).alias("today"),
        F.count_if(c("status") == "CLOSING_SOON").alias("closing"))
    with_any = visible.select("org_id").unionByName(sources.where(c("org_id").isNotNull()).select("org_id"))
    orgs = with_any.agg(F.count_distinct("org_id").alias("orgs"))
    zero = F.lit(0).cast("bigint")
    both = counts.withColumn("orgs", zero).unionByName(orgs.select(*[zero.alias(n) for n in ("open_jobs", "today", "closing")], "orgs"))
    return both.agg(*[F.sum(n).alias(n) for n in ("open_jobs", "today", "closing", "orgs")])


def count_by_category(jobs: DataFrame) -> DataFrame:
    dim = jobs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(R.CATEGORIES)], "category string, position int")
    n = jobs.where(active_where()).groupBy("category").agg(F.count("*").alias("jobs"))
    return dim.join(n, "category", "left").select("category", "position", F.coalesce("jobs", F.lit(0).cast("bigint")).alias("jobs"))


def _active_per_org(jobs: DataFrame) -> DataFrame:
    return jobs.where(active_where()).groupBy("org_id").agg(F.count("*").alias("jobs"))


def org_job_counts(jobs: DataFrame, orgs: DataFrame) -> DataFrame:
    return orgs.join(_active_per_org(jobs), "org_id").select("slug", "name", "short_name", "jobs")


def org_directory(jobs: DataFrame, orgs: DataFrame, sources: DataFrame) -> DataFrame:
    automated = sources.groupBy("org_id").agg(F.max((c("method") != "MANUAL") & c("enabled")).alias("automated"))
    return (orgs.join(_active_per_org(jobs), "org_id", "left").join(automated, "org_id", "left")
            .select("type", "slug", "name", F.coalesce("jobs", F.lit(0).cast("bigint")).alias("jobs"), F.coalesce("automated", F.lit(False)).alias("automated")))


def upcoming_deadlines(jobs: DataFrame, orgs: DataFrame, now, k: int = 8) -> DataFrame:
    top = jobs.where(active_where() & (c("deadline") >= ts_lit(now))).orderBy("deadline", "job_id").limit(k)
    return with_org(top, orgs).select("slug", "title", "deadline", F.coalesce("org_short", "org_name").alias("org"))


def latest_jobs(jobs: DataFrame, orgs: DataFrame, k: int = 6) -> DataFrame:
    top = jobs.where(active_where()).orderBy(c("first_discovered_at").desc(), c("job_id").desc()).limit(k)
    return with_org(top, orgs).select("job_id", "slug", "title", "first_discovered_at", "org_name")


# --- S26–S31: candidate pages ---------------------------------------------------------
def top_k_per(df: DataFrame, key: str, order: list[Column], k: int, salt_on: str = "job_id", salts: int = 32) -> DataFrame:
    """Top k per key in two rounds: first within (key, salt), so a hot key is ranked by many tasks, then over at most salts*k rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order))).where(c("rank") <= k)
    return first.drop("_salt").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(c("rank") <= k)


def best_matches(matches: DataFrame, jobs: DataFrame, orgs: DataFrame, k: int = 5, verdicts=("STRONG", "POSSIBLE")) -> DataFrame:
    good = matches.where(c("verdict").isin(list(verdicts)))
    live = good.join(jobs.where(active_where()).select("job_id", "slug", "title", "deadline", "org_id"), "job_id")
    top = top_k_per(live, "user_id", [c("score").desc(), c("job_id").asc()], k)
    return top.join(orgs.select("org_id", c("name").alias("org_name")), "org_id").select("user_id", "rank", "job_id", "title", "score", "verdict", "org_name")


def verdict_counts(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    return (matches.join(jobs.where(active_where()).select("job_id"), "job_id", "left_semi")
            .groupBy("user_id", "verdict").agg(F.count("*").alias("n")))


def saved_jobs(saved: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every user's saved list, numbered by deadline with missing deadlines last."""
    kept = saved.select("user_id", "job_id").join(jobs.where(c("archived_at").isNull()).select("job_id", "slug", "title", "deadline"), "job_id")
    # A user's list is what one person saved, so the window holds a small group.
    w = W.partitionBy("user_id").orderBy(c("deadline").asc_nulls_last(), c("job_id").asc())
    return kept.withColumn("position", F.row_number().over(w))


def recent_applications(applications: DataFrame, jobs: DataFrame, k: int = 5) -> DataFrame:
    top = top_k_per(applications, "user_id", [c("updated_at").desc(), c("job_id").asc()], k)
    return top.join(jobs.select("job_id", "slug", "title"), "job_id").select("user_id", "rank", "slug", "title", "status", "updated_at")


def application_funnel(applications: DataFrame) -> DataFrame:
    stage = F.array_position(_strings(R.APPLICATION_STATUSES), c("status")).cast("int")
    return applications.groupBy("user_id", "status").agg(F.count("*").alias("n")).withColumn("stage", stage)


def month_bounds(year: int, month: int) -> tuple[Column, Column]:
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    return (to_utc(ts_lit(f"{year:04d}-{month:02d}-01 00:00:00")), to_utc(ts_lit(f"{nxt[0]:04d}-{nxt[1]:02d}-01 00:00:00")))


def _month_jobs(jobs: DataFrame, year: int, month: int) -> DataFrame:
    start, end = month_bounds(year, month)
    return filter_visible(jobs).where((c("deadline") >= start) & (c("deadline") < end))


def deadline_calendar(jobs: DataFrame, orgs: DataFrame, year: int, month: int) -> DataFrame:
    """Deadlines of one month: a row per job with its local day and position on it.

    Rows rather than one list per day: a day's list has no size bound, and its rows are ranked by as many tasks as their share of the month asks for.
    """
    j = _month_jobs(jobs, year, month).select("job_id", "org_id", "slug", "title", "status", "deadline").withColumn("day", local_day_key(c("deadline")))
    # Written first: the bounds of the ranges are sampled, which reads the rows once more.
    out = ranked_within(materialised(j), ["day"], [c("deadline"), c("job_id")])
    return with_org(out, orgs).select("day", "position", "slug", "title", "status", F.coalesce("org_short", "org_name").alias("org"))


def month_grid(jobs: DataFrame, year: int, month: int) -> DataFrame:
    """Saturday-first grid cells of one month with the number of deadlines per day."""
    n = _month_jobs(jobs, year, month).groupBy(local_day_key(c("deadline")).alias("day")).agg(F.count("*").alias("jobs"))
    first = f"DATE '{year:04d}-{month:02d}-01'"
    # dayofweek: 1 = Sunday … 7 = Saturday
    cells = jobs.sparkSession.range(1).select(F.explode(F.expr(
        f"sequence(0, cast(ceil((dayofweek({first}) % 7 + day(last_day({first}))) / 7.0) * 7 as int) - 1)")).alias("cell"))
    offset = F.expr(f"dayofweek({first}) % 7")
    length = F.expr(f"day(last_day({first}))")
    date = F.when((c("cell") >= offset) & (c("cell") < offset + length), F.date_format(F.date_add(F.expr(first), c("cell") - offset), "yyyy-MM-dd"))
    grid = cells.select("cell", F.floor(c("cell") / 7).cast("int").alias("week"), (c("cell") % 7).alias("weekday"), date.alias("day"))
    return grid.join(n, "day", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0).cast("bigint")))


# --- S32–S40: admin and detail pages ---------------------------------------------------
ADMIN_VIEWS = {
    "pending": lambda: (c("review_status") == "PENDING") & c("archived_at").isNull(),
    "active": lambda: (c("review_status") == "APPROVED") & c("archived_at").isNull(),
    "archived": lambda: c("archived_at").isNotNull(),
    "demo": lambda: c("is_demo"),
    "all": lambda: F.lit(True),
}


def admin_jobs(jobs, orgs, links, reports, view: str = "pending", text: str | None = None, k: int = 100) -> DataFrame:
    out = with_org(jobs.where(ADMIN_VIEWS[view]()), orgs)
    if text and text.strip():
        out = out.where(_contains(c("title"), text.strip()[:100]) | _contains(c("org_name"), text.strip()[:100]))
    top = out.orderBy(c("created_at").desc(), c("job_id").desc()).limit(k)
    ids = top.select("job_id")
    n_links = links.join(F.broadcast(ids), "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("links"))  # ids: at most k rows
    n_reports = reports.join(F.broadcast(ids), "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("reports"))
    zero = F.lit(0).cast("bigint")
    return (top.join(n_links, "job_id", "left").join(n_reports, "job_id", "left")
            .select("job_id", "title", "org_name", "created_at", "submitted_by", F.coalesce("links", zero).alias("links"), F.coalesce("reports", zero).alias("reports")))


def admin_overview(jobs, sources, runs, duplicates, reports, now, runs_now=None) -> DataFrame:
    """Long form (metric, n): run counts by status and parse errors of 24 h, queue sizes, open jobs, source health."""
    since = ts_lit(runs_now or now) - hours(24)
    recent = runs.where(c("started_at") >= since)

    def one(df, name, agg=None):
        return df.agg((agg if agg is not None else F.count("*")).cast("bigint").alias("n")).select(F.lit(name).alias("metric"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    parts = [
        recent.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("runs:"), "status").alias("metric"), "n"),
        one(recent, "parse_errors", F.sum("parse_errors")),
        one(jobs.where(ADMIN_VIEWS["pending"]()), "pending_jobs"),
        one(duplicates.where(c("status") == "PENDING"), "pending_duplicates"),
        one(reports.where(c("status") == "OPEN"), "open_reports"),
        one(jobs.where(active_where()), "open_jobs"),
        sources.withColumn("h", health_column(now)).groupBy("h").agg(F.count("*").alias("n")).select(F.concat(F.lit("health:"), "h").alias("metric"), "n"),
        one(sources, "sources"),
    ]
    return reduce(DataFrame.unionByName, parts)


def links_per_source(links: DataFrame) -> DataFrame:
    return links.groupBy("source_id").agg(F.count("*").alias("links"))


def last_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(c("started_at").desc(), c("run_id").desc()).limit(k)


def delivery_summary(deliveries: DataFrame, now) -> DataFrame:
    return deliveries.where(c("created_at") >= ts_lit(now) - hours(7 * 24)).groupBy("channel", "status").agg(F.count("*").alias("n"))


def latest_deliveries(deliveries: DataFrame, notifications: DataFrame, k: int = 200) -> DataFrame:
    order = [c("created_at").desc(), c("notification_id"), c("channel"), c("status")]
    n = notifications.select("notification_id", "title", "type", "user_id")
    return deliveries.orderBy(*order).limit(k).join(n, "notification_id", "left")


def source_runs(runs: DataFrame, k: int = 30) -> DataFrame:
    return top_k_per(runs, "source_id", [c("started_at").desc(), c("run_id").desc()], k, salt_on="run_id")


def open_reports(reports: DataFrame, jobs: DataFrame, users: DataFrame, k: int = 200) -> DataFrame:
    rank = F.array_position(_strings(R.REPORT_STATUSES), c("status"))
    top = reports.orderBy(rank, c("created_at").desc(), c("report_id")).limit(k)
    return (top.join(jobs.select("job_id", "title"), "job_id").join(users.select("user_id", "email"), "user_id", "left")
            .select("report_id", "status", "reason", "created_at", "title", "email"))


def audit_log(audit: DataFrame, users: DataFrame, k: int = 300) -> DataFrame:
    top = audit.orderBy(c("created_at").desc(), c("audit_id").desc()).limit(k)
    return top.join(users.select(c("user_id").alias("actor_id"), "email"), "actor_id", "left").select("audit_id", "action", "created_at", "email")


def job_detail(jobs, orgs, links, slug: str) -> DataFrame:
    """One job with its organisation, a row per link by first sighting."""
    one = with_org(jobs.where(c("slug") == slug), orgs)
    w = W.partitionBy("job_id").orderBy("first_seen_at", "external_key")  # the links of one job
    return (one.join(links.select("job_id", "external_key", "first_seen_at"), "job_id", "left")
            .withColumn("position", F.row_number().over(w))
            .select("job_id", "title", "org_name", "status", "position", "external_key", "first_seen_at"))


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(c("read_at").isNull()).alias("unread"))


def notification_history(notifications: DataFrame, deliveries: DataFrame, k: int = 100, unread_only: bool = False) -> DataFrame:
    """Latest k alerts per user with their deliveries (at most channels x outcomes each)."""
    base = notifications.where(c("read_at").isNull()) if unread_only else notifications
    top = top_k_per(base.select("notification_id", "user_id", "title", "created_at"), "user_id", [c("created_at").desc(), c("notification_id").desc()], k, salt_on="notification_id")
    d = deliveries.groupBy("notification_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "channel", "status"))), ",").alias("deliveries"))
    return top.join(d, "notification_id", "left").select("user_id", "rank", "notification_id", "title", F.coalesce("deliveries", F.lit("")).alias("deliveries"))


def is_indexable(now) -> Column:
    fresh = c("deadline").isNull() | (c("deadline") >= ts_lit(now) - days(R.NOINDEX_AFTER_DAYS))
    return ~c("is_demo") & VISIBLE() & (c("status") != "REMOVED") & fresh


# --- logged searches -----------------------------------------------------------------
LOG_LISTS = {"orgType": R.ORG_TYPES, "category": R.CATEGORIES, "level": R.LEVELS, "workMode": R.WORK_MODES, "verdict": R.VERDICTS}
LOG_CHOICES = {"masters": ["any", "not-required", "required"], "published": ["24h", "7d", "30d"], "deadline": ["3d", "7d", "30d"], "status": ["active", "expired", "all"],
               "sort": ["newest", "deadline", "match", "experience", "organization", "verified"]}
LOG_TEXT_LIMITS = {"q": 100, "org": 80, "location": 60}
LOG_NUMBERS = ["maxExperience", "myCgpa", "minScore", "page"]


def parse_search_log(log: DataFrame) -> DataFrame:
    """Typed filters from logged ``params``; unknown words are dropped, but one over-long text resets the whole search."""
    def p(name: str) -> Column:
        return F.try_element_at("params", F.lit(name))

    def known(name: str, values: list[str]) -> Column:
        return F.filter(F.split(F.coalesce(p(name), F.lit("")), ","), lambda x: x.isin(values))
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.length(p(n)) > limit, F.lit(False)) for n, limit in LOG_TEXT_LIMITS.items()])
    out = {n: F.nullif(p(n) if n == "org" else F.trim(p(n)), F.lit("")) for n in LOG_TEXT_LIMITS}
    out |= {n: known(n, values) for n, values in LOG_LISTS.items()}
    out |= {n: F.when(p(n).isin(values), p(n)) for n, values in LOG_CHOICES.items()}
    for n in LOG_NUMBERS:
        number = F.trim(p(n)).try_cast("double")
        out[n] = F.when(F.abs(number) < float("inf"), number)
    blank = {n: F.array().cast("array<string>") if n in LOG_LISTS else F.lit(None) for n in out}
    return log.withColumns({n: F.when(broken, blank[n]).otherwise(v) for n, v in out.items()})
