"""Search, report and admin queries."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import search as S
from . import sqltext as Q
from .core import register
from .views import EVENTS_NOW, NOW

c = F.col
VIS = "archived_at IS NULL AND review_status = 'APPROVED'"
ACTIVE = f"{VIS} AND status IN {Q.strings(R.ACTIVE_STATUSES)}"
USER = 7


def ids(df):
    return df.select("job_id")


@register("scan_tables", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1999-01-01'")
def _(t):
    from ..sources.tables import scan
    return scan(t.spark, t.sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"],
                (c("l_quantity") > 45) & (c("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")))


@register("filter_visible", f"SELECT job_id FROM {{v_jobs}} WHERE {VIS}")
def _(t):
    return ids(S.filter_visible(t.v_jobs))


for _name, _sql in (("active", f"status IN {Q.strings(R.ACTIVE_STATUSES)}"), ("expired", "status IN ('EXPIRED', 'REMOVED')"), ("all", "true")):
    register("filter_status" if _name == "active" else f"filter_status_{_name}", f"SELECT job_id FROM {{v_jobs}} WHERE {_sql}")(
        lambda t, s=_name: ids(S.filter_status(t.v_jobs, s)))

_TXT = "lower({0}) LIKE '%{1}%'"


def _text_sql(text):
    like = " OR ".join(f"coalesce(lower({col}) LIKE '%{text.lower()}%', false)" for col in ("j.title", "j.summary", "j.department", "o.name", "o.short_name"))
    return f"SELECT job_id FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id) WHERE {like} OR list_contains(required_skills, '{text}')"


@register("filter_text", _text_sql("Java"))
def _(t):
    return ids(S.filter_text(t.v_jobs, t.v_orgs, "Java"))


@register("filter_text_org", _text_sql("meghna"))
def _(t):
    return ids(S.filter_text(t.v_jobs, t.v_orgs, "meghna"))


@register("filter_org", "SELECT job_id FROM {v_jobs} WHERE org_id = 3")
def _(t):
    return ids(S.filter_org(t.v_jobs, t.v_orgs, "org-3"))


@register("filter_org_type", "SELECT job_id FROM {v_jobs} JOIN {v_orgs} o USING (org_id) WHERE o.type IN ('PUBLIC_BANK', 'GOVERNMENT')")
def _(t):
    return ids(S.filter_org_type(t.v_jobs, t.v_orgs, ["PUBLIC_BANK", "GOVERNMENT"]))


@register("filter_category", "SELECT job_id FROM {v_jobs} WHERE category IN ('NETWORK', 'DATA_BI') OR list_has_any(secondary_categories, ['NETWORK', 'DATA_BI'])")
def _(t):
    return ids(S.filter_category(t.v_jobs, ["NETWORK", "DATA_BI"]))


@register("filter_level", "SELECT job_id FROM {v_jobs} WHERE level IN ('ENTRY', 'LEAD')")
def _(t):
    return ids(S.filter_level(t.v_jobs, ["ENTRY", "LEAD"]))


@register("filter_work_mode", "SELECT job_id FROM {v_jobs} WHERE work_mode IN ('REMOTE', 'HYBRID')")
def _(t):
    return ids(S.filter_work_mode(t.v_jobs, ["REMOTE", "HYBRID"]))


@register("filter_location", "SELECT job_id FROM {v_jobs} WHERE location ILIKE '%dhaka%' OR location ILIKE '%anywhere%' OR work_mode = 'REMOTE'")
def _(t):
    return ids(S.filter_location(t.v_jobs, "dhaka"))


@register("filter_max_experience", "SELECT job_id FROM {v_jobs} WHERE min_experience_years IS NULL OR min_experience_years <= 3")
def _(t):
    return ids(S.filter_max_experience(t.v_jobs, 3))


@register("filter_cgpa", "SELECT job_id FROM {v_jobs} WHERE min_cgpa IS NULL OR min_cgpa <= 2.75")
def _(t):
    return ids(S.filter_cgpa(t.v_jobs, 2.75))


@register("filter_masters", "SELECT job_id FROM {v_jobs} WHERE masters_required IS NOT TRUE")
def _(t):
    return ids(S.filter_masters(t.v_jobs, "not-required"))


@register("filter_masters_required", "SELECT job_id FROM {v_jobs} WHERE masters_required")
def _(t):
    return ids(S.filter_masters(t.v_jobs, "required"))


@register("filter_published", "SELECT job_id FROM {v_jobs} WHERE first_discovered_at >= $NOW$ - INTERVAL 168 HOUR")
def _(t):
    return ids(S.filter_published(t.v_jobs, "7d", NOW))


@register("filter_deadline", "SELECT job_id FROM {v_jobs} WHERE deadline BETWEEN $NOW$ AND $NOW$ + INTERVAL 3 DAY")
def _(t):
    return ids(S.filter_deadline(t.v_jobs, "3d", NOW))


@register("filter_match", f"SELECT job_id FROM {{v_jobs}} j WHERE EXISTS (SELECT 1 FROM {{v_matches}} m WHERE m.job_id = j.job_id AND m.user_id = {USER} AND verdict IN ('STRONG', 'WEAK', 'POSSIBLE') AND score >= 20)")
def _(t):
    return ids(S.filter_match(t.v_jobs, t.v_matches, USER, ["STRONG", "WEAK", "POSSIBLE"], 20))


_ORDERS = {
    "newest": "first_discovered_at DESC, job_id DESC",
    "deadline": "deadline ASC NULLS LAST, first_discovered_at DESC, job_id DESC",
    "experience": "min_experience_years ASC NULLS LAST, first_discovered_at DESC, job_id DESC",
    "organization": "o.name, title, job_id DESC",
    "verified": "last_verified_at DESC, job_id DESC",
}


def _page_sql(where, order, page=1):
    return f"""SELECT * FROM (SELECT job_id, title, o.name AS org_name, cast(row_number() OVER (ORDER BY {order}) as int) AS rank
      FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id) WHERE {where}) x WHERE rank > {20 * (page - 1)} AND rank <= {20 * page}"""


def _page(t, filters):
    page, _ = S.search_jobs(t.v_jobs, t.v_orgs, t.v_links, t.v_matches, t.v_saved, filters, NOW)
    return page.select("job_id", "title", "org_name", "rank")


for _s, _o in _ORDERS.items():
    register("sort_jobs" if _s == "newest" else f"sort_jobs_{_s}", _page_sql(ACTIVE, _o, 2))(lambda t, s=_s: _page(t, {"sort": s, "page": 2}))


@register("closing_page", _page_sql(f"{ACTIVE} AND deadline BETWEEN $NOW$ AND $NOW$ + INTERVAL 7 DAY", _ORDERS["deadline"]))
def _(t):
    return _page(t, {"deadline": "7d", "sort": "deadline"})


@register("search_combined", _page_sql(f"""{ACTIVE} AND (category IN ('NETWORK', 'DATABASE') OR list_has_any(secondary_categories, ['NETWORK', 'DATABASE']))
   AND level IN ('MID', 'SENIOR', 'ENTRY') AND (location ILIKE '%dhaka%' OR location ILIKE '%anywhere%' OR work_mode = 'REMOTE')
   AND (min_experience_years IS NULL OR min_experience_years <= 6) AND (min_cgpa IS NULL OR min_cgpa <= 3) AND masters_required IS NOT TRUE
   AND first_discovered_at >= $NOW$ - INTERVAL 720 HOUR""", _ORDERS["experience"]))
def _(t):
    return _page(t, {"category": ["NETWORK", "DATABASE"], "level": ["MID", "SENIOR", "ENTRY"], "location": "Dhaka", "max_experience": 6,
                     "my_cgpa": 3, "masters": "not-required", "published": "30d", "sort": "experience"})


@register("sort_match", f"""SELECT job_id, score, cast(row_number() OVER (ORDER BY score DESC, computed_at DESC, job_id DESC) as int) AS rank
  FROM {{v_jobs}} JOIN {{v_matches}} m USING (job_id) WHERE m.user_id = {USER} AND {ACTIVE} ORDER BY rank LIMIT 20""")
def _(t):
    page, _ = S.search_jobs(t.v_jobs, t.v_orgs, t.v_links, t.v_matches, t.v_saved, {"sort": "match"}, NOW, USER)
    return page.select("job_id", "score", "rank")


@register("paginate", f"SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 20.0)) as bigint) AS page_count FROM {{v_jobs}} WHERE {ACTIVE}")
def _(t):
    return S.page_totals(S.apply_filters(t.v_jobs, t.v_orgs, {}, NOW))


@register("decorate", f"""SELECT job_id, (SELECT count(*) FROM {{v_links}} l WHERE l.job_id = j.job_id) AS links, m.verdict AS my_verdict, m.score AS my_score,
   EXISTS (SELECT 1 FROM {{v_saved}} s WHERE s.job_id = j.job_id AND s.user_id = {USER}) AS saved
   FROM {{v_jobs}} j LEFT JOIN (SELECT * FROM {{v_matches}} WHERE user_id = {USER}) m USING (job_id) WHERE {ACTIVE}""")
def _(t):
    d = S.decorate(S.apply_filters(t.v_jobs, t.v_orgs, {}, NOW), t.v_links, t.v_matches, t.v_saved, USER)
    return d.select("job_id", "links", "my_verdict", "my_score", "saved")


_PRESET_SQL = {
    "all": "true", "new": "first_discovered_at >= $NOW$ - INTERVAL 168 HOUR", "closing": "deadline BETWEEN $NOW$ AND $NOW$ + INTERVAL 3 DAY",
    "public_bank": "o.type IN ('PUBLIC_BANK', 'GOVERNMENT')", "private_bank": "o.type IN ('PRIVATE_BANK', 'FOREIGN_BANK', 'NBFI', 'FINTECH')",
    **{g: f"(category IN {Q.strings(R.CATEGORY_GROUPS[g])} OR list_has_any(secondary_categories, {Q.listed(R.CATEGORY_GROUPS[g])}))" for g in R.CATEGORY_GROUPS},
}


register("preset_views", "SELECT preset, total, rank::int AS rank, job_id FROM (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS preset, count(*) OVER () AS total, row_number() OVER (ORDER BY {'deadline NULLS LAST, ' if n == 'closing' else ''}first_discovered_at DESC, job_id DESC) AS rank, job_id
    FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id) WHERE {ACTIVE} AND {w}""" for n, w in {**_PRESET_SQL, "org:org-0": "o.slug = 'org-0'"}.items()) + f") q WHERE rank <= {R.PAGE_SIZE}")(
    lambda t: S.preset_pages(t.v_jobs, t.v_orgs, NOW, ["org-0"]))


@register("home_stats", f"""SELECT (SELECT count(*) FROM {{v_jobs}} WHERE {ACTIVE}) AS open_jobs,
  (SELECT count(*) FROM {{v_jobs}} WHERE {VIS} AND first_discovered_at >= TIMESTAMP '1998-05-31 18:00:00') AS today,
  (SELECT count(*) FROM {{v_jobs}} WHERE {VIS} AND status = 'CLOSING_SOON') AS closing,
  (SELECT count(*) FROM {{v_orgs}} o WHERE EXISTS (SELECT 1 FROM {{v_jobs}} j WHERE j.org_id = o.org_id AND {VIS}) OR EXISTS (SELECT 1 FROM {{v_sources}} s WHERE s.org_id = o.org_id)) AS orgs""")
def _(t):
    return S.home_stats(t.v_jobs, t.v_sources, NOW)


@register("count_by_category", f"""SELECT d.category, cast(d.position - 1 as int) AS position, count(j.job_id) AS jobs
  FROM (SELECT unnest({Q.listed(R.CATEGORIES)}) AS category, generate_subscripts({Q.listed(R.CATEGORIES)}, 1) AS position) d
  LEFT JOIN (SELECT job_id, category FROM {{v_jobs}} WHERE {ACTIVE}) j USING (category) GROUP BY 1, 2""")
def _(t):
    return S.count_by_category(t.v_jobs)


@register("org_job_counts", f"SELECT o.slug, o.name, o.short_name, count(*) AS jobs FROM {{v_orgs}} o JOIN {{v_jobs}} j USING (org_id) WHERE {ACTIVE} GROUP BY 1, 2, 3")
def _(t):
    return S.org_job_counts(t.v_jobs, t.v_orgs)


@register("org_directory", f"""SELECT o.type, o.slug, o.name, (SELECT count(*) FROM {{v_jobs}} j WHERE j.org_id = o.org_id AND {ACTIVE}) AS jobs,
  coalesce((SELECT bool_or(method <> 'MANUAL' AND enabled) FROM {{v_sources}} s WHERE s.org_id = o.org_id), false) AS automated FROM {{v_orgs}} o""")
def _(t):
    return S.org_directory(t.v_jobs, t.v_orgs, t.v_sources)


@register("upcoming_deadlines", f"""SELECT j.slug, title, deadline, coalesce(short_name, name) AS org FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id)
  WHERE {ACTIVE} AND deadline >= $NOW$ ORDER BY deadline, job_id LIMIT 8""")
def _(t):
    return S.upcoming_deadlines(t.v_jobs, t.v_orgs, NOW)


@register("latest_jobs", f"""SELECT job_id, j.slug, title, first_discovered_at, name AS org_name FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id)
  WHERE {ACTIVE} ORDER BY first_discovered_at DESC, job_id DESC LIMIT 6""")
def _(t):
    return S.latest_jobs(t.v_jobs, t.v_orgs)


@register("best_matches", f"""SELECT user_id, cast(rank as int) AS rank, job_id, title, score, verdict, org_name FROM (
  SELECT m.user_id, m.job_id, m.score, m.verdict, j.title, o.name AS org_name, row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, m.job_id) AS rank
  FROM {{v_matches}} m JOIN {{v_jobs}} j USING (job_id) JOIN {{v_orgs}} o USING (org_id) WHERE m.verdict IN ('STRONG', 'POSSIBLE') AND {ACTIVE}) x WHERE rank <= 5""")
def _(t):
    return S.best_matches(t.v_matches, t.v_jobs, t.v_orgs)


@register("verdict_counts", f"SELECT user_id, verdict, count(*) AS n FROM {{v_matches}} JOIN {{v_jobs}} USING (job_id) WHERE {ACTIVE} GROUP BY 1, 2")
def _(t):
    return S.verdict_counts(t.v_matches, t.v_jobs)


@register("saved_jobs", """SELECT user_id, job_id, slug, title, deadline, cast(row_number() OVER (PARTITION BY user_id ORDER BY deadline ASC NULLS LAST, job_id) as int) AS position
  FROM {v_saved} JOIN {v_jobs} USING (job_id) WHERE archived_at IS NULL""")
def _(t):
    return S.saved_jobs(t.v_saved, t.v_jobs)


@register("recent_applications", """SELECT user_id, cast(rank as int) AS rank, slug, title, status, updated_at FROM (
  SELECT a.user_id, j.slug, j.title, a.status, a.updated_at, row_number() OVER (PARTITION BY a.user_id ORDER BY a.updated_at DESC, a.job_id) AS rank
  FROM {v_apps} a JOIN {v_jobs} j USING (job_id)) x WHERE rank <= 5""")
def _(t):
    return S.recent_applications(t.v_apps, t.v_jobs)


@register("application_funnel", f"SELECT user_id, status, count(*) AS n, cast(list_position({Q.listed(R.APPLICATION_STATUSES)}, status) as int) AS stage FROM {{v_apps}} GROUP BY 1, 2")
def _(t):
    return S.application_funnel(t.v_apps)


@register("deadline_calendar", f"""SELECT {Q.local_day('deadline')} AS day, row_number() OVER (PARTITION BY {Q.local_day('deadline')} ORDER BY deadline, job_id) AS position,
   j.slug, title, status, coalesce(short_name, name) AS org FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id)
   WHERE {VIS} AND deadline >= TIMESTAMP '1998-05-31 18:00:00' AND deadline < TIMESTAMP '1998-06-30 18:00:00'""")
def _(t):
    return S.deadline_calendar(t.v_jobs, t.v_orgs, 1998, 6)


_ADMIN = {"pending": "review_status = 'PENDING' AND archived_at IS NULL", "active": VIS, "archived": "archived_at IS NOT NULL", "demo": "is_demo", "all": "true"}
for _v, _w in _ADMIN.items():
    register("admin_jobs" if _v == "pending" else f"admin_jobs_{_v}", f"""SELECT job_id, title, o.name AS org_name, created_at, submitted_by,
      (SELECT count(*) FROM {{v_links}} l WHERE l.job_id = j.job_id) AS links, (SELECT count(*) FROM {{v_reports}} r WHERE r.job_id = j.job_id) AS reports
      FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id) WHERE {_w} {"AND (title ILIKE '%engineer%' OR o.name ILIKE '%engineer%')" if _v == 'all' else ''}
      ORDER BY created_at DESC, job_id DESC LIMIT 100""")(
        lambda t, v=_v: S.admin_jobs(t.v_jobs, t.v_orgs, t.v_links, t.v_reports, v, "Engineer" if v == "all" else None))


@register("admin_overview", f"""WITH recent AS (SELECT * FROM {{v_runs}} WHERE started_at >= $EVENTS_NOW$ - INTERVAL 24 HOUR),
  health AS (SELECT CASE WHEN method = 'MANUAL' THEN 'manual' WHEN NOT enabled THEN 'disabled' WHEN last_run_at IS NULL THEN 'pending'
    WHEN consecutive_failures >= 3 THEN 'failing' WHEN consecutive_failures > 0 OR last_success_at IS NULL THEN 'warning'
    WHEN epoch_us($NOW$) - epoch_us(last_success_at) > fetch_interval_minutes::bigint * 180000000 THEN 'warning' ELSE 'healthy' END AS h FROM {{v_sources}})
  SELECT concat('runs:', status) AS metric, count(*) AS n FROM recent GROUP BY 1
  UNION ALL SELECT 'parse_errors', cast(coalesce(sum(parse_errors), 0) as bigint) FROM recent
  UNION ALL SELECT 'pending_jobs', count(*) FROM {{v_jobs}} WHERE review_status = 'PENDING' AND archived_at IS NULL
  UNION ALL SELECT 'pending_duplicates', count(*) FROM {{v_duplicates}} WHERE status = 'PENDING'
  UNION ALL SELECT 'open_reports', count(*) FROM {{v_reports}} WHERE status = 'OPEN'
  UNION ALL SELECT 'open_jobs', count(*) FROM {{v_jobs}} WHERE {ACTIVE}
  UNION ALL SELECT concat('health:', h), count(*) FROM health GROUP BY 1
  UNION ALL SELECT 'sources', count(*) FROM {{v_sources}}""")
def _(t):
    return S.admin_overview(t.v_jobs, t.v_sources, t.v_runs, t.v_duplicates, t.v_reports, NOW, EVENTS_NOW)


@register("links_per_source", "SELECT source_id, count(*) AS links FROM {v_links} GROUP BY 1")
def _(t):
    return S.links_per_source(t.v_links)


@register("last_runs", "SELECT run_id, source_id, started_at, status FROM {v_runs} ORDER BY started_at DESC, run_id DESC LIMIT 10")
def _(t):
    return S.last_runs(t.v_runs).select("run_id", "source_id", "started_at", "status")


@register("delivery_summary", "SELECT channel, status, count(*) AS n FROM {v_deliveries} WHERE created_at >= $NOW$ - INTERVAL 168 HOUR GROUP BY 1, 2")
def _(t):
    return S.delivery_summary(t.v_deliveries, NOW)


@register("latest_deliveries", """SELECT d.notification_id, channel, status, d.created_at, title, type, user_id FROM {v_deliveries} d LEFT JOIN {v_notifications} n USING (notification_id)
  ORDER BY d.created_at DESC, d.notification_id, channel, status LIMIT 200""")
def _(t):
    return S.latest_deliveries(t.v_deliveries, t.v_notifications)


@register("source_runs", """SELECT source_id, cast(rank as int) AS rank, run_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rank FROM {v_runs}) x WHERE rank <= 30""")
def _(t):
    return S.source_runs(t.v_runs).select("source_id", "rank", "run_id", "status")


def _users(t):
    return t.customer.select(c("c_custkey").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


_USERS = "(SELECT c_custkey AS user_id, concat(lower(c_name), '@example.com') AS email FROM customer)"


@register("open_reports", f"""SELECT report_id, r.status, reason, r.created_at, title, email FROM {{v_reports}} r JOIN {{v_jobs}} USING (job_id) LEFT JOIN {_USERS} u USING (user_id)
  ORDER BY list_position({Q.listed(R.REPORT_STATUSES)}, r.status), r.created_at DESC, report_id LIMIT 200""")
def _(t):
    return S.open_reports(t.v_reports, t.v_jobs, _users(t))


@register("audit_log", f"""SELECT audit_id, action, created_at, email FROM {{v_audit}} LEFT JOIN {_USERS} u ON u.user_id = actor_id ORDER BY created_at DESC, audit_id DESC LIMIT 300""")
def _(t):
    return S.audit_log(t.v_audit, _users(t))


@register("job_detail", """SELECT job_id, title, o.name AS org_name, status, cast(row_number() OVER (ORDER BY first_seen_at, external_key) as int) AS position, external_key, first_seen_at
  FROM {v_jobs} j JOIN {v_orgs} o USING (org_id) LEFT JOIN {v_links} l USING (job_id) WHERE j.slug = 'job-42'""")
def _(t):
    return S.job_detail(t.v_jobs, t.v_orgs, t.v_links, "job-42")


@register("unread_count", "SELECT user_id, count(*) FILTER (read_at IS NULL) AS unread FROM {v_notifications} GROUP BY 1")
def _(t):
    return S.unread_count(t.v_notifications)


@register("notification_history", """SELECT user_id, cast(rank as int) AS rank, notification_id, title,
   coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT concat(channel, ':', status) AS k FROM {v_deliveries} d WHERE d.notification_id = x.notification_id) y), '') AS deliveries
   FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS rank FROM {v_notifications}) x WHERE rank <= 100""")
def _(t):
    return S.notification_history(t.v_notifications, t.v_deliveries)


@register("is_indexable", f"""SELECT job_id, NOT is_demo AND {VIS} AND status <> 'REMOVED' AND (deadline IS NULL OR deadline >= $NOW$ - INTERVAL 14 DAY) AS indexable FROM {{v_jobs}}""")
def _(t):
    return t.v_jobs.select("job_id", S.is_indexable(NOW).alias("indexable"))


_LOG = """SELECT event_id, CASE WHEN event_id % 10 = 9 THEN repeat('x', 120) WHEN event_id % 4 = 0 THEN '  ' ELSE concat(' Java ', cast(user_id as $STR$), ' ') END AS q,
  split_part('NETWORK,DATA_BI|OOPS,DATABASE||nothing', '|', cast(event_id % 4 + 1 as int)) AS category, split_part('required|maybe|any', '|', cast(event_id % 3 + 1 as int)) AS masters,
  split_part('45| 7.5 |abc|', '|', cast(event_id % 4 + 1 as int)) AS score FROM {events}"""


@register("parse_search_log", f"""SELECT event_id, CASE WHEN length(q) <= 100 THEN nullif(trim(q), '') END AS q, CASE WHEN length(q) <= 100 THEN array_to_string(list_filter(string_split(category, ','), lambda x: x IN {Q.strings(R.CATEGORIES)}), ',') ELSE '' END AS category,
   CASE WHEN length(q) <= 100 AND masters IN ('any', 'not-required', 'required') THEN masters END AS masters, CASE WHEN length(q) <= 100 THEN try_cast(trim(score) as double) END AS min_score FROM ({_LOG}) l""")
def _(t):
    from .views import _fill
    raw = t.spark.sql(_fill(_LOG, "spark"), events=t.events)
    params = F.create_map(F.lit("q"), "q", F.lit("category"), "category", F.lit("masters"), "masters", F.lit("minScore"), "score")
    f = S.parse_search_log(raw.select("event_id", params.alias("params")))
    return f.select("event_id", "q", F.array_join("category", ",").alias("category"), "masters", c("minScore").alias("min_score"))
