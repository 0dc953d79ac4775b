"""Alert queries."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import alerts as A
from . import sqltext as Q
from .core import register
from .views import EVENTS_NOW, NOW, _fill

c = F.col
_ACT = f"status IN {Q.strings(R.ACTIVE_STATUSES)}"
_FAIL = """CASE WHEN len(categories) > 0 AND NOT list_contains(categories, category) AND NOT list_has_any(secondary_categories, categories) THEN 'category'
  WHEN len(organization_slugs) > 0 AND NOT list_contains(organization_slugs, org_slug) THEN 'organization' WHEN len(org_types) > 0 AND NOT list_contains(org_types, org_type) THEN 'org type'
  WHEN len(levels) > 0 AND level IS NOT NULL AND NOT list_contains(levels, level) THEN 'level'
  WHEN len(locations) > 0 AND location IS NOT NULL AND work_mode <> 'REMOTE' AND NOT contains(lower(location), 'anywhere') AND len(list_filter(locations, lambda x: contains(lower(location), lower(x)))) = 0 THEN 'location'
  WHEN verdict = 'NOT_ELIGIBLE' AND academic_only THEN 'not eligible' WHEN verdict <> 'MANUAL_REVIEW' AND score < min_match_score THEN 'score' END"""
_AJ = "aj AS (SELECT j.*, o.slug AS org_slug, o.type AS org_type, coalesce(o.short_name, o.name) AS org FROM {v_jobs} j JOIN {v_orgs} o USING (org_id))"
_LABEL = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.VERDICT_LABELS.items()) + " END"
COLS = ["user_id", "job_id", "type", "title", "body", "url", "priority", "dedupe_key", "deliver_now"]


@register("preference_matches", f"WITH {_AJ} SELECT user_id, job_id, coalesce({_FAIL}, 'ok') AS reason FROM {{v_views}} JOIN {{v_prefs}} p USING (user_id) JOIN aj USING (job_id) LEFT JOIN {{v_matches}} m USING (user_id, job_id)")
def _(t):
    # Pairs meet their match where they were made distinct, and the narrower job before the preference: wide rows are shuffled once.
    p = t.v_views.join(t.v_matches.select("user_id", "job_id", "verdict", "score"), ["user_id", "job_id"], "left").join(A._alert_jobs(t.v_jobs, t.v_orgs), "job_id").join(t.v_prefs, "user_id")
    return p.select("user_id", "job_id", F.coalesce(A.preference_reason(), F.lit("ok")).alias("reason"))


_H = Q.hours_until("deadline", "$NOW$")
_HOT = f"coalesce(verdict = 'STRONG' AND {_H} > 0 AND {_H} <= 72, false)"
_WIN = f"CASE WHEN {_H} <= 0 THEN NULL " + " ".join(f"WHEN {_H} <= {h} THEN '{k}'" for k, h, _ in R.REMINDER_WINDOWS) + " END"


@register("is_high_priority", f"SELECT user_id, job_id, {_HOT} AS hot FROM {{v_matches}} JOIN {{v_jobs}} USING (job_id)")
def _(t):
    return t.v_matches.join(t.v_jobs.select("job_id", "deadline"), "job_id").select("user_id", "job_id", A.is_high_priority(NOW).alias("hot"))


@register("reminder_window", f"SELECT job_id, {_WIN} AS win FROM {{v_jobs}}")
def _(t):
    return t.v_jobs.select("job_id", A.reminder_window(c("deadline"), NOW).alias("win"))


_NEW = f"""WITH {_AJ}, nj AS (SELECT * FROM aj WHERE review_status = 'APPROVED' AND {_ACT} AND first_discovered_at >= $NOW$ - INTERVAL 48 HOUR),
  al AS (SELECT p.user_id, nj.job_id, {_HOT} AS hot, mode, title, org, slug, deadline, verdict, score FROM {{v_prefs}} p CROSS JOIN nj LEFT JOIN {{v_matches}} m ON m.user_id = p.user_id AND m.job_id = nj.job_id WHERE ({_FAIL}) IS NULL)
  SELECT user_id, job_id, CASE WHEN hot THEN 'HIGH_PRIORITY' ELSE 'NEW_JOB' END AS type, org || CASE WHEN hot THEN ' hires, last days: ' ELSE ' hires: ' END || title AS title,
    coalesce('Your fit: ' || {_LABEL} || ' (' || score || '/100)', 'Complete your profile and we rate your fit') || '. Open until ' || {Q.fmt_date('deadline')} || '.' AS body, '/jobs/' || slug AS url, hot AS priority,
    'new:' || user_id || ':' || job_id AS dedupe_key, mode = 'IMMEDIATE' OR hot AS deliver_now FROM al"""


def new_jobs(t):
    return t.v_jobs.where(F.expr(f"first_discovered_at >= TIMESTAMP_NTZ '{NOW}' - INTERVAL '48' HOUR"))


@register("notify_new_jobs", _NEW)
def _(t):
    return A.notify_new_jobs(new_jobs(t), t.v_orgs, t.v_prefs, t.v_matches, NOW)


@register("notify_job_updates", f"""SELECT u.user_id, j.job_id, 'JOB_UPDATED' AS type, title || ': new closing date' AS title, 'Applications are now taken until ' || {Q.fmt_datetime('deadline')} || '.' AS body, '/jobs/' || slug AS url,
  false AS priority, 'update:' || u.user_id || ':' || j.job_id || ':' || coalesce({Q.iso_utc('deadline')}, 'none') AS dedupe_key, true AS deliver_now
  FROM {{v_jobs}} j JOIN (SELECT user_id, job_id FROM {{v_saved}} UNION SELECT user_id, job_id FROM {{v_apps}}) u USING (job_id) WHERE j.updated_at >= $NOW$ - INTERVAL 240 HOUR""")
def _(t):
    changed = t.v_jobs.where(F.expr(f"updated_at >= TIMESTAMP_NTZ '{NOW}' - INTERVAL '240' HOUR"))
    return A.notify_job_updates(changed, t.v_saved, t.v_apps)


_LBL = "CASE win " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, _h, label in R.REMINDER_WINDOWS) + " END"


@register("deadline_reminders", f"""WITH d AS (SELECT *, {_WIN} AS win FROM {{v_jobs}} WHERE deadline > $NOW$ AND deadline <= $NOW$ + INTERVAL 7 DAY AND archived_at IS NULL AND {_ACT}),
  u AS (SELECT user_id, job_id FROM {{v_saved}} UNION SELECT user_id, job_id FROM {{v_apps}} WHERE status IN ('NOT_APPLIED', 'PLANNING'))
  SELECT u.user_id, d.job_id, 'DEADLINE_REMINDER' AS type, title || ' closes in ' || {_LBL} AS title, 'The employer takes applications until ' || {Q.fmt_datetime('deadline')} || '.' AS body, '/jobs/' || slug AS url,
   win IN ('6h', '24h') AS priority, 'deadline:' || win || ':' || u.user_id || ':' || d.job_id AS dedupe_key, true AS deliver_now FROM d JOIN u USING (job_id) LEFT JOIN {{v_prefs}} p ON p.user_id = u.user_id WHERE deadline_reminders IS NOT FALSE""")
def _(t):
    return A.deadline_reminders(t.v_jobs, t.v_saved, t.v_apps, t.v_prefs, NOW)


@register("closing_soon_alerts", f"""WITH {_AJ} SELECT user_id, job_id, 'CLOSING_SOON' AS type, title || ' at ' || org || ' ends shortly' AS title, 'Your fit: ' || {_LABEL} || ' (' || score || '/100). Open until ' || {Q.fmt_datetime('deadline')} || '.' AS body, '/jobs/' || slug AS url,
  verdict = 'STRONG' AS priority, 'closing:' || user_id || ':' || job_id AS dedupe_key, mode = 'IMMEDIATE' OR verdict = 'STRONG' AS deliver_now
  FROM {{v_matches}} m JOIN aj USING (job_id) JOIN {{v_prefs}} p USING (user_id) WHERE archived_at IS NULL AND review_status = 'APPROVED' AND aj.status = 'CLOSING_SOON' AND verdict IN ('STRONG', 'POSSIBLE')
   AND closing_soon_alerts AND NOT EXISTS (SELECT 1 FROM {{v_saved}} s WHERE s.user_id = m.user_id AND s.job_id = m.job_id) AND ({_FAIL}) IS NULL""")
def _(t):
    return A.closing_soon_alerts(t.v_jobs, t.v_orgs, t.v_matches, t.v_saved, t.v_prefs)


_ATTEMPTS = """SELECT concat('k:', cast(user_id as $STR$), ':', cast(cast(floor(value) as bigint) as $STR$)) AS dedupe_key, user_id, ts AS created_at, event_id FROM {events} WHERE event_type IN ('click', 'view')"""
_SEEN = """SELECT DISTINCT concat('k:', cast(user_id as $STR$), ':', cast(cast(floor(value) as bigint) as $STR$)) AS dedupe_key FROM {events} WHERE event_type = 'error'"""


@register("emit_once", f"""SELECT dedupe_key, user_id, created_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at, user_id, event_id) AS r FROM ({_ATTEMPTS}) a
  WHERE dedupe_key NOT IN ({_SEEN})) x WHERE r = 1""")
def _(t):
    return A.emit_once(t.spark.sql(_fill(_ATTEMPTS, "spark"), events=t.events), t.spark.sql(_fill(_SEEN, "spark"), events=t.events))


_SENT = "SELECT concat('digest:', cast(c_custkey as $STR$), ':1998-06-01') AS dedupe_key FROM {customer} WHERE c_custkey % 4 = 1"


@register("daily_digest", f"""WITH d AS (SELECT user_id, count(*) AS items, substr(string_agg('• ' || title || chr(10) || '  ' || body || coalesce(chr(10) || '  ' || url, ''), chr(10) || chr(10) ORDER BY created_at, notification_id), 1, 8000) AS body,
   'digest:' || user_id || ':1998-06-01' AS dedupe_key FROM {{v_notifications}} WHERE digest_pending GROUP BY user_id) SELECT dedupe_key, user_id, items, body FROM d WHERE dedupe_key NOT IN ({_SENT})""")
def _(t):
    return A.daily_digest(t.v_notifications, t.spark.sql(_fill(_SENT, "spark"), customer=t.customer), NOW)


@register("after_digest", f"""WITH d AS (SELECT DISTINCT user_id FROM {{v_notifications}} WHERE digest_pending AND 'digest:' || user_id || ':1998-06-01' NOT IN ({_SENT}))
  SELECT notification_id, digest_pending AND user_id NOT IN (SELECT user_id FROM d) AS digest_pending FROM {{v_notifications}}""")
def _(t):
    sent = A.daily_digest(t.v_notifications, t.spark.sql(_fill(_SENT, "spark"), customer=t.customer), NOW)
    return A.after_digest(t.v_notifications, sent).select("notification_id", "digest_pending")


@register("channel_fanout", """SELECT notification_id, user_id, channel FROM (SELECT n.notification_id, n.user_id, NOT digest_pending AS d, p.* EXCLUDE (user_id) FROM {v_notifications} n LEFT JOIN {v_prefs} p ON p.user_id = n.user_id) q,
  LATERAL (SELECT 'IN_APP' AS channel UNION ALL SELECT 'EMAIL' WHERE d AND email_enabled IS NOT FALSE UNION ALL SELECT 'TELEGRAM' WHERE d AND telegram_enabled AND telegram_chat_id <> '' UNION ALL SELECT 'PUSH' WHERE d AND push_enabled) x""")
def _(t):
    return A.channel_fanout(t.v_notifications.withColumn("deliver_now", ~c("digest_pending")), t.v_prefs)


_SENDS = """SELECT event_id AS send_id, cast(floor(value) as bigint) AS notification_id, user_id, concat('ep-', cast(user_id as $STR$), '-', cast(event_id % 3 as $STR$)) AS endpoint,
  cast(CASE WHEN event_id % 50 = 7 THEN 410 WHEN event_id % 3 = 0 THEN 500 WHEN event_id % 91 = 5 THEN 404 ELSE 201 END as int) AS http_status, concat('error ', cast(event_id as $STR$)) AS error FROM {events}"""


def sends(t):
    return t.spark.sql(_fill(_SENDS, "spark"), events=t.events)


@register("push_outcome", f"""SELECT notification_id, user_id, CASE WHEN n > 0 THEN 'SENT' ELSE 'FAILED' END AS status, CASE WHEN n > 0 THEN n || ' device(s)' END AS target, CASE WHEN n = 0 THEN e END AS error FROM (
  SELECT notification_id, user_id, count(*) FILTER (http_status < 300) AS n, arg_max(error, send_id) FILTER (http_status >= 300) AS e FROM ({_SENDS}) s GROUP BY 1, 2) q""")
def _(t):
    return A.push_outcome(sends(t))


@register("live_endpoints", f"SELECT DISTINCT endpoint, user_id FROM ({_SENDS}) s WHERE endpoint NOT IN (SELECT endpoint FROM ({_SENDS}) g WHERE http_status IN (404, 410))")
def _(t):
    return A.live_endpoints(sends(t).select("endpoint", "user_id").distinct(), sends(t))


@register("saved_state", "SELECT user_id, job_id, max(ts) AS saved_at FROM {v_toggles} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def _(t):
    return A.saved_state(t.v_toggles)


@register("application_state", "SELECT user_id, job_id, event_id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY ts DESC, event_id DESC) AS r FROM {v_app_events}) x WHERE r = 1")
def _(t):
    return A.application_state(t.v_app_events)


_READS = "SELECT user_id, CASE WHEN event_type = 'view' THEN cast(floor(value) as bigint) END AS notification_id, ts FROM {events} WHERE event_type IN ('view', 'signup')"
_ALERTS = "SELECT event_id AS notification_id, user_id, ts AS created_at, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL '1' HOUR * 2 END AS read_at FROM {events} WHERE event_type IN ('purchase', 'click')"


@register("read_state", f"""SELECT notification_id, user_id, coalesce(read_at, least((SELECT min(ts) FROM ({_READS}) r WHERE r.notification_id = a.notification_id),
   (SELECT min(ts) FROM ({_READS}) r WHERE r.notification_id IS NULL AND r.user_id = a.user_id AND r.ts >= a.created_at))) AS read_at FROM ({_ALERTS}) a""")
def _(t):
    return A.read_state(t.spark.sql(_fill(_ALERTS, "spark"), events=t.events), t.spark.sql(_fill(_READS, "spark"), events=t.events))


_SUBS = "SELECT event_id, user_id, ts, concat('ep-', cast(user_id as $STR$), '-', cast(event_id % 5 as $STR$)) AS endpoint, CASE WHEN event_type = 'error' THEN 'unsubscribe' ELSE 'subscribe' END AS action FROM {events} WHERE event_type IN ('signup', 'error')"


@register("push_state", f"SELECT endpoint, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS r FROM ({_SUBS}) s) x WHERE r = 1 AND action = 'subscribe'")
def _(t):
    return A.push_state(t.spark.sql(_fill(_SUBS, "spark"), events=t.events))[0].select("endpoint", "user_id", "ts")


@register("profile_state", "SELECT user_id, event_id, ts, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value >= 0 AND props IS NOT NULL) x WHERE r = 1")
def _(t):
    valid = t.events.where((c("value") >= 0) & c("props").isNotNull()).drop("event_type")
    return A.latest_per(valid, ["user_id"], ["ts", "event_id"])


_PREF_EVENTS = "SELECT event_id, user_id, ts, event_id % 3 = 0 AS push_enabled, CASE WHEN event_id % 2 = 0 THEN 'IMMEDIATE' ELSE 'DAILY_DIGEST' END AS mode FROM {events} WHERE event_type = 'purchase'"


@register("preference_state", f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({_PREF_EVENTS}) p) q WHERE r = 1),
  s AS (SELECT user_id, max(ts) AS sub FROM ({_SUBS}) u WHERE action = 'subscribe' GROUP BY 1)
  SELECT coalesce(l.user_id, s.user_id) AS user_id, event_id, mode, coalesce(push_enabled, false) OR coalesce(sub > ts, ts IS NULL) AS push_enabled FROM l FULL JOIN s ON s.user_id = l.user_id""")
def _(t):
    p = t.spark.sql(_fill(_PREF_EVENTS, "spark"), events=t.events)
    return A.preference_state(p, t.spark.sql(_fill(_SUBS, "spark"), events=t.events)).select("user_id", "event_id", "mode", "push_enabled")
