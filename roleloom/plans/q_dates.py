"""Calendar functions."""

from pyspark.sql import functions as F

from ..functions import dates as D
from . import sqltext as Q
from .core import register
from .views import NOW, div, pick

c = F.col
def now_col():
    return D.ts_lit(NOW)

_TEXTS = "CASE cast(o_orderkey % 10 as int) " + " ".join(f"WHEN {k} THEN {v}" for k, v in {
    0: "concat(cast(1 + o_orderkey % 31 as $STR$), '/', cast(1 + o_orderkey % 12 as $STR$), '/2026')",
    1: "concat('2026-', lpad(cast(1 + o_orderkey % 12 as $STR$), 2, '0'), '-', lpad(cast(1 + o_orderkey % 31 as $STR$), 2, '0'))",
    2: "concat(cast(1 + o_orderkey % 31 as $STR$), 'th ', " + pick(div("o_orderkey", 10), "January", "feb", "Sept", "October", "Foo") + ", ', 2027')",
    3: "concat(" + pick(div("o_orderkey", 10), "March", "Apr", "june", "Dec", "Nope") + ", ' ', cast(1 + o_orderkey % 31 as $STR$), ', 2025')",
    4: "concat(cast(1 + o_orderkey % 28 as $STR$), '-Oct-2026 (Thursday)')",
    5: "concat('2026-10-', lpad(cast(1 + o_orderkey % 31 as $STR$), 2, '0'), 'T10:30:00Z')",
    6: "concat('on 0', cast(o_orderkey % 10 as $STR$), '.11.1999 or later')",
    7: "'  Open until filled '",
    8: "concat(cast(1 + o_orderkey % 31 as $STR$), '-', cast(1 + o_orderkey % 15 as $STR$), '-2028')",
    9: "NULL",
}.items()) + " END"


@register("parse_local_date", f"SELECT o_orderkey, txt, {Q.parse_local_date('txt')} AS parsed FROM (SELECT o_orderkey, {_TEXTS} AS txt FROM orders) x")
def _(t):
    texts = t.orders.select("o_orderkey", F.expr(_TEXTS.replace("$STR$", "string")).alias("txt"))
    return texts.select("o_orderkey", "txt", D.parse_local_date(c("txt")).alias("parsed"))


@register("local_day_key", f"SELECT event_id, {Q.local_day('ts')} AS day FROM events")
def _(t):
    return t.events.select("event_id", D.local_day_key(c("ts")).alias("day"))


@register("start_of_local_day", "SELECT event_id, date_trunc('day', ts + INTERVAL 6 HOUR) - INTERVAL 6 HOUR AS start_ts FROM events")
def _(t):
    return t.events.select("event_id", D.start_of_local_day(c("ts")).alias("start_ts"))


@register("end_of_local_day", "SELECT event_id, date_trunc('day', ts + INTERVAL 6 HOUR) - INTERVAL 6 HOUR + INTERVAL 86399 SECOND AS end_ts FROM events")
def _(t):
    return t.events.select("event_id", D.end_of_local_day(c("ts")).alias("end_ts"))


@register("hours_until", f"SELECT job_id, round({Q.hours_until('deadline', '$NOW$')}, 6) AS hours FROM {{v_jobs0}}")
def _(t):
    return t.v_jobs0.select("job_id", F.round(D.hours_until(c("deadline"), now_col()), 6).alias("hours"))


@register("add_hours", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MINUTE * (30 * (o_orderkey % 100)) AS later FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.add_hours(c("o_orderdate"), (c("o_orderkey") % 100) * F.lit(0.5)).alias("later"))


@register("add_days", "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY * (o_orderkey % 100) AS later FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.add_days(c("o_orderdate"), (c("o_orderkey") % 100).cast("double")).alias("later"))


@register("hours_ago", "SELECT o_orderkey, $NOW$ - INTERVAL '1' HOUR * (o_orderkey % 100) AS earlier FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.add_hours(now_col(), -(c("o_orderkey") % 100).cast("double")).alias("earlier"))


_H = Q.hours_until("deadline", "$NOW$")


@register("time_left_label", f"""SELECT job_id, CASE WHEN deadline IS NULL THEN 'No deadline stated' WHEN h <= 0 THEN 'Expired' WHEN h < 1 THEN 'Less than 1 hour left'
  WHEN h < 48 THEN concat(cast(floor(h) as bigint), CASE WHEN floor(h) = 1 THEN ' hour left' ELSE ' hours left' END) ELSE concat(cast(floor(h / 24) as bigint), ' days left') END AS label
  FROM (SELECT job_id, deadline, {_H} AS h FROM {{v_jobs0}}) x""")
def _(t):
    return t.v_jobs0.select("job_id", D.time_left_label(c("deadline"), now_col()).alias("label"))


@register("format_local_date", f"SELECT job_id, {Q.fmt_date('deadline')} AS label FROM {{v_jobs0}}")
def _(t):
    return t.v_jobs0.select("job_id", D.format_local_date(c("deadline")).alias("label"))


@register("format_local_datetime", f"SELECT event_id, {Q.fmt_datetime('ts')} AS label FROM events")
def _(t):
    return t.events.select("event_id", D.format_local_datetime(c("ts")).alias("label"))


@register("month_grid", """WITH days AS (SELECT unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY))::date AS d),
  n AS (SELECT cast(deadline + INTERVAL 6 HOUR as date) AS d, count(*) AS jobs FROM {v_jobs} WHERE archived_at IS NULL AND review_status = 'APPROVED'
     AND deadline >= TIMESTAMP '1998-05-31 18:00:00' AND deadline < TIMESTAMP '1998-06-30 18:00:00' GROUP BY 1),
  cells AS (SELECT i AS cell, CASE WHEN i - 2 BETWEEN 0 AND 29 THEN DATE '1998-06-01' + cast(i - 2 as int) END AS d FROM (SELECT unnest(generate_series(0, 34)) AS i) s)
  SELECT cast(cell as int) AS cell, cast(cell // 7 as int) AS week, cast(cell % 7 as int) AS weekday, strftime(cells.d, '%Y-%m-%d') AS day, coalesce(jobs, 0) AS jobs
  FROM cells LEFT JOIN n ON n.d = cells.d""")
def _(t):
    from ..operators.search import month_grid
    return month_grid(t.v_jobs, 1998, 6)
