"""Extraction, registry and export queries.  The markup is built from the tables, so its amount grows with them."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources import feeds as Fe, markup as Mk, registry as Rg, tables as Tb
from . import sqltext as Q
from .q_search import ACTIVE
from .core import register
from .views import NOW, _fill

c = F.col
_K, _E = "cast(job_id as $STR$)", "replace(title, '&', '&amp;')"
_URL = f"concat('https://site', {_K}, '.example.com/careers/list.html')"
_TABLE = f"""SELECT job_id, title, department, {_URL} AS url, concat('<html><body><!-- <table><tr><th>Post</th></tr><tr><td>old</td></tr></table> --><table><tr><td>menu</td></tr></table><table><tr><th>Post Name</th><th>Unit</th><th>Last date</th></tr>',
  '<tr><td><span id="r', {_K}, '"></span><a href="view/', {_K}, '">', {_E}, '</a></td><td> ', coalesce(department, ''), '  </td><td>', cast(1 + job_id % 28 as $STR$), '-Oct-2026</td></tr>',
  '<tr><th><a href="javascript:void(0)">Exam result, ', {_E}, '</a></th><td>2</td><td>x</td></tr></table></body></html>') AS html FROM {{v_jobs0}}"""


def sql(t, text):
    return t.spark.sql(_fill(text, "spark"), v_jobs0=t.dealt("v_jobs0"))


_SITE = "concat('https://site', job_id::varchar, '.example.com/careers/')"


@register("extract_table_rows", f"""SELECT url AS page_url, 1 AS pos, concat_ws('|', title, coalesce(department, ''), concat(1 + job_id % 28, '-Oct-2026')) AS cells, concat({_SITE}, 'view/', job_id) AS links, concat('r', job_id) AS row_id FROM ({_TABLE}) x
  UNION ALL SELECT url, 2, concat_ws('|', concat('Exam result, ', title), '2', 'x'), '', NULL FROM ({_TABLE}) y""")
def _(t):
    return Mk.extract_table_rows(sql(t, _TABLE), "post name").select("page_url", "pos", F.array_join("cells", "|").alias("cells"), F.array_join("links", "|").alias("links"), "row_id")


@register("table_rows_to_postings", f"""SELECT concat('r', job_id) AS source_job_id, title, nullif(department, '') AS department, concat_ws(chr(10), title, department, concat('Deadline: ', 1 + job_id % 28, '-Oct-2026')) AS description,
  DATE '2026-10-01' + cast(job_id % 28 as int) - INTERVAL 6 HOUR + INTERVAL 86399 SECOND AS deadline, concat({_SITE}, 'view/', job_id) AS application_url, url AS source_url FROM ({_TABLE}) x""")
def _(t):
    rows = Mk.extract_table_rows(sql(t, _TABLE), "post name")
    return Mk.table_rows_to_postings(rows, {"title": 0, "department": 1, "deadline": 2}).drop("published_at")


_LIST = f"""SELECT job_id, title, {_URL} AS url, concat('<ul><!-- <li class="job"><h3>old</h3></li> --><li class="job big" data-id="', {_K}, '"><h3>', {_E}, '</h3><a href="/d/', {_K}, '">More</a><span class="due">2026-10-15</span><a href="https://apply.example.org/', {_K}, '">Apply</a></li>',
  '<li class="job"><h3>Viva schedule</h3></li><li><h3>other</h3></li></ul>') AS html FROM {{v_jobs0}}"""


@register("extract_list_items", f"""SELECT url AS page_url, 0 AS pos, title, concat('https://apply.example.org/', job_id) AS link, concat('https://site', job_id, '.example.com/d/', job_id) AS detail_link, '2026-10-15' AS deadline, job_id::varchar AS source_job_id FROM ({_LIST}) x
  UNION ALL SELECT url, 1, 'Viva schedule', NULL, NULL, NULL, NULL FROM ({_LIST}) y""")
def _(t):
    items = Mk.extract_list_items(sql(t, _LIST), "li.job", "h3", deadline=".due", id_attr="data-id")
    return items.select("page_url", "pos", "title", "link", "detail_link", "deadline", "source_job_id")


@register("list_items_to_postings", f"""SELECT job_id::varchar AS source_job_id, title, title || chr(10) || 'Deadline: 2026-10-15' AS description, TIMESTAMP '2026-10-15 17:59:59' AS deadline, concat('https://apply.example.org/', job_id) AS application_url,
  concat('https://site', job_id, '.example.com/d/', job_id) AS source_url FROM ({_LIST}) x""")
def _(t):
    items = Mk.extract_list_items(sql(t, _LIST), "li.job", "h3", deadline=".due", id_attr="data-id")
    return Mk.list_items_to_postings(items).select("source_job_id", "title", "description", "deadline", "application_url", "source_url")


# The pages' links are all paths of the host, with no markup in them.
@register("select_detail_links", """WITH a AS (SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a[^>]* href="([^"]*)"', 1) AS hs FROM pages),
  l AS (SELECT url, concat(lower(origin), h) AS link, min(i) AS pos FROM (SELECT url, origin, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM a) q WHERE h NOT IN ('', '#') GROUP BY 1, 2)
  SELECT url AS page_url, rank::int AS rank, link FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rank FROM l) z WHERE rank <= 20""")
def _(t):
    return Mk.select_detail_links(t.pages)


_FEED = f"""SELECT job_id, title, concat('https://feed', {_K}, '.example.com/rss') AS url, concat('<rss><channel><title>Feed</title><item><title>', {_E}, ' — Org ', {_K}, '</title><link>https://feed.example.com/', {_K}, '</link><guid isPermaLink="false">g', {_K}, '</guid>',
  '<description><![CDATA[<p>Body ', {_K}, '</p>]]></description><pubDate>Mon, 05 Oct 2026 10:00:00 GMT</pubDate><category>IT</category><category>Bank</category></item><item><title>Exam result of ', {_K}, '</title></item><item><title> </title></item></channel></rss>',
  '<feed><entry><title>Java Developer at Atom ', {_K}, '</title><link rel="self" href="/self"/><link rel="alternate" href="/alt/', {_K}, '"/><id>a', {_K}, '</id><summary>Sum</summary><updated>2026-10-01</updated><category term="Dev"/></entry></feed>') AS xml FROM {{v_jobs0}}"""


@register("parse_feed", f"""SELECT url AS feed_url, concat(title, ' — Org ', job_id) AS title, concat('https://feed.example.com/', job_id) AS link, concat('g', job_id) AS guid, concat('<p>Body ', job_id, '</p>') AS description, 'Mon, 05 Oct 2026 10:00:00 GMT' AS published, 'IT,Bank' AS categories FROM ({_FEED}) x
  UNION ALL SELECT url, concat('Exam result of ', job_id), NULL, NULL, '', NULL, '' FROM ({_FEED}) y
  UNION ALL SELECT url, concat('Java Developer at Atom ', job_id), concat('https://feed', job_id, '.example.com/alt/', job_id), concat('a', job_id), 'Sum', '2026-10-01', 'Dev' FROM ({_FEED}) z""")
def _(t):
    return Fe.parse_feed(sql(t, _FEED)).withColumn("categories", F.array_join("categories", ","))


@register("feed_to_postings", f"""SELECT concat('g', job_id) AS source_job_id, array_to_string(list_slice(p, 1, len(p) - 1), ' - ') AS title, concat('Org ', job_id) AS organization_name, 'IT' AS department, TIMESTAMP '2026-10-05 17:59:59' AS published_at, concat('https://feed.example.com/', job_id) AS application_url
    FROM (SELECT *, regexp_split_to_array(concat(title, ' — Org ', job_id), '\\s+[-–—|]\\s+') AS p FROM ({_FEED}) x) q
  UNION ALL SELECT concat('a', job_id), 'Java Developer', concat('Atom ', job_id), 'Dev', TIMESTAMP '2026-10-01 17:59:59', concat('https://feed', job_id, '.example.com/alt/', job_id) FROM ({_FEED}) y""")
def _(t):
    return Fe.feed_to_postings(Fe.parse_feed(sql(t, _FEED))).select("source_job_id", "title", "organization_name", "department", "published_at", "application_url")


@register("title_filter", "SELECT job_id FROM {v_jobs0} WHERE regexp_matches(title, '(?i)(officer|engineer)\\b.*support')")
def _(t):
    return Fe.title_filter(t.v_jobs0, r"(officer|engineer)\b.*support").select("job_id")


_LD = f"""SELECT job_id, title, {_URL} AS url, concat('<head><script type="application/ld+json">{{{{bad json</script><script type="application/ld+json">{{{{"@context":"https://schema.org","@graph":[{{{{"@type":"Organization","name":"Org"}}}},{{{{"@type":["JobPosting"],"title":" ', title, ' ","description":"<p>Needs Java</p>",',
  '"identifier":{{{{"@type":"PropertyValue","value":"id', {_K}, '"}}}},"hiringOrganization":{{{{"name":"Org ', {_K}, '"}}}},"jobLocation":[{{{{"address":{{{{"addressLocality":"Dhaka","addressRegion":"BD"}}}}}}}},{{{{"address":{{{{"addressLocality":"Sylhet"}}}}}}}}],"jobLocationType":"TELECOMMUTE","employmentType":"CONTRACTOR",',
  '"baseSalary":{{{{"currency":"BDT","value":{{{{"minValue":50000,"maxValue":70000,"unitText":"MONTH"}}}}}}}},"experienceRequirements":{{{{"monthsOfExperience":', cast(job_id % 60 as $STR$), '}}}},"totalJobOpenings":3,"validThrough":"2026-10-15","datePosted":"2026-09-01","url":"/apply/', {_K}, '"}}}}]}}}}</script></head>') AS html FROM {{v_jobs0}}"""
# Spark's own parameter syntax also uses braces, so literal ones are written as chr(123) and chr(125).
_LD = _LD.replace("{{", "{").replace("}}", "}").replace("{v_jobs0}", "@@").replace("{", "', chr(123), '").replace("}", "', chr(125), '").replace("@@", "{v_jobs0}")


@register("extract_jsonld_postings", f"SELECT url AS page_url, concat(' ', title, ' ') AS title FROM ({_LD}) x")
def _(t):
    return Fe.extract_jsonld_postings(sql(t, _LD)).select("page_url", F.try_variant_get("posting", "$.title", "string").alias("title"))


@register("jsonld_to_postings", f"""SELECT concat('id', job_id) AS source_job_id, title, concat('Org ', job_id) AS organization_name, 'Needs Java' AS description, 'Dhaka, BD / Sylhet' AS location, 'REMOTE' AS work_mode, 'CONTRACT' AS employment_type, 'BDT 50,000–70,000 per month' AS salary, 3 AS vacancies,
  TIMESTAMP '2026-09-01 17:59:59' AS published_at, TIMESTAMP '2026-10-15 17:59:59' AS deadline, concat('https://site', job_id, '.example.com/apply/', job_id) AS application_url, floor((job_id % 60) / 12.0::double * 10 + 0.5) / 10 AS hint_min_experience_years FROM ({_LD}) x""")
def _(t):
    return Fe.jsonld_to_postings(Fe.extract_jsonld_postings(sql(t, _LD))).select(
        "source_job_id", "title", "organization_name", "description", "location", "work_mode", "employment_type", "salary", "vacancies", "published_at", "deadline", "application_url", "hint_min_experience_years")


_POLICY = """CASE WHEN status BETWEEN 200 AND 299 THEN CASE WHEN contains(content_type, 'html') AND regexp_matches(lower(body[:500]), '<html|<!doctype') THEN 'allow all' ELSE 'parse' END WHEN status IN (401, 403) OR status >= 500 THEN 'disallow all' ELSE 'allow all' END"""


@register("robots_policy", f"SELECT host, {_POLICY} AS policy FROM {{v_robots}}")
def _(t):
    return Rg.robots_policy(t.v_robots).select("host", "policy")


_RULES = """ln AS (SELECT host, i, trim(regexp_replace(l, '#.*', '')) AS l FROM (SELECT host, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM {v_robots}) q),
  fv AS (SELECT host, i, lower(trim(split_part(l, ':', 1))) AS f, trim(substr(l, strpos(l, ':') + 1)) AS v FROM ln WHERE contains(l, ':')),
  gr AS (SELECT *, sum(CASE WHEN f = 'user-agent' AND coalesce(pf, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY i) AS grp FROM (SELECT *, lag(f) OVER (PARTITION BY host ORDER BY i) AS pf FROM fv) q),
  ag AS (SELECT host, grp, lower(v) AS agent FROM gr WHERE f = 'user-agent'), ru AS (SELECT host, grp, f = 'allow' AS allow, v AS pattern FROM gr WHERE f = 'allow' OR (f = 'disallow' AND v <> '')),
  dl AS (SELECT host, grp, arg_max(try_cast(v as double), i) AS crawl_delay FROM gr WHERE f = 'crawl-delay' AND try_cast(v as double) IS NOT NULL AND grp > 0 GROUP BY 1, 2),
  rules AS (SELECT ag.host, ag.grp, agent, allow, pattern, crawl_delay FROM ag LEFT JOIN ru ON ru.host = ag.host AND ru.grp = ag.grp LEFT JOIN dl ON dl.host = ag.host AND dl.grp = ag.grp)"""


@register("robots_rules", f"WITH {_RULES} SELECT host, grp::bigint AS grp, agent, allow, pattern, crawl_delay FROM rules")
def _(t):
    return Rg.robots_rules(t.v_robots).select("host", c("grp").cast("bigint").alias("grp"), "agent", "allow", "pattern", "crawl_delay")


@register("robots_filter", f"""WITH {_RULES}, po AS (SELECT host, {_POLICY} AS policy FROM {{v_robots}}), sp AS (SELECT host, bool_or(agent <> '*' AND contains('loombot', agent)) AS own FROM rules GROUP BY 1),
  ch AS (SELECT r.* FROM rules r JOIN sp USING (host) WHERE CASE WHEN own THEN agent <> '*' AND contains('loombot', agent) ELSE agent = '*' END),
  hi AS (SELECT f.host, f.path, arg_max(allow, length(pattern) * 2 + allow::int) AS allow FROM {{v_frontier}} f JOIN ch ON ch.host = f.host AND pattern IS NOT NULL AND
    regexp_matches(path, '^' || replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([.+?^$(){{0}}|])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END) GROUP BY 1, 2),
  de AS (SELECT host, arg_min(crawl_delay, grp) AS crawl_delay FROM ch WHERE crawl_delay IS NOT NULL GROUP BY 1)
  SELECT f.host, f.path, CASE policy WHEN 'allow all' THEN true WHEN 'parse' THEN coalesce(allow, true) ELSE false END AS allowed, CASE WHEN policy = 'parse' THEN crawl_delay END AS crawl_delay
  FROM {{v_frontier}} f LEFT JOIN po ON po.host = f.host LEFT JOIN hi ON hi.host = f.host AND hi.path = f.path LEFT JOIN de ON de.host = f.host""".replace("{0}", ""))
def _(t):
    return Rg.robots_filter(t.v_frontier, Rg.robots_rules(t.v_robots), Rg.robots_policy(t.v_robots), "LoomBot")


@register("due_sources", "SELECT source_key FROM {v_sources} WHERE method <> 'MANUAL' AND enabled AND (last_run_at IS NULL OR last_run_at + INTERVAL '1' MINUTE * fetch_interval_minutes <= $NOW$ + INTERVAL 30 SECOND)")
def _(t):
    return Rg.due_sources(t.v_sources, NOW).select("source_key")


@register("due_sources_forced", "SELECT source_key FROM {v_sources} WHERE method <> 'MANUAL' AND source_key IN ('src-1', 'src-2', 'src-6', 'src-7')")
def _(t):
    return Rg.due_sources(t.v_sources, NOW, keys=["src-1", "src-2", "src-6", "src-7"]).select("source_key")


_RAW = """SELECT job_id AS posting_id, CASE WHEN job_id % 11 = 3 THEN ' x ' WHEN job_id % 11 = 4 THEN repeat(title, 20) ELSE title END AS title, CASE WHEN job_id % 7 = 2 THEN 'ftp' WHEN job_id % 7 = 3 THEN NULL ELSE source_url END AS source_url,
  CASE WHEN job_id % 13 = 5 THEN 'careers page' ELSE application_url END AS application_url, CASE WHEN job_id % 9 = 1 THEN 'SOMETIMES' ELSE employment_type END AS employment_type, work_mode, vacancies, repeat(department, cast(1 + job_id % 40 as int)) AS department FROM {v_jobs0}"""


@register("validate_postings", f"""SELECT posting_id, CASE WHEN length(trim(title)) < 3 OR length(trim(title)) > 250 THEN 'title' WHEN length(trim(department)) > 200 THEN 'department' WHEN employment_type NOT IN {Q.strings(R.EMPLOYMENT_TYPES)} THEN 'employment_type'
   WHEN vacancies <= 0 OR vacancies > 10000 THEN 'vacancies' WHEN application_url = 'careers page' THEN 'application_url' WHEN source_url IS NULL OR source_url = 'ftp' THEN 'source_url' ELSE 'ok' END AS result FROM ({_RAW}) x""")
def _(t):
    ok, bad = Rg.validate_postings(sql(t, _RAW))
    return ok.select("posting_id", F.lit("ok").alias("result")).unionByName(bad.select("posting_id", c("failed_rule").alias("result")))


@register("upsert_sources", """WITH r AS (SELECT concat('src-', source_id + 5) AS source_key, concat('New ', name) AS name, url, 'RSS' AS method, org_id FROM {v_sources})
  SELECT coalesce(s.source_key, r.source_key) AS source_key, CASE WHEN r.source_key IS NOT NULL THEN r.name ELSE s.name END AS name, CASE WHEN r.source_key IS NOT NULL THEN 'RSS' ELSE s.method END AS method, CASE WHEN s.source_key IS NOT NULL THEN s.enabled ELSE true END AS enabled,
    CASE WHEN s.source_key IS NOT NULL THEN s.fetch_interval_minutes ELSE 90 END AS fetch_interval_minutes, CASE WHEN s.source_key IS NOT NULL THEN s.consecutive_failures ELSE 0 END AS consecutive_failures, s.last_run_at FROM {v_sources} s FULL JOIN r ON r.source_key = s.source_key""")
def _(t):
    reg = t.v_sources.select(F.concat(F.lit("src-"), (c("source_id") + 5).cast("string")).alias("source_key"), F.concat(F.lit("New "), "name").alias("name"), "url", F.lit("RSS").alias("method"), "org_id",
                             F.lit(True).alias("enabled_by_default"), F.lit(90).alias("default_interval"))
    return Rg.upsert_sources(t.v_sources, reg).select("source_key", "name", "method", "enabled", "fetch_interval_minutes", "consecutive_failures", "last_run_at")


@register("upsert_matches", "SELECT user_id, job_id, verdict, score FROM {v_matches} WHERE score < 50 UNION ALL SELECT user_id, job_id, 'WEAK', score + 1 FROM {v_matches} WHERE score >= 50")
def _(t):
    cur = t.v_matches.select("user_id", "job_id", "verdict", "score")
    new = cur.where(c("score") >= 50).select("user_id", "job_id", F.lit("WEAK").alias("verdict"), (c("score") + 1).alias("score"))
    return Tb.upserted(cur, new, ["user_id", "job_id"])


@register("export_sitemap", f"""SELECT 'https://x.example' || p AS url, NULL::timestamp AS last_modified, 'hourly' AS freq, CASE WHEN p = '/' THEN 1.0 ELSE 0.7 END::double AS priority FROM (SELECT unnest({Q.listed(R.STATIC_PATHS)}) AS p) s
  UNION ALL SELECT 'https://x.example/organizations/' || slug, updated_at, 'daily', 0.5 FROM {{v_orgs}}
  UNION ALL (SELECT 'https://x.example/jobs/' || slug, updated_at, 'daily', 0.8 FROM {{v_jobs}} WHERE {ACTIVE} AND NOT is_demo ORDER BY updated_at DESC, job_id DESC LIMIT 5000)""")
def _(t):
    return Rg.export_sitemap(t.v_jobs, t.v_orgs, "https://x.example")


def _member(key: str, value: str) -> str:
    """A member of a JSON object as text, null where the value is."""
    return f"""'"{key}":' || {value}"""


def _object(*members: str) -> str:
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


_RECORD = _object(
    _member("@context", "'\"https://schema.org\"'"), _member("@type", "'\"JobPosting\"'"), _member("title", "to_json(title)"), _member("description", "to_json('<p>' || regexp_replace(summary, '[<>&]', '', 'g') || '</p>')"),
    _member("datePosted", f"to_json({Q.iso_utc('coalesce(published_at, first_discovered_at)')})"), _member("validThrough", f"to_json({Q.iso_utc('deadline')})"), _member("employmentType", "to_json(CASE employment_type WHEN 'CONTRACT' THEN 'CONTRACTOR' ELSE employment_type END)"),
    _member("hiringOrganization", _object(_member("@type", "'\"Organization\"'"), _member("name", "to_json(o.name)"), _member("sameAs", "to_json(o.website)"))),
    _member("jobLocation", _object(_member("@type", "'\"Place\"'"), _member("address", _object(_member("@type", "'\"PostalAddress\"'"), _member("addressLocality", "to_json(coalesce(location, 'Dhaka'))"), _member("addressCountry", "'\"BD\"'"))))),
    _member("jobLocationType", "CASE WHEN work_mode = 'REMOTE' THEN '\"TELECOMMUTE\"' END"), _member("applicantLocationRequirements", "CASE WHEN work_mode = 'REMOTE' THEN " + _object(_member("@type", "'\"Country\"'"), _member("name", "'\"Bangladesh\"'")) + " END"),
    _member("identifier", "CASE WHEN source_job_id <> '' THEN " + _object(_member("@type", "'\"PropertyValue\"'"), _member("name", "to_json(o.name)"), _member("value", "to_json(source_job_id)")) + " END"),
    _member("experienceRequirements", "CASE WHEN min_experience_years IS NOT NULL THEN " + _object(_member("@type", "'\"OccupationalExperienceRequirements\"'"), _member("monthsOfExperience", "floor(min_experience_years * 12 + 0.5)::bigint::varchar")) + " END"),
    _member("skills", "to_json(nullif(array_to_string(required_skills, ', '), ''))"), _member("totalJobOpenings", "CASE WHEN vacancies <> 0 THEN vacancies::varchar END"), _member("directApply", "'false'"), _member("url", "to_json('https://x.example/jobs/' || j.slug)"))
_RECORD = _RECORD.replace("'{'", "chr(123)").replace("'}'", "chr(125)")


@register("export_job_posting_jsonld", f"""SELECT j.slug, replace({_RECORD}, '<', '\\u003c') AS json FROM {{v_jobs}} j JOIN {{v_orgs}} o USING (org_id)
  WHERE NOT is_demo AND archived_at IS NULL AND review_status = 'APPROVED' AND j.status <> 'REMOVED' AND (deadline IS NULL OR deadline >= $NOW$ - INTERVAL '1' DAY * {R.NOINDEX_AFTER_DAYS})""")
def _(t):
    return Rg.export_job_posting_jsonld(t.v_jobs, t.v_orgs, "https://x.example", NOW)
