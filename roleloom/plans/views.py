"""Job-board tables derived from the driver's star schema.

Each view is one SELECT that Spark and DuckDB read alike; the few dialect
differences are ``$TOKENS$``.  ``{name}`` refers to a base table or to another
view.  Everything is a function of keys and columns, so the views grow with the
tables and hit every branch of the operators.  One organisation (key 0) holds a
third of all jobs on purpose: it is the hot key the operators must survive.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from ..sources.tables import scan, spread

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NOW = "1998-06-01 00:00:00"
EVENTS_NOW = "2024-01-15 00:00:00"

_TOKENS = {
    "spark": {"NOW": f"TIMESTAMP_NTZ '{NOW}'", "EVENTS_NOW": f"TIMESTAMP_NTZ '{EVENTS_NOW}'",
              "EMPTY": "cast(array() as array<string>)", "TS": "TIMESTAMP_NTZ", "TSN": "timestamp_ntz", "STR": "string"},
    "duckdb": {"NOW": f"TIMESTAMP '{NOW}'", "EVENTS_NOW": f"TIMESTAMP '{EVENTS_NOW}'",
               "EMPTY": "cast([] as varchar[])", "TS": "TIMESTAMP", "TSN": "timestamp", "STR": "varchar"},
}


def pick(key: str, *words: str) -> str:
    """The (key mod n)-th word."""
    return f"split_part('{'|'.join(words)}', '|', cast(({key}) % {len(words)} + 1 as int))"


def pick_list(key: str, *lists: str) -> str:
    """The (key mod n)-th comma list as an array; an empty word gives an empty array."""
    word = pick(key, *lists)
    return f"CASE WHEN {word} = '' THEN $EMPTY$ ELSE split({word}, ',') END"


def div(key: str, n: int) -> str:
    return f"cast(floor({key} / {n}) as bigint)"


def hrs(n: str) -> str:
    return f"INTERVAL '1' HOUR * ({n})"


ROLES = ["Software Engineer", "Network Engineer", "Officer - IT", "Database Administrator", "Information Security Analyst",
         "Data Analyst", "QA Engineer", "System Administrator", "DevOps Engineer", "Java Developer", "Digital Banking Officer",
         "Card Operations Officer", "IT Audit Officer", "MIS Reporting Officer", "Application Support Engineer",
         "Management Trainee Officer - IT", "Full Stack Developer", "Business Analyst", "Cloud Engineer"]
SKILL_LISTS = ["", "Java,Spring Boot,Oracle", "Cisco,CCNA", "Python,SQL,Power BI", "Linux,Docker,Kubernetes,AWS",
               "C#,.NET,SQL Server", "SIEM,Firewall", "Selenium,JMeter", "React,TypeScript,Node.js"]

_STATUS_CASE = f"""CASE WHEN deadline <= $NOW$ THEN 'EXPIRED' WHEN missing_runs >= {R.REMOVED_AFTER_MISSES} THEN 'REMOVED'
  WHEN review_status = 'PENDING' THEN 'UNVERIFIED'
  WHEN deadline IS NULL AND last_verified_at < $NOW$ - INTERVAL '1' DAY * {R.UNVERIFIED_AFTER_DAYS} THEN 'UNVERIFIED'
  WHEN deadline <= $NOW$ + {hrs(str(R.CLOSING_SOON_HOURS))} THEN 'CLOSING_SOON'
  WHEN first_discovered_at >= $NOW$ - {hrs(str(R.NEW_WINDOW_HOURS))} THEN 'NEW' ELSE 'OPEN' END"""

VIEWS: dict[str, str] = {}

VIEWS["v_orgs"] = f"""
SELECT s_suppkey AS org_id, concat('org-', cast(s_suppkey as $STR$)) AS slug,
  concat({pick('s_suppkey', 'Meghna', 'Padma', 'Jamuna', 'Surma', 'Karnaphuli', 'Teesta', 'Rupsha')}, ' ',
         {pick('s_nationkey', 'Bank', 'Finance', 'Fintech', 'Payments')}, ' ', cast(s_suppkey as $STR$), ' PLC') AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat({pick('s_suppkey', 'MB', 'PB', 'JB')}, cast(s_suppkey as $STR$)) END AS short_name,
  {pick('s_nationkey', *R.ORG_TYPES)} AS type,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('https://org', cast(s_suppkey as $STR$), '.example.com') END AS website,
  $NOW$ - INTERVAL '1' DAY * (s_suppkey % 50) AS updated_at
FROM {{supplier}}"""

VIEWS["v_sources"] = f"""
SELECT s_suppkey AS source_id, concat('src-', cast(s_suppkey as $STR$)) AS source_key, concat('Portal ', cast(s_suppkey as $STR$)) AS name,
  concat('https://jobs', cast(s_suppkey as $STR$), '.example.com/list') AS url,
  {pick('s_suppkey', *R.METHODS)} AS method, s_nationkey % 7 <> 0 AS enabled, cast(60 * (1 + s_suppkey % 6) as int) AS fetch_interval_minutes,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_suppkey END AS org_id,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE $NOW$ - INTERVAL '1' MINUTE * (30 * (s_suppkey % 40)) END AS last_run_at,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE $NOW$ - INTERVAL '1' MINUTE * (45 * (s_suppkey % 60)) END AS last_success_at,
  cast(CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 5 ELSE 0 END as int) AS consecutive_failures
FROM {{supplier}}"""

VIEWS["v_jobs0"] = f"""
SELECT o_orderkey AS job_id, concat('job-', cast(o_orderkey as $STR$)) AS slug,
  concat({pick('o_orderkey', 'Senior ', 'Sr. ', 'Junior ', '', 'Assistant ', 'Lead ', 'Chief ')}, {pick(div('o_orderkey', 7), *ROLES)},
         {pick(div('o_orderkey', 29), '', '', ' (Core Banking)', ', Dhaka', ' & Support', ' II')}) AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % (SELECT count(*) FROM {{supplier}}) END AS org_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {pick('o_orderkey', 'IT', 'ICT Division', 'Digital Banking', 'Human Resources', 'Operations', 'Information Security')} END AS department,
  {pick(div('o_orderkey', 3), *R.CATEGORIES)} AS category,
  {pick_list('o_orderkey', '', 'NETWORK,DATABASE', 'SOFTWARE_DEVELOPMENT', 'QA_TESTING,DATA_BI,MIS_REPORTING', '')} AS secondary_categories,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {pick(div('o_orderkey', 6), *R.LEVELS)} END AS level,
  concat('Opening ', cast(o_orderkey as $STR$), ' in ', {pick('o_orderkey', 'payments', 'lending', 'cards', 'treasury')}, ' & <b>systems</b>.') AS summary,
  {pick_list(div('o_orderkey', 2), *SKILL_LISTS)} AS required_skills,
  {pick_list(div('o_orderkey', 5), '', 'Docker,Git', 'Tableau', '')} AS preferred_skills,
  {pick_list(div('o_orderkey', 4), '', 'CSE', 'CSE,EEE,RELATED', 'ANY', 'IT,ICT', 'STATISTICS,MATHEMATICS', 'ETE,ECE', 'CSE,RELATED')} AS education_disciplines,
  CASE cast(o_orderkey % 5 as int) WHEN 0 THEN NULL WHEN 1 THEN cast(2.5 as double) WHEN 2 THEN cast(3 as double) WHEN 3 THEN cast(3.25 as double) ELSE cast(2.75 as double) END AS min_cgpa,
  CASE WHEN o_orderkey % 4 = 1 THEN cast(3.5 as double) WHEN o_orderkey % 4 = 2 THEN cast(4 as double) ELSE NULL END AS min_ssc_gpa,
  CASE WHEN o_orderkey % 6 = 1 THEN cast(3.5 as double) WHEN o_orderkey % 6 = 2 THEN cast(4.5 as double) ELSE NULL END AS min_hsc_gpa,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_custkey % 5 = 0 ELSE false END AS masters_required,
  CASE WHEN o_orderkey % 4 = 0 THEN true ELSE NULL END AS no_third_division,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 9 as double) END AS min_experience_years,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 2 = 0 THEN NULL ELSE cast(o_orderkey % 9 + 2 as double) END AS max_experience_years,
  CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE cast(28 + o_orderkey % 13 as int) END AS age_limit,
  o_orderkey % 6 = 5 AS banking_experience_preferred, o_orderkey % 16 <> 15 AS requirements_parsed,
  CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE {pick('o_orderkey', 'Dhaka', 'Chattogram', 'Anywhere in Bangladesh', 'Sylhet, Dhaka', 'Khulna', 'Gazipur', 'Rajshahi')} END AS location,
  CASE WHEN o_orderkey % 10 = 9 THEN 'REMOTE' WHEN o_orderkey % 10 = 8 THEN 'HYBRID' ELSE 'ONSITE' END AS work_mode,
  {pick(div('o_orderkey', 11), *R.EMPLOYMENT_TYPES)} AS employment_type,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('BDT ', cast(30000 + o_orderkey % 70 * 1000 as $STR$)) ELSE NULL END AS salary,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE cast(o_orderkey % 6 as int) END AS vacancies,
  CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE $NOW$ - INTERVAL '1' DAY * (o_orderkey % 20) END AS published_at,
  CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE $NOW$ + {hrs('o_orderkey % 240 - 60')} END AS deadline,
  CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE concat('https://careers.example.com/apply/', cast(o_orderkey as $STR$)) END AS application_url,
  concat('Portal ', cast(o_custkey % (SELECT count(*) FROM {{supplier}}) as $STR$)) AS source_name,
  concat('https://jobs.example.com/view/', cast(o_orderkey as $STR$)) AS source_url,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('ref-', cast(o_orderkey as $STR$)) ELSE NULL END AS source_job_id,
  $NOW$ - {hrs('o_orderkey * 7 % 400')} AS first_discovered_at, $NOW$ - INTERVAL '1' DAY * (o_orderkey % 30) AS last_verified_at,
  cast(CASE WHEN o_orderkey % 12 = 11 THEN 3 + o_orderkey % 2 ELSE o_orderkey % 3 END as int) AS missing_runs,
  CASE WHEN o_orderkey % 17 = 16 THEN 'PENDING' WHEN o_orderkey % 17 = 15 THEN 'REJECTED' ELSE 'APPROVED' END AS review_status,
  CASE WHEN o_orderkey % 19 = 18 THEN $NOW$ - INTERVAL '1' DAY * 5 ELSE NULL END AS archived_at,
  o_orderkey % 23 = 22 AS is_demo, CASE WHEN o_orderkey % 17 = 16 THEN o_custkey ELSE NULL END AS submitted_by,
  $NOW$ - {hrs('o_orderkey * 7 % 4000')} AS created_at, $NOW$ - {hrs('o_orderkey * 5 % 2000')} AS updated_at
FROM {{orders}}"""

VIEWS["v_jobs"] = f"""
SELECT j.*, CASE WHEN job_id % 13 = 0 THEN 'OPEN' ELSE {_STATUS_CASE} END AS status FROM {{v_jobs0}} j"""

VIEWS["v_links"] = """
SELECT l_orderkey AS job_id, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS source_id,
  concat('src-', cast(l_suppkey as $STR$), ':id:', cast(l_orderkey as $STR$)) AS external_key,
  concat('https://jobs', cast(l_suppkey as $STR$), '.example.com/', cast(l_orderkey as $STR$)) AS source_url,
  min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at
FROM {lineitem} GROUP BY l_orderkey, l_suppkey"""

VIEWS["v_profiles"] = f"""
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE {pick('c_custkey', 'Computer Science and Engineering', 'B.Sc. in EEE', 'Information Technology', 'Statistics', 'Software Engineering', 'Accounting', 'BSc in CSE')} END AS discipline,
  c_custkey % 3 = 0 AS has_masters,
  CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE cast(2 + (c_custkey % 17) * 0.125 as double) END AS bachelor_cgpa,
  cast(CASE WHEN c_custkey % 6 = 5 THEN 5 ELSE 4 END as int) AS cgpa_scale,
  CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE cast(3 + (c_custkey % 5) * 0.5 as double) END AS ssc_gpa,
  CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE cast(3 + (c_custkey % 4) * 0.5 as double) END AS hsc_gpa,
  c_custkey % 13 = 12 AS has_third_division,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE cast((c_custkey % 25) * 0.5 as double) END AS experience_years,
  c_custkey % 4 = 0 AS banking_experience,
  {pick_list('c_custkey', 'java,oracle,sql', 'Cisco,Linux,Firewalls', '', 'python,power bi,excel', 'docker,k8s,aws', 'c#,.net,sql server,react')} AS skills,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'software' WHEN 'MACHINERY' THEN 'infrastructure' WHEN 'HOUSEHOLD' THEN 'security' WHEN 'AUTOMOBILE' THEN 'data' ELSE NULL END AS primary_focus,
  {pick_list(div('c_custkey', 2), 'Software Engineer,Java Developer', '', 'Network Engineer', 'Data Analyst,MIS Officer', 'Security Analyst', 'IT Officer')} AS preferred_roles,
  {pick_list('c_custkey', '', 'org-0,org-3', 'org-5', '')} AS preferred_org_slugs,
  {pick_list(div('c_custkey', 3), 'Dhaka', '', 'Chattogram,Sylhet', 'Khulna')} AS preferred_locations,
  c_custkey % 2 = 0 AS open_to_remote,
  CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE cast(22 + c_custkey % 19 as int) END AS age
FROM {{customer}}"""

# Every alert filter list is used.  Most users name two organisations, some of them the hot one; of 128 users, one each filters by types, levels or places alone, and one by nothing.
_KIND = "c_custkey % 128"
VIEWS["v_prefs"] = f"""
SELECT c_custkey AS user_id,
  CASE WHEN {_KIND} BETWEEN 40 AND 43 THEN $EMPTY$ WHEN c_acctbal >= 9900 THEN {pick_list('c_custkey', 'NETWORK', 'DATABASE', 'CYBERSECURITY,QA_TESTING')} ELSE {pick_list('c_custkey', '', 'SOFTWARE_DEVELOPMENT,NETWORK,DATABASE', '', 'DATA_BI,QA_TESTING', '')} END AS categories,
  CASE WHEN c_acctbal >= 9900 OR {_KIND} BETWEEN 40 AND 43 THEN $EMPTY$ WHEN c_custkey % 64 = 7 THEN split('org-0', ',')
    ELSE split(concat('org-', cast(1 + c_custkey % (SELECT count(*) - 1 FROM {{supplier}}) as $STR$), ',org-', cast(1 + (c_custkey * 7 + 3) % (SELECT count(*) - 1 FROM {{supplier}}) as $STR$)), ',') END AS organization_slugs,
  CASE WHEN {_KIND} = 40 THEN split('FINTECH,PRIVATE_BANK', ',') WHEN {_KIND} BETWEEN 41 AND 43 THEN $EMPTY$ ELSE {pick_list(div('c_custkey', 5), '', '', 'PUBLIC_BANK,PRIVATE_BANK,FINTECH', '')} END AS org_types,
  cast(CASE WHEN c_custkey % 3 = 0 THEN 45 ELSE c_custkey % 80 END as int) AS min_match_score,
  CASE WHEN {_KIND} = 42 THEN split('Dhaka', ',') WHEN {_KIND} BETWEEN 40 AND 43 THEN $EMPTY$ ELSE {pick_list(div('c_custkey', 2), '', 'Dhaka', 'Khulna,Sylhet')} END AS locations,
  CASE WHEN {_KIND} = 41 THEN split('SENIOR', ',') WHEN {_KIND} BETWEEN 40 AND 43 THEN $EMPTY$ ELSE {pick_list(div('c_custkey', 3), '', 'ENTRY,MID,SENIOR', '', 'LEAD,EXECUTIVE')} END AS levels,
  c_custkey % 2 = 1 AS academic_only, CASE WHEN c_custkey % 3 = 2 THEN 'DAILY_DIGEST' ELSE 'IMMEDIATE' END AS mode,
  c_custkey % 4 <> 3 AS email_enabled, c_custkey % 5 = 0 AS telegram_enabled,
  CASE WHEN c_custkey % 10 = 0 THEN concat('9', cast(c_custkey as $STR$)) ELSE NULL END AS telegram_chat_id,
  c_custkey % 6 = 0 AS push_enabled, c_custkey % 7 <> 6 AS deadline_reminders, c_custkey % 8 <> 7 AS closing_soon_alerts
FROM {{customer}} WHERE c_nationkey <> 24"""

# A user looks at a job when they order it or one of its lines carries their key.
VIEWS["v_views"] = """
SELECT user_id, job_id FROM (
  SELECT o_custkey AS user_id, o_orderkey AS job_id FROM {orders}
  UNION SELECT l_partkey AS user_id, l_orderkey AS job_id FROM {lineitem}) v"""

VIEWS["v_matches"] = f"""
SELECT o_custkey AS user_id, o_orderkey AS job_id, {pick(div('o_orderkey', 2), *R.VERDICTS)} AS verdict,
  cast((o_orderkey * 13 + o_custkey) % 101 as int) AS score, $NOW$ - {hrs('o_orderkey % 100')} AS computed_at
FROM {{orders}}"""

VIEWS["v_saved"] = """
SELECT user_id, job_id, min(created_at) AS created_at FROM (
  SELECT o_custkey AS user_id, o_orderkey AS job_id, o_orderdate AS created_at FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT l_partkey, l_orderkey, l_shipdate FROM {lineitem} WHERE l_returnflag = 'R') s
GROUP BY user_id, job_id"""

VIEWS["v_apps"] = f"""
SELECT o_custkey AS user_id, o_orderkey AS job_id, {pick(div('o_orderkey', 3), *R.APPLICATION_STATUSES)} AS status,
  o_orderdate AS updated_at FROM {{orders}} WHERE o_orderstatus <> 'F'"""

VIEWS["v_notifications"] = f"""
SELECT l.notification_id, l.user_id, l.job_id, {pick('l.job_id', 'NEW_JOB', 'HIGH_PRIORITY', 'JOB_UPDATED', 'DEADLINE_REMINDER', 'CLOSING_SOON')} AS type,
  concat('Alert ', cast(l.job_id as $STR$)) AS title, concat('Body <', cast(l.job_id as $STR$), '>') AS body, concat('/jobs/job-', cast(l.job_id as $STR$)) AS url,
  l.job_id % 4 = 0 AS priority, concat('new:', cast(l.user_id as $STR$), ':', cast(l.job_id as $STR$)) AS dedupe_key,
  l.job_id % 3 = 0 AS digest_pending, CASE WHEN l.job_id % 5 < 2 THEN l.created_at + INTERVAL '1' DAY ELSE NULL END AS read_at, l.created_at
FROM (SELECT o_orderkey AS notification_id, o_custkey AS user_id, o_orderkey AS job_id, o_orderdate + {hrs('o_orderkey % 24')} AS created_at FROM {{orders}}) l"""

VIEWS["v_deliveries"] = f"""
SELECT l_orderkey AS notification_id, {pick('l_linenumber', 'IN_APP', 'EMAIL', 'TELEGRAM', 'PUSH')} AS channel,
  {pick('l_partkey', 'SENT', 'LOGGED', 'SKIPPED', 'FAILED')} AS status, max(l_shipdate) AS created_at
FROM {{lineitem}} GROUP BY 1, 2, 3"""

VIEWS["v_runs"] = f"""
SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % (SELECT count(*) FROM {{supplier}}) END AS source_id, ts AS started_at,
  CASE event_type WHEN 'signup' THEN 'SUCCESS' WHEN 'view' THEN 'PARTIAL' WHEN 'click' THEN 'SUCCESS' WHEN 'purchase' THEN 'SKIPPED' ELSE 'FAILED' END AS status,
  cast(floor(value) as int) AS items_found, cast(CASE WHEN event_type = 'view' THEN 1 + event_id % 4 ELSE 0 END as int) AS parse_errors
FROM {{events}}"""

VIEWS["v_reports"] = f"""
SELECT o_orderkey AS report_id, o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS user_id,
  {pick('o_orderkey', 'expired', 'wrong-information', 'duplicate', 'broken-link', 'not-it-role', 'other')} AS reason,
  {pick(div('o_orderkey', 2), *R.REPORT_STATUSES)} AS status, o_orderdate AS created_at
FROM {{orders}} WHERE o_orderpriority = '5-LOW'"""

VIEWS["v_audit"] = f"""
SELECT event_id AS audit_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS actor_id,
  {pick('event_id', 'job.edited', 'job.approved', 'source.enabled', 'duplicate.merge')} AS action, ts AS created_at FROM {{events}}"""

VIEWS["v_duplicates"] = f"""
SELECT DISTINCT l_orderkey AS job_id, l_partkey AS candidate_job_id, cast(0.75 + (l_partkey % 25) * 0.01 as double) AS score,
  {pick('l_linenumber', 'PENDING', 'MERGED', 'DISMISSED')} AS status FROM {{lineitem}} WHERE l_orderkey <> l_partkey"""

# Incoming postings: one per order, most of them perturbed copies of a stored job.
VIEWS["v_postings0"] = f"""
SELECT j.job_id AS posting_id, j.job_id % 8 AS kind,
  CASE WHEN j.job_id % 8 = 0 THEN concat('src-', cast(j.job_id % 10 as $STR$)) ELSE concat('feed-', cast(j.job_id % 10 as $STR$)) END AS source_key,
  j.org_id, concat('org-', cast(j.org_id as $STR$)) AS org_slug,
  CASE j.job_id % 8 WHEN 2 THEN replace(replace(j.title, 'Senior', 'Sr.'), ' & ', ' and ')
       WHEN 4 THEN concat('Urgent hiring: ', j.title, ' Team') WHEN 5 THEN concat(j.title, ' III')
       WHEN 7 THEN concat('Regional ', {pick(div('j.job_id', 3), 'Branch', 'Treasury', 'Audit', 'Trade')}, ' Coordinator ', cast(j.job_id % 50 as $STR$)) ELSE j.title END AS title,
  j.department, j.summary,
  CASE WHEN j.job_id % 8 IN (1, 6) THEN NULL WHEN j.job_id % 8 = 4 THEN j.deadline + INTERVAL '2' DAY WHEN j.job_id % 8 = 5 THEN j.deadline + INTERVAL '10' DAY ELSE j.deadline END AS deadline,
  CASE WHEN j.job_id % 8 = 1 THEN concat('http://www.careers.example.com/apply/', cast(j.job_id as $STR$), '/?utm_source=feed&ref=x#top')
       WHEN j.job_id % 8 IN (2, 4, 5, 6, 7) THEN concat('https://feed.example.org/p?id=', cast(j.job_id as $STR$)) ELSE NULL END AS application_url,
  concat('https://feed.example.org/view?id=', cast(j.job_id as $STR$), '&utm_medium=rss') AS source_url,
  CASE WHEN j.job_id % 8 = 0 THEN cast(j.job_id as $STR$) ELSE NULL END AS source_job_id,
  CASE WHEN j.job_id % 8 = 3 THEN 'ours' ELSE 'theirs' END AS copy_hash
FROM {{v_jobs0}} j"""

# Circular text: a sentence for each requirement, or none, from these lists; every branch of the rules is met.
_POINTS = ("2.40", "2.85", "3.15", "3.65")
_SPANS = ((1, 4), (4, 9), (6, 11))
_DEGREES = [*[f"{d} graduates only. " for d in ("BSc in Statistics or Mathematics", "Degree in ETE, ECE", "Bachelor of Software Engineering, ICT")], "", "A degree in Physics or a relevant field. ", "Degree: any discipline. ", "A bachelor degree in EEE with an MBA on top. "]
_RESULTS = [*[f"Minimum CGPA {p}. " for p in _POINTS], "", f"Result of {_POINTS[1]}/4.00 in the last degree. ", "HSC with GPA 4.75 out of 5.00. "]
_SCHOOL = ["GPA 3.25 in SSC. ", "", "GPA 4.25 out of 5 in HSC. ", "SSC and HSC GPA 2.75 each. "]
_MASTERS = ["Masters is a must. ", "Masters is not compulsory. ", "", "Masters desirable. "]
_CLASSES = ["A third class is not allowed. ", "", "Third division results will not be considered. ", "No third class. "]
_YEARS = [*[f"{a} to {b} years of experience. " for a, b in _SPANS], "Fresh graduates are welcome. ", "", "Minimum six years of experience in operations. ", "At least 12+ years of experience. ", "Freshers are eligible, or 1-3 years of work. "]
_AGES = [*[f"Age limit: {a} years. " for a in (27, 33, 45)], "", "Age within 38 years. "]
_TOOLS = ["PHP, Laravel and MySQL. Git is a plus. ", "Linux, VMware and CCNP. Azure preferred. ", "ETL with Oracle, Tableau for charts. ", "", "Kafka and MongoDB. Docker would be an advantage. ", "CISSP, SIEM, firewall. ", "Flutter, Android. React is desirable. "]
_LENDERS = ["Banking experience desirable. ", "", "Experience in a financial institution is desirable. "]
_SEATS = ["Vacancy: 3. ", "", "Number of vacancies: 17. "]
_PAY = ["Salary: BDT 42000 to 61000. ", "", "Salary: as per scale. "]
_PLACES = ["Job location: Khulna and Barishal. ", "Anywhere in Bangladesh. ", "", "Office in Rajshahi. "]
_DESKS = ["Hybrid weeks. ", "", "Work from home. ", "On-site only. "]
_CLOSING = ["Application deadline: 28 November 2026", "Last date of submission: 09/08/2026", "", "Apply by 2027-01-19", "Deadline: 30 February 2027"]
VIEWS["v_circulars"] = f"""
SELECT o_orderkey AS posting_id,
  concat({pick('o_orderkey', 'Senior ', 'Sr. ', 'Contractual ', '', 'Intern ', 'Head of ', 'AVP - ')}, {pick(div('o_orderkey', 7), *ROLES, 'Civil Engineer', 'Branch Manager', 'Probationary Officer', 'Cash Officer')}) AS title,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {pick(div('o_orderkey', 3), 'IT', 'Human Resources', 'Digital Banking', 'Operations')} END AS department,
  concat(
    {pick('o_orderkey', *_DEGREES)}, {pick(div('o_orderkey', 2), *_RESULTS)}, {pick(div('o_orderkey', 3), *_SCHOOL)}, {pick(div('o_orderkey', 5), *_MASTERS)}, {pick(div('o_orderkey', 4), *_CLASSES)},
    {pick(div('o_orderkey', 7), *_YEARS)}, {pick(div('o_orderkey', 6), *_AGES)}, {pick(div('o_orderkey', 8), *_TOOLS)}, {pick(div('o_orderkey', 9), *_LENDERS)}, {pick(div('o_orderkey', 10), *_SEATS)},
    {pick(div('o_orderkey', 11), *_PAY)}, {pick(div('o_orderkey', 12), *_PLACES)}, {pick(div('o_orderkey', 13), *_DESKS)}, {pick(div('o_orderkey', 14), *_CLOSING)}) AS description
FROM {{orders}}"""

# Robots text per organisation host, with fetch outcomes.
VIEWS["v_robots"] = f"""
SELECT concat('jobs', cast(s_suppkey as $STR$), '.example.com') AS host,
  cast(CASE s_suppkey % 9 WHEN 6 THEN 404 WHEN 7 THEN 403 WHEN 8 THEN 503 ELSE 200 END as int) AS status,
  CASE WHEN s_suppkey % 9 = 5 THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE WHEN s_suppkey % 9 = 5 THEN '<!doctype html><html></html>' ELSE concat(
    'User-agent: *', chr(10), 'Disallow: /admin', chr(10), 'Allow: /admin/jobs', chr(10), 'Disallow: /*.pdf$', chr(10),
    {pick('s_suppkey', 'Crawl-delay: 5', 'Disallow: ', 'Disallow: /', '# nothing', 'Disallow: /view?id=*9$')}, chr(10), chr(10),
    {pick(div('s_suppkey', 2), 'User-agent: loombot', 'User-agent: otherbot', 'User-agent: otherbot')}, chr(10), 'User-agent: third', chr(10), 'Disallow: /list # all lists', chr(10), 'Allow: /list', chr(10), 'Crawl-delay: 9') END AS body
FROM {{supplier}}"""

VIEWS["v_frontier"] = """
SELECT DISTINCT concat('jobs', cast(l_suppkey as $STR$), '.example.com') AS host,
  concat(split_part('/view?id=|/admin/|/admin/jobs/|/list/|/files/a.pdf|/list?x=', '|', cast(l_linenumber % 6 + 1 as int)), CASE WHEN l_linenumber % 6 = 4 THEN '' ELSE cast(l_partkey % 100 as $STR$) END) AS path
FROM {lineitem}"""

VIEWS["v_toggles"] = """
SELECT event_id, user_id, cast(floor(value) as bigint) AS job_id, ts FROM {events} WHERE event_type = 'click'"""

VIEWS["v_app_events"] = f"""
SELECT event_id, user_id, cast(floor(value) as bigint) AS job_id, ts, {pick('event_id', *R.APPLICATION_STATUSES)} AS status FROM {{events}} WHERE event_type = 'purchase'"""

VIEWS["v_hits"] = """
SELECT event_id, concat('report:', cast(user_id as $STR$)) AS key, ts FROM {events} WHERE event_type = 'view'"""


def _deps(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w+)\}", VIEWS[name])))


def _fill(text: str, dialect: str) -> str:
    for token, value in _TOKENS[dialect].items():
        text = text.replace(f"${token}$", value)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: str | None = None) -> DataFrame:
    """A base table or a derived view as a lazy DataFrame; the rows of the base table ``dealt`` are spread before anything is made of them."""
    if name not in VIEWS:
        df = table(spark, sf_dir, name)
        return spread(df) if name == dealt else df
    inputs = {d: view(spark, sf_dir, d, dealt) for d in _deps(name)}
    return spark.sql(_fill(VIEWS[name], "spark"), **inputs)


@lru_cache(None)
def _closure(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for d in _deps(name):
        if d in VIEWS:
            out += [x for x in _closure(d) if x not in out]
    return tuple(dict.fromkeys(out + [name]))


def oracle(body: str, recursive: bool = False) -> str:
    """Prefix a DuckDB query with the view definitions it mentions as ``{name}``; ``$NOW$`` and friends are filled in."""
    ctes: list[str] = []
    for name in dict.fromkeys(re.findall(r"\{([a-z]\w+)\}", body)):
        if name in VIEWS:
            ctes += [v for v in _closure(name) if v not in ctes]
    texts = [f"{v} AS ({re.sub(r'\{([a-z]\w+)\}', r'\1', _fill(VIEWS[v], 'duckdb')).strip()})" for v in ctes]
    body = re.sub(r"\{([a-z]\w+)\}", r"\1", _fill(body, "duckdb")).strip()
    if body[:4].upper() == "WITH":
        body = body[4:].lstrip()
        if body[:9].upper() == "RECURSIVE":
            body, recursive = body[9:].lstrip(), True
        texts.append("")
        joined = ",\n".join(texts[:-1] + [body])
    else:
        joined = ",\n".join(texts) + ("\n" if texts else "") + body
        if not texts:
            return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + joined
