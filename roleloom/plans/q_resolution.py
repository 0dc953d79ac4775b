"""Entity resolution queries."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import resolve as X
from . import sqltext as Q
from .q_enrich import tech_sql
from .q_lifecycle import status_sql
from ..sources.tables import materialised
from .core import register
from .views import NOW

c = F.col

_STORED = """SELECT j.*, concat('org-', cast(org_id as $STR$)) AS org_slug, CASE WHEN job_id % 8 = 3 THEN concat('stale-', cast(job_id as $STR$)) END AS stale,
  CASE WHEN job_id % 3 = 1 THEN required_skills ELSE $EMPTY$ END AS responsibilities, CASE WHEN job_id % 4 = 1 THEN concat('note ', cast(job_id as $STR$)) END AS discipline_note, CASE WHEN job_id % 5 = 1 THEN 'both' END AS ssc_hsc_requirement FROM {v_jobs} j"""
NT, NU = Q.normalize_title("title"), Q.normalize_url("application_url")
_FP = Q.fingerprint("org_slug", "normalized_title", "deadline")
_CH = Q.content_hash("org_slug", "title", "department", "summary", Q.iso_utc("deadline"))
_CTE = f"""WITH st AS (SELECT *, coalesce(stale, {_FP}) AS fingerprint, {_CH} AS content_hash FROM (SELECT *, {NT} AS normalized_title, {NU} AS norm_url FROM ({_STORED}) a) b),
  ic AS (SELECT *, {_FP} AS fingerprint, {_CH} AS content_hash, CASE WHEN source_job_id IS NOT NULL THEN concat(source_key, ':id:', source_job_id)
     ELSE concat(source_key, ':u:', substr(sha256(concat(coalesce(norm_url, {Q.normalize_url('source_url')}, source_url), '|', normalized_title)), 1, 32)) END AS external_key
     FROM (SELECT *, {NT} AS normalized_title, {NU} AS norm_url FROM {{v_postings0}}) a),
  live AS (SELECT * FROM st WHERE archived_at IS NULL), recent AS (SELECT * FROM live WHERE created_at >= $NOW$ - INTERVAL 120 DAY),
  lk AS (SELECT l.* FROM {{v_links}} l JOIN live USING (job_id)), """


def _once(t, name, build):
    """Intermediate tables of one query, made once for it."""
    if name not in t.__dict__:
        t.__dict__[name] = build()
    return t.__dict__[name]


def stored(t):
    from .views import _fill

    def build():
        k = X.with_keys(t.spark.sql(_fill(_STORED, "spark"), v_jobs=t.dealt("v_jobs")))
        return materialised(k.withColumn("fingerprint", F.coalesce("stale", "fingerprint")).drop("stale"))
    return _once(t, "_stored", build)


def incoming(t):
    return _once(t, "_incoming", lambda: materialised(X.prepare_incoming(t.dealt("v_postings0"))))


def decided(t):
    def build():
        d, r = X.dedupe_decide(incoming(t), stored(t), t.v_links, NOW)
        return materialised(d), r
    return _once(t, "_decided", build)


def settled(t):
    return _once(t, "_settled", lambda: materialised(X.settle(incoming(t), decided(t)[0], stored(t))))


@register("dup_candidates", _CTE + """pr AS MATERIALIZED (SELECT posting_id, 'key' AS evidence, lk.job_id FROM ic JOIN lk USING (external_key)
    UNION ALL SELECT posting_id, 'url', live.job_id FROM ic JOIN live ON live.application_url = ic.application_url OR live.application_url = ic.norm_url
    UNION ALL SELECT posting_id, 'fingerprint', live.job_id FROM ic JOIN live USING (fingerprint) UNION ALL SELECT posting_id, 'hash', live.job_id FROM ic JOIN live USING (content_hash)
    UNION ALL SELECT posting_id, 'org', recent.job_id FROM ic JOIN recent USING (org_id))
  SELECT posting_id, evidence, n AS candidates, j AS first_job_id, job_id FROM pr JOIN (SELECT posting_id, evidence, count(*) AS n, min(job_id) AS j FROM pr GROUP BY 1, 2) q USING (posting_id, evidence)""")
def _(t):
    return X.dup_candidates(incoming(t), stored(t), t.v_links, NOW)


_EXACT = """xx AS (SELECT posting_id, 1 AS rung, job_id FROM ic JOIN lk USING (external_key)
   UNION ALL SELECT posting_id, 2, s.job_id FROM ic JOIN live s ON s.norm_url = ic.norm_url WHERE s.application_url IN (ic.application_url, ic.norm_url) OR s.fingerprint = ic.fingerprint OR s.content_hash = ic.content_hash
      OR (s.org_id = ic.org_id AND s.created_at >= $NOW$ - INTERVAL 120 DAY)
   UNION ALL SELECT posting_id, 3, s.job_id FROM ic JOIN live s USING (fingerprint) UNION ALL SELECT posting_id, 4, s.job_id FROM ic JOIN live s USING (content_hash)),
  ex AS (SELECT posting_id, rung, min(job_id) AS job_id FROM xx WHERE (posting_id, rung) IN (SELECT (posting_id, min(rung)) FROM xx GROUP BY posting_id) GROUP BY 1, 2)"""


@register("dedupe_exact", _CTE + _EXACT + " SELECT posting_id, rung, job_id FROM ex")
def _(t):
    return X.dedupe_exact(incoming(t), stored(t), t.v_links, NOW)


def _grams(x):
    g = f"list_transform(generate_series(1, length({x}) - 1), lambda i: substr({x}, i, 2))"
    return f"list_transform({g}, lambda y, i: y || len(list_filter(({g})[1:i], lambda z: z = y)))"


def titles_sql(left, right, t=R.REVIEW_SIMILARITY, p="t"):
    """CTEs ending in ``<p>p(org_id, lt, rt, score)``."""
    return f"""{p}l AS (SELECT DISTINCT org_id, normalized_title AS t FROM {left}), {p}r AS (SELECT DISTINCT org_id, normalized_title AS t FROM {right}),
  {p}f AS MATERIALIZED (SELECT t, {_grams('t')} AS g, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM (SELECT t FROM {p}l UNION SELECT t FROM {p}r) q),
  {p}q AS (SELECT DISTINCT {p}l.t AS lt, {p}r.t AS rt FROM {p}l JOIN {p}r USING (org_id)),
  {p}s AS (SELECT lt, rt, CASE WHEN lt = rt THEN 1.0 ELSE greatest(CASE WHEN length(lt) < 2 OR length(rt) < 2 THEN 0.0 ELSE 2.0::double * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) END,
      CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END) END AS score
    FROM {p}q JOIN {p}f a ON a.t = lt JOIN {p}f b ON b.t = rt),
  {p}p AS MATERIALIZED (SELECT {p}l.org_id, lt, rt, score FROM {p}l JOIN {p}s ON {p}s.lt = {p}l.t JOIN {p}r ON {p}r.org_id = {p}l.org_id AND {p}r.t = {p}s.rt WHERE score >= {t})"""


@register("dedupe_fuzzy", _CTE + titles_sql("ic", "recent") + " SELECT org_id, lt AS left_title, rt AS right_title, round(score, 6) AS score FROM tp")
def _(t):
    return X.dedupe_fuzzy(incoming(t), stored(t), NOW).withColumn("score", F.round("score", 6))


_DECIDE = _CTE + _EXACT + ", re AS (SELECT * FROM ic ANTI JOIN ex USING (posting_id)), " + titles_sql("re", "recent") + """,
  cl AS (SELECT DISTINCT org_id, normalized_title, deadline FROM re),
  pl AS (SELECT org_id, normalized_title, deadline, job_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, normalized_title, deadline ORDER BY job_id) AS r FROM recent) z WHERE r <= 3),
  cc AS (SELECT cl.org_id, cl.normalized_title, cl.deadline, pl.job_id, score, cl.deadline IS NOT NULL AND pl.deadline IS NOT NULL AS dated,
      row_number() OVER (PARTITION BY cl.org_id, cl.normalized_title, cl.deadline ORDER BY score DESC, pl.job_id) AS rank
    FROM cl JOIN tp ON tp.org_id = cl.org_id AND tp.lt = cl.normalized_title JOIN pl ON pl.org_id = cl.org_id AND pl.normalized_title = tp.rt
    WHERE cl.deadline IS NULL OR pl.deadline IS NULL OR abs(epoch_us(cl.deadline) - epoch_us(pl.deadline)) <= 3 * 86400000000),
  li AS (SELECT re.posting_id, job_id, score, dated, rank FROM re JOIN cc ON cc.org_id = re.org_id AND cc.normalized_title = re.normalized_title AND cc.deadline IS NOT DISTINCT FROM re.deadline WHERE rank <= 3),
  mg AS (SELECT posting_id, job_id, score FROM li WHERE rank = 1 AND score >= 0.92 AND dated),
  de AS (SELECT posting_id, CASE WHEN rung = 1 THEN 'same-source' ELSE 'merge' END AS action, job_id, 1.0::double AS score FROM ex UNION ALL SELECT posting_id, 'merge', job_id, score FROM mg
    UNION ALL SELECT posting_id, 'create', NULL, NULL FROM re ANTI JOIN mg USING (posting_id))"""


@register("dedupe_decide", _DECIDE + " SELECT posting_id, action, job_id, round(score, 6) AS score FROM de")
def _(t):
    d, _r = decided(t)
    return d.withColumn("score", F.round("score", 6))


@register("review_candidates", _DECIDE + " SELECT posting_id, job_id, round(score, 6) AS score, rank::int AS rank FROM li ANTI JOIN mg USING (posting_id)")
def _(t):
    _d, r = decided(t)
    return r.withColumn("score", F.round("score", 6))


# Enriched columns of the incoming rows: those of the job after the one a posting was made from, so that most differ from the stored ones.
_OWN_KEYS = ["title", "normalized_title", "department", "summary", "deadline", "application_url", "fingerprint", "content_hash"]
_NESTED = ["secondary_categories", "responsibilities", "required_skills", "preferred_skills", "education_disciplines"]
_EXTRA = f"""SELECT p.posting_id, CASE WHEN j.job_id % 16 = 0 THEN j.source_name ELSE 'Another portal' END AS source_name, CASE WHEN j.job_id % 3 = 0 THEN '' ELSE 'BDT 1' END AS salary, cast(j.job_id % 3 as int) AS vacancies,
  j.required_skills AS responsibilities, concat('seen ', cast(j.job_id as $STR$)) AS discipline_note, cast(NULL as $STR$) AS ssc_hsc_requirement, j.job_id % 2 = 0 AS requirements_parsed,
  {', '.join('j.' + x for x in X.OWNED if x not in [*_OWN_KEYS, 'salary', 'vacancies', 'responsibilities', 'discipline_note', 'ssc_hsc_requirement', 'requirements_parsed'])}
  FROM {{v_postings0}} p JOIN {{v_jobs}} j ON j.job_id = (p.posting_id + 1)"""


def _extra(t):
    from .views import _fill
    return t.spark.sql(_fill(_EXTRA, "spark"), v_postings0=t.v_postings0, v_jobs=t.v_jobs)


def _matched(t):
    d, _r = decided(t)
    return incoming(t).join(d.where(c("action") != "create").select("posting_id", "action", "job_id"), "posting_id").join(_extra(t), "posting_id")


_FILLED = {"deadline": "IS NOT NULL", "application_url": "<> ''", "salary": "<> ''", "vacancies": "<> 0"}
_MSQL = _DECIDE + f""", me AS (SELECT ic.posting_id, de.action, de.job_id, e.* EXCLUDE (posting_id), {', '.join('ic.' + x for x in _OWN_KEYS)} FROM ic JOIN de USING (posting_id) JOIN ({_EXTRA}) e USING (posting_id) WHERE action <> 'create'),
  mo AS (SELECT me.*, me.action = 'same-source' AND me.source_name = st.source_name AS owns, coalesce(me.deadline <> st.deadline, false) AS changed FROM me JOIN st USING (job_id)),
  ow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY posting_id DESC) AS r FROM mo WHERE owns) z WHERE r = 1),
  fi AS (SELECT job_id, {', '.join(f"arg_min({x}, posting_id) FILTER (NOT owns AND {x} {test}) AS f_{x}" for x, test in _FILLED.items())}, bool_or(changed) AS changed,
    min(posting_id) FILTER (NOT owns AND requirements_parsed) AS req FROM mo GROUP BY 1),
  b AS (SELECT st.job_id, st.review_status, st.first_discovered_at, st.deadline AS old_deadline, fi.* EXCLUDE (job_id), {', '.join(f"CASE WHEN ow.job_id IS NOT NULL THEN ow.{x} ELSE st.{x} END AS {x}" for x in X.OWNED)}
    FROM fi JOIN st USING (job_id) LEFT JOIN ow USING (job_id)),
  g AS (SELECT b.job_id, b.review_status, b.first_discovered_at, b.changed AS deadline_changed, coalesce(b.deadline, f_deadline, old_deadline) AS next_deadline,
    coalesce(b.deadline, f_deadline) AS deadline, CASE WHEN coalesce(b.application_url, '') = '' THEN coalesce(f_application_url, b.application_url) ELSE b.application_url END AS application_url,
    CASE WHEN coalesce(b.salary, '') = '' THEN coalesce(f_salary, b.salary) ELSE b.salary END AS salary, CASE WHEN coalesce(b.vacancies, 0) = 0 THEN coalesce(f_vacancies, b.vacancies) ELSE b.vacancies END AS vacancies,
    {', '.join(f"CASE WHEN NOT b.requirements_parsed AND req IS NOT NULL THEN q.{x} ELSE b.{x} END AS {x}" for x in X.REQUIREMENTS)}, b.requirements_parsed OR req IS NOT NULL AS requirements_parsed,
    {', '.join('b.' + x for x in X.OWNED if x not in [*_FILLED, *X.REQUIREMENTS, 'requirements_parsed'])} FROM b LEFT JOIN mo q ON q.posting_id = b.req) """
_SHOWN = ", ".join(f"array_to_string({x}, ',') AS {x}" if x in _NESTED else x for x in X.OWNED)


def _shown(df, *others):
    return df.select(*others, *[F.array_join(x, ",").alias(x) if x in _NESTED else c(x) for x in X.OWNED])


@register("merge_survivorship", _MSQL + f"""SELECT job_id, deadline_changed, {status_sql(deadline='next_deadline', missing='0', verified='$NOW$')} AS status, {_SHOWN} FROM g""")
def _(t):
    return _shown(X.merge_survivorship(stored(t), _matched(t), NOW), "job_id", "deadline_changed", "status")


@register("deadline_changed", _DECIDE + """ SELECT posting_id, job_id, coalesce(ic.deadline <> st.deadline, false) AS changed FROM de JOIN ic USING (posting_id) JOIN st USING (job_id)""")
def _(t):
    i, s = incoming(t), stored(t)
    d, _r = decided(t)
    new = d.where(c("job_id").isNotNull()).join(i.select("posting_id", c("deadline").alias("n")), "posting_id").join(s.select("job_id", c("deadline").alias("o")), "job_id")
    return new.select("posting_id", "job_id", F.coalesce(c("n") != c("o"), F.lit(False)).alias("changed"))


# One batch with every stored job followed by its copy.
_BATCH_COLS = ["seq", "org_id", "normalized_title", "deadline", "external_key", "norm_url", "fingerprint", "content_hash"]


def batch(t):
    i = incoming(t).withColumn("seq", c("posting_id") * 2 + 1).select(*_BATCH_COLS)
    s = stored(t).withColumn("seq", c("job_id") * 2).withColumn("external_key", F.concat(F.lit("job:"), c("job_id").cast("string"))).select(*_BATCH_COLS)
    return s.unionByName(i)


def _batch_sql(rows: str) -> str:
    """CTEs ending in ``pp(seq, parent)`` for the rows of a batch."""
    firsts = ", ".join(f"k{i} AS (SELECT {k}, min(seq) AS f{i} FROM ba WHERE {k} IS NOT NULL GROUP BY 1)" for i, k in enumerate(X.RUNGS))
    return f"""ba AS MATERIALIZED ({rows}), {firsts},
  pa AS MATERIALIZED (SELECT ba.*, coalesce(CASE WHEN f0 < seq THEN f0 END, CASE WHEN f1 < seq THEN f1 END, CASE WHEN f2 < seq THEN f2 END, CASE WHEN f3 < seq THEN f3 END) AS parent
    FROM ba LEFT JOIN k0 USING (external_key) LEFT JOIN k1 USING (norm_url) LEFT JOIN k2 USING (fingerprint) LEFT JOIN k3 USING (content_hash)),
  rr AS MATERIALIZED (SELECT * FROM pa WHERE parent IS NULL), {titles_sql("rr", "ba", p="u")},
  pc AS MATERIALIZED (SELECT org_id, normalized_title, deadline, min(seq) AS other FROM ba GROUP BY 1, 2, 3),
  rt2 AS MATERIALIZED (SELECT rr.org_id, rr.seq, rr.deadline, up.rt, up.score FROM rr JOIN up ON up.org_id = rr.org_id AND up.lt = rr.normalized_title),
  be AS MATERIALIZED (SELECT seq, other, score, pc.deadline IS NOT NULL AS both_dated, row_number() OVER (PARTITION BY seq ORDER BY score DESC, other) AS r FROM rt2 rr
    JOIN pc ON pc.org_id = rr.org_id AND pc.normalized_title = rr.rt WHERE other < seq AND rr.deadline IS NOT NULL AND (pc.deadline IS NULL OR abs(epoch_us(rr.deadline) - epoch_us(pc.deadline)) <= 3 * 86400000000)),
  pp AS MATERIALIZED (SELECT pa.seq, coalesce(pa.parent, be.other, pa.seq) AS parent FROM pa LEFT JOIN be ON be.seq = pa.seq AND r = 1 AND score >= 0.92 AND both_dated),
  walk AS (SELECT seq, parent FROM pp UNION SELECT walk.seq, pp.parent FROM walk JOIN pp ON pp.seq = walk.parent), ro AS MATERIALIZED (SELECT seq, min(parent) AS root FROM walk GROUP BY 1)"""


_RCTE = _CTE.replace("WITH st", "WITH RECURSIVE st", 1)
_BSQL = _RCTE + _batch_sql("SELECT posting_id * 2 + 1 AS seq, org_id, normalized_title, deadline, external_key, norm_url, fingerprint, content_hash FROM ic UNION ALL SELECT job_id * 2, org_id, normalized_title, deadline, concat('job:', job_id), norm_url, fingerprint, content_hash FROM st")


@register("batch_parents", _BSQL + " SELECT seq, parent FROM pp")
def _(t):
    return X.batch_parents(batch(t))


@register("resolve_batch", _BSQL + " SELECT seq, root FROM ro")
def _(t):
    return X.resolve_batch(batch(t))


# Decisions in which every posting has a job: new jobs are numbered by a hash of their key.
_ID = "('0x' || substr(sha256({}), 1, 15))::bigint"
_SETTLE = _DECIDE.replace("WITH st", "WITH RECURSIVE st", 1) + ", " + _batch_sql("SELECT posting_id AS seq, org_id, normalized_title, deadline, external_key, norm_url, fingerprint, content_hash FROM ic WHERE posting_id IN (SELECT posting_id FROM de WHERE action = 'create')") + f""",
  se AS MATERIALIZED (SELECT posting_id, action, job_id FROM de WHERE action <> 'create' UNION ALL SELECT ro.seq, CASE WHEN ro.seq = root THEN 'create' WHEN a.external_key = b.external_key THEN 'same-source' ELSE 'merge' END, {_ID.format('b.external_key')}
    FROM ro JOIN ic a ON a.posting_id = ro.seq JOIN ic b ON b.posting_id = ro.root)"""


@register("link_upsert", _SETTLE + """, sn AS (SELECT external_key, arg_min(se.job_id, posting_id) AS job_id, arg_max(source_url, posting_id) AS url FROM ic JOIN se USING (posting_id) GROUP BY 1)
  SELECT coalesce(l.external_key, sn.external_key) AS external_key, coalesce(l.job_id, sn.job_id) AS job_id, CASE WHEN l.job_id IS NOT NULL THEN l.source_id ELSE 1 END AS source_id, coalesce(sn.url, l.source_url) AS source_url,
    CASE WHEN l.job_id IS NOT NULL THEN l.first_seen_at ELSE $NOW$ END AS first_seen_at, CASE WHEN sn.external_key IS NOT NULL THEN $NOW$ ELSE l.last_seen_at END AS last_seen_at
  FROM {v_links} l FULL JOIN sn ON sn.external_key = l.external_key""")
def _(t):
    seen = incoming(t).join(settled(t).select("posting_id", "job_id"), "posting_id").select("external_key", "job_id", F.lit(1).cast("bigint").alias("source_id"), "source_url", "posting_id")
    return X.link_upsert(t.v_links, seen, NOW)


@register("create_jobs", _SETTLE + f""" SELECT se.job_id, posting_id, concat({Q.slugify("concat(coalesce(o.short_name, o.name), ' ', title)")}, '-', printf('%X', se.job_id).lower()) AS slug, ic.org_id, source_name, source_url, source_job_id, external_key, {_SHOWN},
  CASE WHEN deadline <= $NOW$ THEN 'EXPIRED' WHEN deadline <= $NOW$ + INTERVAL 72 HOUR THEN 'CLOSING_SOON' ELSE 'NEW' END AS status FROM ic JOIN se USING (posting_id) JOIN ({_EXTRA}) e USING (posting_id) JOIN {{v_orgs}} o ON o.org_id = ic.org_id WHERE action = 'create'""")
def _(t):
    rows = incoming(t).join(_extra(t), "posting_id")
    made = X.create_jobs(rows, settled(t), t.v_orgs, NOW)
    return _shown(made, "job_id", "posting_id", "slug", "org_id", "source_name", "source_url", "source_job_id", "external_key", "status")


_GATED = _SETTLE.replace("FROM {v_postings0}) a)", "FROM {v_postings0} WHERE posting_id % 3 = 0 OR (" + tech_sql("lower(title)", "lower(coalesce(department, ''))", "lower(coalesce(summary, ''))") + ")) a)", 1)


@register("ingest_submissions", _GATED + """ SELECT posting_id, CASE WHEN action = 'create' THEN 'created' WHEN posting_id % 3 <> 0 THEN 'already listed' WHEN action = 'same-source' THEN 'updated' ELSE 'merged' END AS outcome, job_id,
    CASE WHEN action = 'create' THEN CASE WHEN posting_id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING' END END AS review_status, posting_id % 3 = 0 OR action = 'create' AS linked FROM se
  UNION ALL SELECT posting_id, 'not a technology role', NULL, NULL, false FROM {v_postings0} WHERE posting_id NOT IN (SELECT posting_id FROM ic)""")
def _(t):
    return X.ingest_submissions(t.v_postings0.withColumn("trusted", c("posting_id") % 3 == 0), stored(t), t.v_links, NOW)


@register("review_queue", """SELECT d.job_id, d.candidate_job_id, d.score, a.title, oa.name AS org, (SELECT count(*) FROM {v_links} l WHERE l.job_id = d.job_id) AS links,
   b.title AS candidate_title, ob.name AS candidate_org, (SELECT count(*) FROM {v_links} l WHERE l.job_id = d.candidate_job_id) AS candidate_links
   FROM (SELECT job_id, candidate_job_id, max(score) AS score FROM {v_duplicates} WHERE status = 'PENDING' GROUP BY 1, 2) d
   JOIN {v_jobs} a ON a.job_id = d.job_id JOIN {v_orgs} oa ON oa.org_id = a.org_id JOIN {v_jobs} b ON b.job_id = d.candidate_job_id JOIN {v_orgs} ob ON ob.org_id = b.org_id""")
def _(t):
    return X.review_queue(t.v_duplicates, t.v_jobs, t.v_orgs, t.v_links)


_MERGES = "SELECT job_id - 1 AS keep, job_id AS drop FROM {v_jobs0} WHERE job_id % 4 = 3"


def _merged(t):
    return X.apply_merge(t.spark.sql(_MERGES.replace("AS drop", "AS `drop`"), v_jobs0=t.v_jobs0), t.v_links, t.v_saved, t.v_apps, t.v_jobs)


_MG = f'WITH m AS (SELECT job_id - 1 AS keep, job_id AS gone FROM {{v_jobs0}} WHERE job_id % 4 = 3) '


@register("apply_merge", _MG + """SELECT 'links' AS part, NULL::bigint AS user_id, coalesce(keep, l.job_id) AS job_id, external_key AS detail FROM {v_links} l LEFT JOIN m ON gone = l.job_id
  UNION ALL SELECT DISTINCT 'saved', user_id, coalesce(keep, s.job_id), NULL FROM {v_saved} s LEFT JOIN m ON gone = s.job_id
  UNION ALL SELECT 'applications', user_id, job_id, arg_min(status, (moved, updated_at, status)) FROM (SELECT a.user_id, coalesce(keep, a.job_id) AS job_id, status, updated_at, gone IS NOT NULL AS moved FROM {v_apps} a LEFT JOIN m ON gone = a.job_id) q GROUP BY 2, 3
  UNION ALL SELECT 'jobs', NULL, job_id, slug FROM {v_jobs} WHERE job_id NOT IN (SELECT gone FROM m)""")
def _(t):
    r = _merged(t)
    none = F.lit(None).cast("bigint").alias("user_id")
    text = F.lit(None).cast("string").alias("detail")
    return (r["links"].select(F.lit("links").alias("part"), none, "job_id", c("external_key").alias("detail"))
            .unionByName(r["saved"].select(F.lit("saved").alias("part"), "user_id", "job_id", text))
            .unionByName(r["applications"].select(F.lit("applications").alias("part"), "user_id", "job_id", c("status").alias("detail")))
            .unionByName(r["jobs"].select(F.lit("jobs").alias("part"), none, "job_id", c("slug").alias("detail"))))


_EDITS = """SELECT e.job_id, edited_at, e.job_id % 3 = 0 AS edited, CASE WHEN e.job_id % 3 = 1 THEN 'approve' WHEN e.job_id % 3 = 2 AND e.job_id % 2 = 0 THEN 'reject' END AS decision, e.job_id % 15 = 5 AS toggle_archive,
  concat('Edited ', j.title) AS title, CASE WHEN e.job_id % 2 = 0 THEN 'Edited unit' END AS department, j.category, CASE WHEN e.job_id % 4 = 0 THEN NULL ELSE 'MID' END AS level, concat('Edited: ', j.summary) AS summary, 'Sylhet' AS location, 'HYBRID' AS work_mode,
  cast(NULL as $STR$) AS salary, cast(e.job_id % 7 as int) AS vacancies, CASE WHEN e.job_id % 6 = 0 THEN $NOW$ + INTERVAL '1' DAY * 2 END AS deadline, concat('https://edited.example.org/', cast(e.job_id as $STR$)) AS application_url,
  CASE WHEN e.job_id % 2 = 0 THEN split('EEE,CSE', ',') ELSE $EMPTY$ END AS education_disciplines, CASE WHEN e.job_id % 4 = 0 THEN cast(3 as double) END AS min_cgpa, cast(NULL as boolean) AS masters_required, CASE WHEN e.job_id % 9 = 0 THEN true END AS no_third_division,
  cast(NULL as double) AS min_experience_years, cast(NULL as double) AS max_experience_years, cast(NULL as int) AS age_limit, split('Go,Rust', ',') AS required_skills, $EMPTY$ AS preferred_skills
  FROM (SELECT l_orderkey AS job_id, max(l_shipdate) AS edited_at FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_orderkey) e JOIN {v_jobs} j ON j.job_id = e.job_id"""


@register("apply_edits", _CTE + f"""ed AS ({_EDITS}), j AS (SELECT st.job_id, st.org_id, {', '.join(f"CASE WHEN edited THEN ed.{x} ELSE st.{x} END AS {x}" for x in X.EDITABLE)},
    CASE decision WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE review_status END AS review_status, CASE WHEN toggle_archive THEN CASE WHEN archived_at IS NULL THEN $NOW$ END ELSE archived_at END AS archived_at,
    CASE WHEN edited OR decision IS NOT NULL THEN $NOW$ ELSE last_verified_at END AS last_verified_at, missing_runs, first_discovered_at, status AS old_status, st.fingerprint AS old_print, st.normalized_title AS old_title, st.requirements_parsed AS old_parsed, edited,
    coalesce(decision = 'approve', false) AS announce, edited OR coalesce(decision = 'approve', false) AS rescore FROM st JOIN ed USING (job_id)),
  k AS (SELECT *, CASE WHEN rescore THEN {NT} ELSE old_title END AS normalized_title, coalesce((SELECT bool_and(source_id IS NULL) FROM {{v_links}} l WHERE l.job_id = j.job_id), true) AS manual FROM j)
  SELECT job_id, {', '.join(f"array_to_string({x}, ',') AS {x}" if x in _NESTED else x for x in X.EDITABLE)}, normalized_title, review_status, archived_at, rescore, announce,
    CASE WHEN edited THEN len(education_disciplines) > 0 OR min_cgpa IS NOT NULL OR masters_required IS NOT NULL OR min_experience_years IS NOT NULL OR age_limit IS NOT NULL OR no_third_division IS NOT NULL ELSE old_parsed END AS requirements_parsed,
    CASE WHEN rescore THEN {Q.fingerprint("concat('org-', org_id)", 'normalized_title', 'deadline')} ELSE old_print END AS fingerprint, CASE WHEN rescore THEN {status_sql('manual')} ELSE old_status END AS status FROM k""")
def _(t):
    from .views import _fill
    edits = t.spark.sql(_fill(_EDITS, "spark"), lineitem=t.lineitem, v_jobs=t.v_jobs)
    e = X.apply_edits(stored(t), edits, t.v_links, t.v_orgs, NOW)
    return e.select("job_id", *[F.array_join(x, ",").alias(x) if x in _NESTED else x for x in X.EDITABLE], "normalized_title", "review_status", "archived_at", "rescore", "announce", "requirements_parsed", "fingerprint", "status")
