"""Classification and extraction queries over circular texts."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import rules as R, text as T
from ..operators import enrich as E
from . import sqltext as Q
from .core import register

c = F.col
ID = "posting_id"


def low(name):
    return F.lower(F.coalesce(c(name), F.lit("")))


def base(t):
    return t.dealt("v_circulars").withColumn("txt", F.concat("title", F.lit("\n"), "description"))


_B = "WITH b AS (SELECT *, title || chr(10) || description AS txt, lower(title) AS lt, lower(coalesce(department, '')) AS ld, lower(title || chr(10) || description) AS low FROM {v_circulars}) "


def any_of(e, patterns):
    return "(" + " OR ".join(Q.has(e, p) for p in patterns) + ")"


def first_rule(e, rules):
    return "CASE " + " ".join(f"WHEN {Q.has(e, p)} THEN {str(v).lower() if isinstance(v, bool) else Q.q(v)}" for p, v in rules) + " END"


def tech_sql(t, d, x):
    return (f"CASE WHEN {Q.has(t, R.NON_TECH_ENGINEER)} THEN false WHEN {any_of(t, R.TECH_TITLE)} THEN true WHEN {Q.has(d, R.TECH_DEPARTMENT)} THEN true "
            f"WHEN {Q.has(t, R.GENERIC_ENGINEER)} THEN true ELSE {Q.has(t, R.TRAINEE_TITLE)} AND {Q.has(x, R.TRAINEE_TEXT)} END")


@register("is_tech_job", _B + f"SELECT posting_id, {tech_sql('lt', 'ld', 'lower(description)')} AS tech FROM b")
def _(t):
    return t.v_circulars.select(ID, E.is_tech_job(low("title"), low("department"), low("description")).alias("tech"))


_CATS = [r[0] for r in R.CATEGORY_RULES] + [R.TRAINEE_CATEGORY]


def score_codes(t, d, b):
    """list of score*100 + (99 - position), best first"""
    items = []
    for i, (_, title_rules, body_rules) in enumerate(R.CATEGORY_RULES):
        pts = " + ".join([f"10 * ({Q.has(t, p)})::int" for p in title_rules] + [f"({Q.has(b, p)})::int" for p in body_rules])
        items.append(f"({pts}) * 100 + {99 - i}")
    items.append(f"CASE WHEN {Q.has(t, R.TRAINEE_TITLE)} AND ({Q.has(t, R.TRAINEE_TECH_HINT)} OR {Q.has(d, R.TRAINEE_TECH_HINT)}) THEN 2500 ELSE 0 END + {99 - len(R.CATEGORY_RULES)}")
    return f"list_reverse_sort(list_filter([{', '.join(items)}], lambda x: x >= 100))"


_NAME = f"({Q.listed(_CATS)})[100 - x % 100]"
_SCORED = _B + f", s AS (SELECT *, {score_codes('lt', 'ld', "ld || ' ' || lower(description)")} AS codes FROM b), "


def _cat_sql(fallback="'GENERAL_IT_OFFICER'"):
    return _SCORED + f"""k AS (SELECT *, CASE WHEN codes[1] >= 1000 THEN (SELECT {_NAME} FROM (SELECT codes[1] AS x) y) ELSE {fallback} END AS category FROM s)
  SELECT posting_id, category, array_to_string(list_filter(list_transform(list_filter(codes, lambda x: x >= 200), lambda x: {_NAME}), lambda n: n <> category)[:3], ',') AS secondary,
    array_to_string(list_transform(codes, lambda x: {_NAME} || ':' || (x // 100)), ',') AS scores FROM k"""


def _cat(df):
    return df.select(ID, "category", F.array_join("secondary_categories", ",").alias("secondary"),
                     F.array_join(F.transform("scores", lambda x: F.concat(x["category"], F.lit(":"), (-x["minus"]).cast("string"))), ",").alias("scores"))


@register("categorize", _cat_sql())
def _(t):
    return _cat(E.categorize(t.dealt("v_circulars"), text="description"))


def _guess(title: pd.Series, text: pd.Series) -> pd.Series:
    """Example hook: anything that mentions Python is data work."""
    return text.str.contains("Python", regex=False).map({True: "DATA_BI", False: None})


@register("set_category_fallback", _cat_sql("CASE WHEN contains(description, 'Python') THEN 'DATA_BI' ELSE 'GENERAL_IT_OFFICER' END"))
def _(t):
    return _cat(E.categorize(t.dealt("v_circulars"), text="description", fallback=F.pandas_udf(_guess, "string")))


@register("detect_level", _B + f"SELECT posting_id, {first_rule("replace(lt, '.', ' ')", R.LEVEL_RULES)} AS level FROM b")
def _(t):
    return t.v_circulars.select(ID, E.detect_level(c("title")).alias("level"))


def number_sql(e, patterns, ok):
    one = [f"(SELECT v FROM (SELECT try_cast({Q.group(e, p)} as double) AS v) z WHERE {ok})" for p in patterns]
    return f"coalesce({', '.join(one)})"


CGPA_SQL = number_sql("low", R.CGPA, "v > 1.5 AND v <= 4")
AGE_SQL = f"cast({number_sql('low', R.AGE, 'v BETWEEN 18 AND 65')} as int)"


@register("extract_cgpa", _B + f"SELECT posting_id, {CGPA_SQL} AS min_cgpa FROM b")
def _(t):
    return base(t).select(ID, E.extract_cgpa(F.lower("txt")).alias("min_cgpa"))


_SENT = Q.sentences("txt")
_SCHOOL = _B + f""", e AS (SELECT posting_id, s, lower(s) AS l, i FROM (SELECT posting_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT posting_id, {_SENT} AS p FROM b) q) w),
  v AS (SELECT *, try_cast(coalesce({Q.group('l', R.SCHOOL_GPA[0])}, {Q.group('l', R.SCHOOL_GPA[1])}) as double) AS gpa,
    {Q.has('l', R.SCHOOL_BOTH)} OR ({Q.has('l', r'\bssc\b')} AND {Q.has('l', r'\bhsc\b')}) AS both_exams FROM e WHERE {Q.has('l', R.SCHOOL_EXAM)}),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY i) AS rn FROM v WHERE gpa <= 5) y WHERE rn = 1)
  SELECT posting_id, CASE WHEN both_exams OR {Q.has('l', r'\bssc\b|\bsecondary\b')} THEN gpa END AS min_ssc,
    CASE WHEN both_exams OR {Q.has('l', r'\bhsc\b|\bhigher secondary\b')} THEN gpa END AS min_hsc, substr(s, 1, 200) AS note FROM b LEFT JOIN f USING (posting_id)"""


@register("extract_ssc_hsc", _SCHOOL.replace("FROM b LEFT JOIN f USING (posting_id)", "FROM (SELECT posting_id FROM b) b LEFT JOIN f USING (posting_id)"))
def _(t):
    x = base(t).select(ID, E.extract_ssc_hsc(T.sentences(c("txt"))).alias("x"))
    return x.select(ID, "x.min_ssc", "x.min_hsc", "x.note")


@register("extract_masters", _B + f"SELECT posting_id, {first_rule('low', R.MASTERS)} AS masters FROM b")
def _(t):
    return base(t).select(ID, E.extract_masters(F.lower("txt")).alias("masters"))


@register("extract_third_division", _B + f"SELECT posting_id, CASE WHEN {any_of('low', R.THIRD_DIVISION)} THEN true END AS no_third FROM b")
def _(t):
    return base(t).select(ID, E.extract_third_division(F.lower("txt")).alias("no_third"))


def years_sql(e):
    return "CASE " + " ".join(f"WHEN {e} = '{w}' THEN {n}.0::double" for w, n in R.NUMBER_WORDS.items()) + f" ELSE try_cast({e} as double) END"


_DASH = "regexp_replace(low, '[–—]', '-', 'g')"
EXP_CTE = f""", xe AS (SELECT posting_id, s, i FROM (SELECT posting_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT posting_id, {Q.sentences(_DASH)} AS p FROM b) q) w WHERE contains(s, 'experience')),
  xv AS (SELECT *, {Q.has('s', R.EXPERIENCE_RANGE)} AS ranged, coalesce({Q.group('s', R.EXPERIENCE_MIN[0])}, {Q.group('s', R.EXPERIENCE_MIN[1])}) AS least FROM xe),
  xf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY i) AS rn FROM xv WHERE ranged OR least IS NOT NULL) y WHERE rn = 1),
  x AS (SELECT b.posting_id, CASE WHEN {Q.has(_DASH, R.FRESHER)} THEN 0.0::double WHEN ranged THEN {years_sql(Q.group('s', R.EXPERIENCE_RANGE, 1))} ELSE {years_sql('least')} END AS min_years,
    CASE WHEN {Q.has(_DASH, R.FRESHER)} THEN try_cast({Q.group(_DASH, R.FRESHER_RANGE, 2)} as double) WHEN ranged THEN try_cast({Q.group('s', R.EXPERIENCE_RANGE, 2)} as double) END AS max_years
    FROM b LEFT JOIN xf USING (posting_id)) """


@register("extract_experience", _B + EXP_CTE + "SELECT posting_id, min_years, max_years FROM x")
def _(t):
    x = base(t).select(ID, E.extract_experience(F.lower("txt")).alias("x"))
    return x.select(ID, c("x.min").alias("min_years"), c("x.max").alias("max_years"))


@register("extract_age", _B + f"SELECT posting_id, {AGE_SQL} AS age_limit FROM b")
def _(t):
    return base(t).select(ID, E.extract_age(F.lower("txt")).alias("age_limit"))


def names_sql(e, table):
    return f"list_filter([{', '.join(f'CASE WHEN {Q.has(e, p)} THEN {Q.q(n)} END' for n, p in table)}], lambda x: x IS NOT NULL)"


EDU_CTE = f""", de AS (SELECT posting_id, list_filter({_SENT}, lambda s: {Q.has('lower(s)', R.EDUCATION_SENTENCE)}) AS edu FROM b),
  dl AS (SELECT *, ' ' || lower(array_to_string(edu, ' ' || chr(10) || ' ')) || ' ' AS scope FROM de),
  dc AS (SELECT *, {names_sql('scope', R.DISCIPLINES)} AS hits FROM dl),
  d AS (SELECT posting_id, CASE WHEN len(hits) > 0 AND {Q.has('scope', R.RELATED_WORDING)} THEN list_append(hits, 'RELATED') ELSE hits END AS codes, substr(edu[1], 1, 240) AS note FROM dc) """


@register("extract_disciplines", _B + EDU_CTE + "SELECT posting_id, array_to_string(codes, ',') AS codes, note FROM d")
def _(t):
    x = base(t).select(ID, E.extract_disciplines(T.sentences(c("txt"))).alias("x"))
    return x.select(ID, F.array_join("x.codes", ",").alias("codes"), "x.note")


CANON_SQL = "CASE WHEN discipline IS NULL OR discipline = '' THEN NULL " + " ".join(
    f"WHEN {Q.has('lower(discipline)', p)} THEN '{code}'" for code, p in R.DISCIPLINES if code != "ANY") + f" ELSE upper({Q.strip('discipline')}) END"


@register("canonical_discipline", f"SELECT user_id, discipline, {CANON_SQL} AS code FROM {{v_profiles}}")
def _(t):
    return t.v_profiles.select("user_id", "discipline", E.canonical_discipline(c("discipline")).alias("code"))


@register("detect_skills", _B + f"SELECT posting_id, array_to_string({names_sql('low', R.SKILLS)}, ',') AS skills FROM b")
def _(t):
    return base(t).select(ID, F.array_join(E.detect_skills(F.lower("txt")), ",").alias("skills"))


SKILL_CTE = f""", se AS (SELECT posting_id, i, {names_sql('lower(s)', R.SKILLS)} AS names, {Q.has('lower(s)', R.PREFERRED_WORDING)} AS soft FROM (
    SELECT posting_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT posting_id, {_SENT} AS p FROM b) q) w),
  sn AS (SELECT posting_id, soft, i, unnest(names) AS name, generate_subscripts(names, 1) AS j FROM se),
  sf AS (SELECT posting_id, soft, name, min(i * 1000 + j) AS ord FROM sn GROUP BY 1, 2, 3),
  sk AS (SELECT b.posting_id, coalesce((SELECT string_agg(name, ',' ORDER BY ord) FROM sf WHERE sf.posting_id = b.posting_id AND NOT soft AND name <> {Q.q(R.GENERIC_SKILL)}), '') AS required,
    coalesce((SELECT string_agg(name, ',' ORDER BY ord) FROM sf WHERE sf.posting_id = b.posting_id AND soft AND name NOT IN (SELECT name FROM sf g WHERE g.posting_id = b.posting_id AND NOT g.soft)), '') AS preferred FROM b) """


@register("split_skills", _B + SKILL_CTE + "SELECT posting_id, required, preferred FROM sk")
def _(t):
    x = base(t).select(ID, E.split_skills(T.sentences(c("txt"))).alias("x"))
    return x.select(ID, F.array_join("x.required", ",").alias("required"), F.array_join("x.preferred", ",").alias("preferred"))


VAC_SQL = f"try_cast({Q.group('low', R.VACANCIES)} as int)"
SAL_SQL = Q.strip(Q.group("txt", R.SALARY))
DL_TXT = "coalesce(" + ", ".join(Q.group("txt", p) for p in R.DEADLINE) + ")"
DL_CTE = f", dt AS (SELECT posting_id, {DL_TXT} AS dtxt FROM b), dd AS (SELECT posting_id, {Q.parse_local_date('dtxt')} AS x_deadline FROM dt) "


@register("extract_vacancies", _B + f"SELECT posting_id, {VAC_SQL} AS vacancies FROM b")
def _(t):
    return base(t).select(ID, E.extract_vacancies(F.lower("txt")).alias("vacancies"))


@register("extract_salary", _B + f"SELECT posting_id, {SAL_SQL} AS salary FROM b")
def _(t):
    return base(t).select(ID, E.extract_salary(c("txt")).alias("salary"))


@register("extract_deadline", _B + DL_CTE + "SELECT posting_id, x_deadline AS deadline FROM dd")
def _(t):
    return base(t).select(ID, E.extract_deadline(c("txt")).alias("deadline"))


_CITY = f"list_filter([{', '.join(f'''CASE WHEN contains(low, '{x.lower()}') THEN '{R.CITY_ALIAS[1] if x == R.CITY_ALIAS[0] else x}' END''' for x in R.CITIES)}], lambda x: x IS NOT NULL)"
LOC_SQL = f"CASE WHEN contains(low, 'anywhere in bangladesh') THEN 'Anywhere in Bangladesh' ELSE nullif(array_to_string(list_filter({_CITY}, lambda x, i: list_position({_CITY}, x) = i), ', '), '') END"
MODE_SQL = first_rule("low", R.WORK_MODE_WORDING)


@register("extract_location", _B + f"SELECT posting_id, {LOC_SQL} AS location FROM b")
def _(t):
    return base(t).select(ID, E.extract_location(F.lower("txt")).alias("location"))


@register("extract_work_mode", _B + f"SELECT posting_id, {MODE_SQL} AS work_mode FROM b")
def _(t):
    return base(t).select(ID, E.extract_work_mode(F.lower("txt")).alias("work_mode"))


BANK_SQL = Q.has("low", R.BANKING_PREFERRED)


@register("banking_preferred", _B + f"SELECT posting_id, {BANK_SQL} AS preferred FROM b")
def _(t):
    return base(t).select(ID, E.banking_preferred(F.lower("txt")).alias("preferred"))


_REQ_CTE = _B + EDU_CTE + EXP_CTE
PARSED_SQL = f"(len(codes) > 0 OR {CGPA_SQL} IS NOT NULL OR {first_rule('low', R.MASTERS)} IS NOT NULL OR min_years IS NOT NULL OR {AGE_SQL} IS NOT NULL OR {any_of('low', R.THIRD_DIVISION)})"


@register("requirements_parsed", _REQ_CTE + f"SELECT b.posting_id, {PARSED_SQL} AS parsed FROM b JOIN d USING (posting_id) JOIN x USING (posting_id)")
def _(t):
    return E.extract_requirements(base(t), "txt").select(ID, c("requirements_parsed").alias("parsed"))


_T = Q.collapse("title")
_TEXT = Q.html_to_text("description")
_ENRICH = ("WITH b AS (SELECT *, lower(title) AS lt, lower(coalesce(department, '')) AS ld, lower(title || chr(10) || body) AS low, title || chr(10) || body AS txt FROM (SELECT posting_id, "
           + _T + " AS title, department, " + _TEXT + " AS body FROM {v_circulars}) z WHERE " + tech_sql("lower(title)", "lower(coalesce(department, ''))", "lower(body)") + ") "
           + EDU_CTE + EXP_CTE + SKILL_CTE + DL_CTE
           + f""", c0 AS (SELECT posting_id, {score_codes('lt', 'ld', "ld || ' ' || lower(body)")} AS codes FROM b),
  su AS (SELECT posting_id, CASE WHEN sb = '' THEN title || {Q.q(R.SUMMARY_FALLBACK)} ELSE {Q.truncate_words('sb', R.SUMMARY_CHARS)} END AS summary FROM (
     SELECT posting_id, title, regexp_replace(CASE WHEN starts_with(body, title) THEN {Q.strip("substr(body, length(title) + 1)")} ELSE body END, '\\n+', ' ', 'g') AS sb FROM b) y)
  SELECT b.posting_id, title, {Q.normalize_title('title')} AS normalized_title, CASE WHEN c0.codes[1] >= 1000 THEN (SELECT {_NAME} FROM (SELECT c0.codes[1] AS x) y) ELSE 'GENERAL_IT_OFFICER' END AS category,
    {first_rule("replace(lt, '.', ' ')", R.LEVEL_RULES)} AS level, summary, array_to_string(d.codes, ',') AS disciplines, {CGPA_SQL} AS min_cgpa, min_years, max_years, {AGE_SQL} AS age_limit,
    required, preferred, {PARSED_SQL.replace('codes', 'd.codes')} AS parsed, {LOC_SQL} AS location, coalesce({MODE_SQL}, 'ONSITE') AS work_mode,
    CASE WHEN {Q.has('lt', R.CONTRACT_TITLE)} THEN 'CONTRACT' WHEN {Q.has('lt', R.INTERN_TITLE)} THEN 'INTERNSHIP' ELSE 'FULL_TIME' END AS employment_type, {SAL_SQL} AS salary, {VAC_SQL} AS vacancies, x_deadline AS deadline,
    {Q.fingerprint("'org-1'", Q.normalize_title('title'), 'x_deadline')} AS fingerprint, {Q.content_hash("'org-1'", 'title', 'department', 'summary', Q.iso_utc('x_deadline'))} AS content_hash
  FROM b JOIN d USING (posting_id) JOIN x USING (posting_id) JOIN sk USING (posting_id) JOIN dd USING (posting_id) JOIN su USING (posting_id) JOIN c0 USING (posting_id)""")


@register("enrich", _ENRICH)
def _(t):
    e = E.enrich(t.dealt("v_circulars").withColumn("org_slug", F.lit("org-1")))
    return e.select(ID, "title", "normalized_title", "category", "level", "summary", F.array_join("education_disciplines", ",").alias("disciplines"), "min_cgpa",
                    c("min_experience_years").alias("min_years"), c("max_experience_years").alias("max_years"), "age_limit", F.array_join("required_skills", ",").alias("required"),
                    F.array_join("preferred_skills", ",").alias("preferred"), c("requirements_parsed").alias("parsed"), "location", "work_mode", "employment_type", "salary", "vacancies",
                    "deadline", "fingerprint", "content_hash")


_ORG_POSTINGS = """SELECT j.job_id AS posting_id, CASE WHEN j.job_id % 10 = 0 THEN o.slug WHEN j.job_id % 10 = 1 THEN 'org-unknown' END AS organization_slug,
  CASE WHEN j.job_id % 10 = 2 THEN o.slug END AS source_org_slug, CASE WHEN j.job_id % 4 = 0 THEN 'NBFI' END AS default_org_type,
  CASE WHEN j.job_id % 10 IN (0, 3) THEN NULL WHEN j.job_id % 10 < 6 THEN concat('Head office, ', o.name, '!') WHEN j.job_id % 10 = 6 THEN o.short_name
       WHEN j.job_id % 10 = 7 THEN concat('Ministry of ', j.department) ELSE upper(replace(o.name, ' PLC', ' Ltd.')) END AS organization_name
  FROM {v_jobs0} j JOIN {v_orgs} o USING (org_id)"""
_AL = Q.collapse(f"regexp_replace(regexp_replace(lower(a), {Q.re2(R.ORG_ALIAS_NOISE)}, '', 'g'), '[^a-z0-9 ]+', ' ', 'g')")
_NM = Q.collapse("regexp_replace(lower(organization_name), '[^a-z0-9 ]+', ' ', 'g')")
_RESOLVED = f"""WITH p AS ({_ORG_POSTINGS}), al AS (SELECT org_id, slug, {_AL} AS alias FROM (SELECT org_id, slug, unnest([name, short_name]) AS a FROM {{v_orgs}}) q WHERE a IS NOT NULL),
  n AS (SELECT DISTINCT organization_name, {_NM} AS plain FROM p WHERE organization_name <> ''),
  m AS (SELECT organization_name, arg_min(slug, org_id) AS slug FROM n JOIN al ON length(alias) >= 3 AND contains(plain, alias) GROUP BY 1),
  r AS (SELECT p.*, coalesce(organization_slug, source_org_slug, m.slug) AS wanted FROM p LEFT JOIN m USING (organization_name)),
  z AS (SELECT r.*, o.slug AS known, CASE WHEN o.slug IS NOT NULL THEN o.slug WHEN organization_name <> '' THEN {Q.slugify('organization_name')} ELSE 'government-other' END AS org_slug
    FROM r LEFT JOIN {{v_orgs}} o ON o.slug = r.wanted) """


def _org_postings(t):
    return t.spark.sql(_ORG_POSTINGS, v_jobs0=t.v_jobs0, v_orgs=t.v_orgs)


@register("resolve_organization", _RESOLVED + "SELECT posting_id, org_slug, known IS NULL AS new_org FROM z")
def _(t):
    return E.resolve_organization(_org_postings(t), t.v_orgs).select(ID, "org_slug", "new_org")


@register("new_organizations", _RESOLVED + """SELECT org_slug, min(CASE WHEN org_slug = 'government-other' THEN 'Government organisations (various)' ELSE organization_name END) AS name,
   min(CASE WHEN org_slug = 'government-other' THEN 'GOVERNMENT' ELSE coalesce(default_org_type, 'GOVERNMENT') END) AS type FROM z WHERE known IS NULL AND org_slug NOT IN (SELECT slug FROM {v_orgs}) GROUP BY 1""")
def _(t):
    return E.new_organizations(E.resolve_organization(_org_postings(t), t.v_orgs), t.v_orgs)
