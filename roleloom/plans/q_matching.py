"""Matching queries over the (user, job) pairs that occur in the data."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import match as M
from . import sqltext as Q
from .q_enrich import CANON_SQL, _CATS, score_codes
from .q_search import ACTIVE
from .core import register
from .views import NOW

c = F.col


def say(key, *values):
    kind, template = M.SAY[key]
    pieces = (kind + ":" + template).split("%s")
    out = Q.q(pieces[0])
    for v, piece in zip(values, pieces[1:]):
        out += f" || ({v})::varchar || {Q.q(piece)}"
    return out


def two(e):
    return f"((floor({e} * 100 + 0.5)::bigint // 100)::varchar || '.' || lpad((floor({e} * 100 + 0.5)::bigint % 100)::varchar, 2, '0'))"


def yrs(e):
    return f"(CASE WHEN {e} = floor({e}) THEN floor({e})::bigint::varchar ELSE printf('%.1f', {e}) END)"


_EQ = "CASE code " + " ".join(f"WHEN '{k}' THEN {Q.listed(v)}" for k, v in R.DISCIPLINE_EQUIVALENTS.items()) + " ELSE [code] END"
_ROLE_CAT = f"(CASE WHEN k[1] >= 1000 THEN ({Q.listed(_CATS)})[100 - k[1] % 100] ELSE 'GENERAL_IT_OFFICER' END)"
_SIM = Q.similarity("rn", "tn")
_HIT = "list_filter({0}, lambda s: list_contains(coalesce(known, []), s))"
_KNOWS = "len(list_filter(mine, lambda m: " + Q.skill_matches("m", Q.norm_skill("s")) + ")) > 0"


def _school(label, need, mine):
    n = Q.q(label)
    return (f"CASE WHEN {need} IS NULL THEN NULL WHEN {mine} IS NULL THEN {say('school_unknown', n, two(need))} WHEN {mine} + 1e-9 < {need} THEN {say('school_fail', n, two(need), two(mine))} "
            f"ELSE {say('school_ok', n, two(mine), two(need))} END")


def pairs_sql(pairs, jobs="{v_jobs}"):
    """CTE chain ending in ``z``: one row per pair with every flag, point and reason."""
    fit = " ".join(f"WHEN primary_focus = '{k}' AND category IN {Q.strings(v['fit'])} THEN 15" for k, v in R.FOCUS.items())
    clash = " OR ".join(f"(primary_focus = '{k}' AND category IN {Q.strings(v['conflict'])})" for k, v in R.FOCUS.items())
    return f"""WITH pj AS MATERIALIZED ({pairs}),
  pr AS MATERIALIZED (SELECT *, {CANON_SQL} AS code, CASE WHEN cgpa_scale = 5 THEN bachelor_cgpa * 4 / 5 ELSE bachelor_cgpa END AS cgpa, list_transform(skills, lambda s: {Q.norm_skill('s')}) AS mine FROM {{v_profiles}}),
  ro AS (SELECT role, {Q.normalize_title('role')} AS rn, {score_codes('lower(role)', "''", "''")} AS k FROM (SELECT DISTINCT unnest(preferred_roles) AS role FROM {{v_profiles}}) q),
  rc AS (SELECT role, rn, {_ROLE_CAT} AS rcat FROM ro),
  jb AS MATERIALIZED (SELECT j.*, o.slug AS org_slug, {Q.normalize_title('j.title')} AS tn FROM {jobs} j JOIN {{v_orgs}} o USING (org_id)),
  ur AS (SELECT p.user_id, rc.rn, rc.rcat FROM (SELECT user_id, unnest(preferred_roles) AS role FROM pr) p JOIN rc USING (role)),
  combos AS (SELECT rn, tn, {_SIM} AS sim FROM (SELECT DISTINCT ur.rn, jb.tn FROM pj JOIN ur USING (user_id) JOIN jb USING (job_id)) q),
  rs AS (SELECT pj.user_id, pj.job_id, max(sim) AS sim, bool_or(ur.rcat = jb.category OR list_contains(jb.secondary_categories, ur.rcat)) AS rhit
    FROM pj JOIN ur USING (user_id) JOIN jb USING (job_id) JOIN combos ON combos.rn = ur.rn AND combos.tn = jb.tn GROUP BY 1, 2),
  stated AS (SELECT DISTINCT s FROM (SELECT unnest(required_skills || preferred_skills) AS s FROM jb) q),
  sm AS MATERIALIZED (SELECT mine, list(s) AS known FROM (SELECT DISTINCT mine FROM pr) q, stated WHERE {_KNOWS} GROUP BY 1),
  a AS (SELECT pr.*, jb.* EXCLUDE (age_limit, requirements_parsed), jb.age_limit, jb.requirements_parsed, rs.sim, rs.rhit, list_filter(education_disciplines, lambda x: x <> 'RELATED') AS codes,
     {_HIT.format('required_skills')} AS hreq, {_HIT.format('preferred_skills')} AS hpref
     FROM pj JOIN pr USING (user_id) JOIN jb USING (job_id) LEFT JOIN sm ON sm.mine = pr.mine LEFT JOIN rs ON rs.user_id = pr.user_id AND rs.job_id = jb.job_id),
  s AS (SELECT *,
     CASE WHEN len(codes) = 0 THEN 'missing' WHEN code IS NULL THEN 'manual' WHEN list_contains(codes, 'ANY') THEN 'any' WHEN list_has_any(codes, {_EQ}) THEN 'ok'
       WHEN list_contains(education_disciplines, 'RELATED') AND code IN {Q.strings(R.TECH_DISCIPLINES)} AND list_has_any(codes, {Q.listed(R.TECH_DISCIPLINES)}) THEN 'cap' ELSE 'fail' END AS disc,
     CASE WHEN min_cgpa IS NULL THEN 'missing' WHEN cgpa IS NULL THEN 'manual' WHEN cgpa + 1e-9 < min_cgpa THEN 'fail' ELSE 'ok' END AS cg,
     CASE WHEN masters_required AND NOT has_masters THEN 'fail' ELSE 'ok' END AS ma,
     CASE WHEN (min_ssc_gpa IS NOT NULL AND ssc_gpa + 1e-9 < min_ssc_gpa) OR (min_hsc_gpa IS NOT NULL AND hsc_gpa + 1e-9 < min_hsc_gpa) THEN true ELSE false END AS school_fail,
     (min_ssc_gpa IS NOT NULL AND ssc_gpa IS NULL) OR (min_hsc_gpa IS NOT NULL AND hsc_gpa IS NULL) AS school_manual,
     coalesce(no_third_division, false) AND (has_third_division OR coalesce(cgpa < 2.25, false)) AS third_fail,
     CASE WHEN age_limit IS NULL THEN 'none' WHEN age IS NULL THEN 'manual' WHEN age > age_limit THEN 'fail' ELSE 'ok' END AS ag,
     CASE WHEN min_experience_years IS NULL THEN 'missing' WHEN experience_years IS NULL THEN 'manual' WHEN experience_years >= min_experience_years THEN
       CASE WHEN max_experience_years IS NOT NULL AND experience_years > max_experience_years + 2 THEN 'over' ELSE 'ok' END WHEN min_experience_years - experience_years <= 1 THEN 'cap' ELSE 'fail' END AS ex,
     CASE WHEN len(required_skills) + len(preferred_skills) = 0 THEN 17.0 WHEN len(required_skills) > 0 AND len(preferred_skills) > 0 THEN len(hreq)::double / len(required_skills) * 28 + len(hpref)::double / len(preferred_skills) * 7
       WHEN len(required_skills) > 0 THEN len(hreq)::double / len(required_skills) * 35 ELSE len(hpref)::double / len(preferred_skills) * 35 END::double AS skill_points,
     CASE {fit} WHEN {clash} THEN 0 ELSE 8 END::double AS category_points, coalesce({clash}, false) AS clash,
     CASE WHEN len(preferred_roles) = 0 THEN 10 WHEN sim >= 0.6 THEN 20 WHEN rhit THEN 14 WHEN sim >= 0.4 THEN 8 ELSE 0 END::double AS role_points,
     CASE WHEN work_mode = 'REMOTE' AND open_to_remote THEN 'remote' WHEN location IS NULL THEN 'none' WHEN len(list_filter(preferred_locations, lambda p: contains(lower(location), lower(p)))) > 0 THEN 'liked'
       WHEN contains(lower(location), 'anywhere') THEN 'anywhere' WHEN len(preferred_locations) > 0 THEN 'off' ELSE 'none' END AS lo,
     CASE WHEN len(preferred_org_slugs) = 0 THEN 3 WHEN list_contains(preferred_org_slugs, org_slug) THEN 5 ELSE 0 END::double AS org_points FROM a),
  p AS (SELECT *, CASE ex WHEN 'missing' THEN 8 WHEN 'ok' THEN 15 WHEN 'over' THEN 8 WHEN 'cap' THEN 6 ELSE 0 END::double AS exp_points,
     CASE lo WHEN 'remote' THEN 10 WHEN 'liked' THEN 10 WHEN 'off' THEN 0 ELSE 5 END::double AS location_points FROM s),
  y AS (SELECT *, floor(least(100, greatest(0, skill_points + role_points + exp_points + category_points + location_points + org_points)) + 0.5)::int AS score,
     disc = 'fail' OR cg = 'fail' OR ma = 'fail' OR school_fail OR third_fail OR ag = 'fail' OR ex = 'fail' AS fail,
     disc = 'manual' OR cg = 'manual' OR school_manual OR ag = 'manual' OR ex = 'manual' OR NOT requirements_parsed AS manual,
     disc = 'cap' OR ex = 'cap' OR (disc = 'missing')::int + (cg = 'missing')::int + (ex = 'missing')::int >= 2 AS cap FROM p),
  v AS (SELECT *, CASE WHEN fail THEN 'NOT_ELIGIBLE' WHEN manual THEN 'MANUAL_REVIEW' WHEN score >= 70 AND NOT cap THEN 'STRONG' WHEN score >= 45 THEN 'POSSIBLE' ELSE 'WEAK' END AS verdict FROM y),
  z AS (SELECT *, CASE disc WHEN 'missing' THEN {say('disc_missing')} WHEN 'manual' THEN {say('disc_unknown')} WHEN 'any' THEN {say('disc_any')} WHEN 'ok' THEN {say('disc_ok', 'code')}
       WHEN 'cap' THEN {say('disc_related', 'code')} ELSE {say('disc_fail', "array_to_string(codes, '/')", 'code')} END AS r_disc,
     CASE cg WHEN 'missing' THEN CASE WHEN verdict = 'POSSIBLE' THEN {say('cgpa_possible')} ELSE {say('cgpa_missing')} END WHEN 'manual' THEN {say('cgpa_unknown', two('min_cgpa'))}
       WHEN 'fail' THEN {say('cgpa_fail', two('min_cgpa'), two('cgpa'))} ELSE {say('cgpa_ok', two('cgpa'), two('min_cgpa'))} END AS r_cgpa,
     CASE WHEN masters_required IS NULL THEN {say('masters_missing')} WHEN NOT masters_required THEN {say('masters_free')} WHEN has_masters THEN {say('masters_ok')} ELSE {say('masters_fail')} END AS r_masters,
     {_school('SSC', 'min_ssc_gpa', 'ssc_gpa')} AS r_ssc, {_school('HSC', 'min_hsc_gpa', 'hsc_gpa')} AS r_hsc,
     CASE WHEN no_third_division THEN CASE WHEN third_fail THEN {say('third_fail')} ELSE {say('third_ok')} END END AS r_third,
     CASE ag WHEN 'manual' THEN {say('age_unknown', 'age_limit')} WHEN 'fail' THEN {say('age_fail', 'age_limit', 'age')} WHEN 'ok' THEN {say('age_ok', 'age_limit')} END AS r_age,
     CASE WHEN ex = 'missing' THEN {say('exp_missing')} WHEN ex = 'manual' THEN {say('exp_unknown', yrs('min_experience_years'))} WHEN ex IN ('ok', 'over') AND min_experience_years = 0 THEN {say('exp_none')}
       WHEN ex IN ('ok', 'over') THEN {say('exp_ok', "CASE WHEN experience_years >= 1 AND experience_years <> floor(experience_years) THEN floor(experience_years)::bigint::varchar || '+' ELSE " + yrs('experience_years') + ' END', yrs('min_experience_years'))}
       WHEN ex = 'cap' THEN {say('exp_short', yrs('min_experience_years'))} ELSE {say('exp_fail', yrs('min_experience_years'), yrs('experience_years'))} END AS r_exp,
     CASE WHEN ex = 'over' THEN {say('exp_over', yrs('max_experience_years'))} END AS r_over,
     CASE WHEN len(hreq) + len(hpref) > 0 THEN {say('skills_hit', "array_to_string((hreq || hpref)[:6], ', ')")} END AS r_hit,
     CASE WHEN len(list_filter(required_skills, lambda x: NOT list_contains(hreq, x))) > 0 THEN {say('skills_gap', "array_to_string(list_filter(required_skills, lambda x: NOT list_contains(hreq, x))[:5], ', ')")} END AS r_gap,
     CASE WHEN len(required_skills) + len(preferred_skills) = 0 THEN {say('skills_missing')} END AS r_noskill,
     CASE WHEN banking_experience_preferred AND NOT banking_experience THEN CASE WHEN len(hreq) + len(hpref) > 0 THEN {say('bank_skilled')} ELSE {say('bank')} END END AS r_bank,
     CASE WHEN clash THEN {say('focus', "lower(replace(category, '_', ' '))", 'primary_focus')} END AS r_focus, CASE WHEN len(preferred_roles) > 0 AND role_points >= 14 THEN {say('role')} END AS r_role,
     CASE lo WHEN 'remote' THEN {say('remote')} WHEN 'anywhere' THEN {say('anywhere')} WHEN 'off' THEN {say('elsewhere', 'location')} END AS r_loc,
     CASE WHEN NOT requirements_parsed THEN {say('unread')} END AS r_unread FROM v) """


VIEWED = "SELECT user_id, job_id FROM {v_views} SEMI JOIN {v_profiles} USING (user_id)"
_Z = pairs_sql(VIEWED)
REASONS = "concat_ws('|', r_disc, r_cgpa, r_masters, r_ssc, r_hsc, r_third, r_age, r_exp, r_over, r_hit, r_gap, r_noskill, r_bank, r_focus, r_role, r_loc, r_unread)"


def _joined(reasons):
    told = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return F.array_join(F.transform(told, lambda r: F.concat(r["kind"], F.lit(":"), r["text"])), "|")


def _prepared(t):
    return M.prepare(t.v_views, t.dealt("v_profiles", "customer"), t.dealt("v_jobs"), t.v_orgs)


def _part(name, sql, build, prepared=_prepared, flags=(), points=None):
    @register(name, _Z + f"SELECT user_id, job_id, {sql} FROM z")
    def _(t):
        part = build()
        cols = [_joined(part.reasons).alias("reason")] if part.reasons else []
        cols += [getattr(part, f).alias(f) for f in flags]
        cols += [F.round(part.points, 6).alias(points)] if points else []
        return prepared(t).select("user_id", "job_id", *cols)


_part("elig_discipline", "r_disc AS reason, disc = 'fail' AS fail, disc = 'manual' AS manual, disc = 'cap' AS cap, disc = 'missing' AS missing", M.elig_discipline, flags=("fail", "manual", "cap", "missing"))
_part("elig_cgpa", f"CASE WHEN cg = 'missing' THEN {say('cgpa_missing')} ELSE r_cgpa END AS reason, cg = 'fail' AS fail, cg = 'manual' AS manual, cg = 'missing' AS missing", M.elig_cgpa, flags=("fail", "manual", "missing"))
_part("elig_masters", "r_masters AS reason, ma = 'fail' AS fail", M.elig_masters, flags=("fail",))
_part("elig_ssc_hsc", "concat_ws('|', r_ssc, r_hsc) AS reason, school_fail AS fail, school_manual AS manual", M.elig_ssc_hsc, flags=("fail", "manual"))
_part("elig_third_class", "coalesce(r_third, '') AS reason, third_fail AS fail", M.elig_third_class, flags=("fail",))
_part("elig_age", "coalesce(r_age, '') AS reason, ag = 'fail' AS fail, ag = 'manual' AS manual", M.elig_age, flags=("fail", "manual"))
_part("elig_experience", "concat_ws('|', r_exp, r_over) AS reason, ex = 'fail' AS fail, ex = 'manual' AS manual, ex = 'cap' AS cap, ex = 'missing' AS missing, exp_points AS points", M.elig_experience, flags=("fail", "manual", "cap", "missing"), points="points")
_part("score_skills", "concat_ws('|', r_hit, r_gap, r_noskill) AS reason, round(skill_points, 6) AS points", M.score_skills, points="points")
_part("warn_banking", "coalesce(r_bank, '') AS reason", M.warn_banking)
_part("score_category", "coalesce(r_focus, '') AS reason, category_points AS points", M.score_category, points="points")
_part("score_role", "coalesce(r_role, '') AS reason, role_points AS points", M.score_role, points="points")
_part("score_location", "coalesce(r_loc, '') AS reason, location_points AS points", M.score_location, points="points")
_part("score_org", "org_points AS points", M.score_org, points="points")


def _matched(t):
    return M.match(t.v_views, t.dealt("v_profiles", "customer"), t.dealt("v_jobs"), t.v_orgs, told=M.as_text)


@register("match_score", _Z + "SELECT user_id, job_id, score FROM z")
def _(t):
    return _matched(t).select("user_id", "job_id", "score")


@register("verdict", _Z + "SELECT user_id, job_id, verdict FROM z")
def _(t):
    return _matched(t).select("user_id", "job_id", "verdict")


@register("reasons", _Z + f"SELECT user_id, job_id, verdict, score, {REASONS} AS reasons FROM z")
def _(t):
    return _matched(t)


# The jobs that changed within the last half hour before a tick.
_CHANGED = "updated_at >= $NOW$ - INTERVAL 30 MINUTE"


@register("match_for_jobs", pairs_sql(f"SELECT user_id, job_id FROM {{v_profiles}} CROSS JOIN (SELECT job_id FROM {{v_jobs}} WHERE {_CHANGED}) q", f"(SELECT * FROM {{v_jobs}} WHERE {_CHANGED})") + f"SELECT user_id, job_id, verdict, score, {REASONS} AS reasons FROM z")
def _(t):
    changed = t.v_jobs.where(F.expr(f"updated_at >= TIMESTAMP_NTZ '{NOW}' - INTERVAL '30' MINUTE"))
    return M.match_for_jobs(changed, t.dealt("v_profiles", "customer"), t.v_jobs, t.v_orgs, told=M.as_text)


@register("match_for_user", pairs_sql(f"SELECT 7::bigint AS user_id, job_id FROM {{v_jobs}} WHERE {ACTIVE}") + f"SELECT user_id, job_id, verdict, score, {REASONS} AS reasons FROM z")
def _(t):
    return M.match_for_user(7, t.v_profiles, t.dealt("v_jobs"), t.v_orgs, told=M.as_text)
