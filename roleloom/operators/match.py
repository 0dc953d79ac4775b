"""Candidate x job scoring with explained reasons.

Everything is a column over a *pairs* table (user_id, job_id).  Texts are
prepared once per profile and once per job (normalised titles, skills, role
categories), and their distinct values are compared once, dictionary against dictionary
(``crosswalk``); a pair only looks values up in prepared lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, text as T
from ..functions.patterns import once
from ..sources.tables import materialised
from .crosswalk import with_known, with_roles, with_similar_roles
from .enrich import canonical_discipline
from .search import active_where

c = F.col

# Reason texts, our own wording; %s is filled in order.
SAY = {
    "disc_missing": ("info", "Degree subject: the circular states none."),
    "disc_unknown": ("warn", "Add your degree subject so the education rule can be checked."),
    "disc_any": ("pass", "Any degree subject is accepted."),
    "disc_ok": ("pass", "Your %s degree fits the education rule."),
    "disc_related": ("warn", "Your %s degree may count as related; check the circular."),
    "disc_fail": ("fail", "The circular asks for %s, your subject is %s."),
    "cgpa_possible": ("info", "No minimum CGPA is stated, so this stays a possible match."),
    "cgpa_missing": ("info", "No minimum CGPA is stated; check the circular."),
    "cgpa_unknown": ("warn", "CGPA %s is required; add yours."),
    "cgpa_fail": ("fail", "CGPA %s is required, yours is %s."),
    "cgpa_ok": ("pass", "Your CGPA %s reaches the required %s."),
    "masters_ok": ("pass", "You hold the required Master's degree."),
    "masters_fail": ("fail", "A Master's degree is required."),
    "masters_free": ("pass", "A Master's degree is optional."),
    "masters_missing": ("info", "Master's degree: not stated."),
    "school_unknown": ("warn", "%s GPA %s is required; add yours."),
    "school_fail": ("fail", "%s GPA %s is required, yours is %s."),
    "school_ok": ("pass", "Your %s GPA %s reaches the required %s."),
    "third_fail": ("fail", "A third division or class is not accepted."),
    "third_ok": ("pass", "You have no third division or class."),
    "age_unknown": ("warn", "The age limit is %s; add your age."),
    "age_fail": ("fail", "The age limit is %s, you are %s."),
    "age_ok": ("pass", "You are within the age limit of %s."),
    "exp_missing": ("info", "Experience: not stated."),
    "exp_unknown": ("warn", "%s years of experience are required; add yours."),
    "exp_none": ("pass", "No experience is required."),
    "exp_ok": ("pass", "Your %s years of experience reach the required %s."),
    "exp_over": ("warn", "The role aims at up to %s years; you may be over-qualified."),
    "exp_short": ("warn", "You are a little below the required %s years of experience."),
    "exp_fail": ("fail", "%s years of experience are required, you have %s."),
    "skills_hit": ("pass", "Skills you share: %s."),
    "skills_gap": ("warn", "Skills to show or learn: %s."),
    "skills_missing": ("info", "Skills: none stated."),
    "bank_skilled": ("warn", "Your skills fit, but banking experience is preferred."),
    "bank": ("warn", "Banking experience is preferred."),
    "focus": ("warn", "The role lies in %s, away from your %s focus."),
    "role": ("pass", "One of your preferred roles."),
    "remote": ("pass", "Remote work, as you prefer."),
    "anywhere": ("info", "The posting may be anywhere in the country."),
    "elsewhere": ("warn", "%s is not among your preferred places."),
    "unread": ("warn", "The requirements could not be read; please review them yourself."),
}


def say(key: str, *values: Column) -> Column:
    kind, template = SAY[key]
    pieces = template.split("%s")
    text = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        text += [value.cast("string"), F.lit(piece)]
    return F.struct(F.lit(kind).alias("kind"), (F.concat(*text) if len(text) > 1 else text[0]).alias("text"))


def years(n: Column) -> Column:
    tenths = F.floor(n * 10 + 0.5)
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))


def two_places(n: Column) -> Column:
    cents = F.floor(n * 100 + 0.5)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    return with_roles(profiles, "preferred_roles").select(
        "user_id", canonical_discipline(c("discipline")).alias("p_code"), "has_masters",
        F.when(c("cgpa_scale") == 5, c("bachelor_cgpa") * 4 / 5).otherwise(c("bachelor_cgpa")).alias("p_cgpa"),
        c("ssc_gpa").alias("p_ssc"), c("hsc_gpa").alias("p_hsc"), "has_third_division", c("experience_years").alias("p_exp"), "banking_experience",
        F.transform("skills", T.norm_skill).alias("p_skills"), "primary_focus",
        (F.size("preferred_roles") == 0).alias("p_no_roles"), "p_roles", "p_role_categories",
        "preferred_org_slugs", F.transform("preferred_locations", F.lower).alias("p_locations"), "open_to_remote", c("age").alias("p_age"))


def prepare_jobs(jobs: DataFrame, orgs: DataFrame) -> DataFrame:
    skill = lambda s: F.struct(s.alias("name"), T.norm_skill(s).alias("norm"))
    j = jobs.join(orgs.select("org_id", c("slug").alias("org_slug")), "org_id")
    return j.select(
        "job_id", T.normalize_title(c("title")).alias("j_title"), "category", "secondary_categories", "org_slug", "education_disciplines", "min_cgpa", "min_ssc_gpa",
        "min_hsc_gpa", "masters_required", "no_third_division", "min_experience_years", "max_experience_years", "age_limit", "banking_experience_preferred",
        F.transform("required_skills", skill).alias("j_required"), F.transform("preferred_skills", skill).alias("j_preferred"), "location", "work_mode", "requirements_parsed")


#: Similarities of a title with a preferred role that earn points.
ROLE_LEVELS = {"roles_close": 0.6, "roles_near": 0.4}


def sides(profiles: DataFrame, jobs: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All prepared profiles with ``p_known``, and all prepared jobs with ``roles_close`` and ``roles_near``."""
    p, j = materialised(prepare_profiles(profiles)), materialised(prepare_jobs(jobs, orgs))
    stated = j.select(F.explode(F.concat("j_required", "j_preferred")).alias("s")).select(c("s.norm").alias("value")).distinct()
    roles = p.select(F.explode("p_roles").alias("value")).distinct()
    return with_known(p, "p_skills", stated, "p_known"), with_similar_roles(j, "j_title", roles, ROLE_LEVELS)


def join_pairs(pairs: DataFrame, profiles: DataFrame, jobs: DataFrame, orgs: DataFrame, how: str | None = "merge") -> DataFrame:
    """Every pair with its prepared profile and job: ``p_known`` holds the stated skills that the candidate's stand for, ``roles_close`` and ``roles_near`` the roles that the title resembles.

    Profiles and jobs meet their pairs by ``how``, a join hint.  A rule that reads one small column leaves files of a few MB, which Spark would send whole through the driver, whatever
    number of rows they hold; callers whose pairs share one side leave the choice to Spark (None).
    """
    known, similar = sides(profiles, jobs, orgs)
    if how:
        known, similar = known.hint(how), similar.hint(how)
    return pairs.join(known, "user_id").join(similar, "job_id")


class Part:
    """One rule: its reasons in order, whether it fails, needs a manual look, caps the verdict or misses critical data, and its points."""

    def __init__(self, reasons, fail=None, manual=None, cap=None, missing=None, points=None):
        no = F.lit(False)
        self.reasons = reasons
        self.fail, self.manual, self.cap, self.missing = (F.coalesce(x, no) if x is not None else no for x in (fail, manual, cap, missing))
        self.points = points


def elig_discipline() -> Part:
    codes = F.array_remove("education_disciplines", "RELATED")
    mine = c("p_code")
    table = F.create_map(*[x for k, v in R.DISCIPLINE_EQUIVALENTS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    accepted = F.coalesce(F.try_element_at(table, F.coalesce(mine, F.lit(""))), F.array(mine))
    tech = F.array(*[F.lit(t) for t in R.TECH_DISCIPLINES])
    missing = F.size(codes) == 0
    unknown = ~missing & mine.isNull()
    stated = ~missing & mine.isNotNull()
    anyone = stated & F.array_contains(codes, "ANY")
    fits = stated & ~anyone & F.arrays_overlap(codes, accepted)
    related = stated & ~anyone & ~fits & F.array_contains("education_disciplines", "RELATED") & F.array_contains(tech, mine) & F.arrays_overlap(codes, tech)
    fail = stated & ~anyone & ~fits & ~related
    reason = (F.when(missing, say("disc_missing")).when(unknown, say("disc_unknown")).when(anyone, say("disc_any")).when(fits, say("disc_ok", mine))
              .when(related, say("disc_related", mine)).otherwise(say("disc_fail", F.array_join(codes, "/"), mine)))
    return Part([reason], fail=fail, manual=unknown, cap=related, missing=missing)


def _at_least(need: Column, mine: Column, unknown: Column, short: Column, enough: Column, absent=None) -> tuple[Column, Column, Column]:
    """(reason, fail, manual) of "mine must reach need"; the tolerance absorbs binary fractions."""
    fail = mine + 1e-9 < need
    reason = F.when(need.isNull(), absent if absent is not None else F.lit(None)).when(mine.isNull(), unknown).when(fail, short).otherwise(enough)
    return reason, need.isNotNull() & fail, need.isNotNull() & mine.isNull()


def elig_cgpa(possible: Column | None = None) -> Part:
    need, mine = c("min_cgpa"), c("p_cgpa")
    absent = say("cgpa_missing") if possible is None else F.when(possible, say("cgpa_possible")).otherwise(say("cgpa_missing"))
    reason, fail, manual = _at_least(need, mine, say("cgpa_unknown", two_places(need)), say("cgpa_fail", two_places(need), two_places(mine)),
                                     say("cgpa_ok", two_places(mine), two_places(need)), absent)
    return Part([reason], fail=fail, manual=manual, missing=need.isNull())


def elig_masters() -> Part:
    need = c("masters_required")
    reason = (F.when(need & c("has_masters"), say("masters_ok")).when(need, say("masters_fail")).when(~need, say("masters_free")).otherwise(say("masters_missing")))
    return Part([reason], fail=need & ~c("has_masters"))


def elig_ssc_hsc() -> Part:
    reasons, fails, manuals = [], [], []
    for label, need, mine in (("SSC", c("min_ssc_gpa"), c("p_ssc")), ("HSC", c("min_hsc_gpa"), c("p_hsc"))):
        n = F.lit(label)
        r, f, m = _at_least(need, mine, say("school_unknown", n, two_places(need)), say("school_fail", n, two_places(need), two_places(mine)),
                            say("school_ok", n, two_places(mine), two_places(need)))
        reasons, fails, manuals = reasons + [r], fails + [F.coalesce(f, F.lit(False))], manuals + [m]
    return Part(reasons, fail=fails[0] | fails[1], manual=manuals[0] | manuals[1])


def elig_third_class() -> Part:
    third = c("has_third_division") | F.coalesce(c("p_cgpa") < R.THIRD_CLASS_CGPA, F.lit(False))
    rule = F.coalesce(c("no_third_division"), F.lit(False))
    return Part([F.when(rule & third, say("third_fail")).when(rule, say("third_ok"))], fail=rule & third)


def elig_age() -> Part:
    limit, mine = c("age_limit"), c("p_age")
    reason = (F.when(limit.isNull(), F.lit(None)).when(mine.isNull(), say("age_unknown", limit)).when(mine > limit, say("age_fail", limit, mine))
              .otherwise(say("age_ok", limit)))
    return Part([reason], fail=mine > limit, manual=limit.isNotNull() & mine.isNull())


def elig_experience() -> Part:
    need, most, mine = c("min_experience_years"), c("max_experience_years"), c("p_exp")
    shown = F.when((mine >= 1) & (mine != F.floor(mine)), F.concat(F.floor(mine).cast("string"), F.lit("+"))).otherwise(years(mine))
    meets, close = mine >= need, need - mine <= 1
    over = meets & (mine > most + 2)
    reason = (F.when(need.isNull(), say("exp_missing")).when(mine.isNull(), say("exp_unknown", years(need)))
              .when(meets & (need == 0), say("exp_none")).when(meets, say("exp_ok", shown, years(need)))
              .when(close, say("exp_short", years(need))).otherwise(say("exp_fail", years(need), years(mine))))
    points = (F.when(need.isNull(), 8.0).when(mine.isNull(), 0.0).when(over, 8.0).when(meets, 15.0).when(close, 6.0).otherwise(0.0))
    known = need.isNotNull() & mine.isNotNull()
    return Part([reason, F.when(over, say("exp_over", years(most)))], fail=known & ~meets & ~close, manual=need.isNotNull() & mine.isNull(),
                cap=known & ~meets & close, missing=need.isNull(), points=points)


def with_skill_hits(pairs: DataFrame) -> DataFrame:
    """Adds the stated skills a candidate has: ``hit_required`` and ``hit_preferred``."""
    def hits(col: str) -> Column:
        return F.transform(F.filter(col, lambda s: F.array_contains("p_known", s["norm"])), lambda s: s["name"])
    return pairs.withColumns({"hit_required": hits("j_required"), "hit_preferred": hits("j_preferred")})


def score_skills() -> Part:
    nr, np_ = F.size("j_required"), F.size("j_preferred")
    req, pref = F.size("hit_required") / nr, F.size("hit_preferred") / np_
    points = (F.when((nr == 0) & (np_ == 0), 17.0).when((nr > 0) & (np_ > 0), req * 28 + pref * 7).when(nr > 0, req * 35).otherwise(pref * 35))
    shared = F.concat("hit_required", "hit_preferred")
    gap = F.filter(F.transform("j_required", lambda s: s["name"]), lambda n: ~F.array_contains("hit_required", n))
    return Part([F.when(F.size(shared) > 0, say("skills_hit", F.array_join(F.slice(shared, 1, 6), ", "))),
                 F.when(F.size(gap) > 0, say("skills_gap", F.array_join(F.slice(gap, 1, 5), ", "))),
                 F.when((nr == 0) & (np_ == 0), say("skills_missing"))], points=points)


def warn_banking() -> Part:
    wanted = c("banking_experience_preferred") & ~c("banking_experience")
    skilled = (F.size("hit_required") > 0) | (F.size("hit_preferred") > 0)
    return Part([F.when(wanted & skilled, say("bank_skilled")).when(wanted, say("bank"))])


def score_category() -> Part:
    fit, conflict = F.lit(False), F.lit(False)
    for focus, lists in R.FOCUS.items():
        here = F.coalesce(c("primary_focus") == focus, F.lit(False))
        fit = fit | (here & c("category").isin(lists["fit"]))
        conflict = conflict | (here & c("category").isin(lists["conflict"]))
    points = F.when(fit, 15.0).when(conflict, 0.0).otherwise(8.0)
    label = F.lower(F.replace("category", F.lit("_"), F.lit(" ")))
    return Part([F.when(conflict, say("focus", label, c("primary_focus")))], points=points)


def score_role() -> Part:
    none = c("p_no_roles")
    close, near = (F.coalesce(F.arrays_overlap("p_roles", x), F.lit(False)) for x in ROLE_LEVELS)
    hit = F.array_contains("p_role_categories", c("category")) | F.arrays_overlap("p_role_categories", "secondary_categories")
    points = F.when(none, 10.0).when(close, 20.0).when(hit, 14.0).when(near, 8.0).otherwise(0.0)
    return Part([F.when(~none & (close | hit), say("role"))], points=points)


def score_location() -> Part:
    remote = (c("work_mode") == "REMOTE") & c("open_to_remote")
    loc = F.lower("location")
    stated = F.coalesce(c("location") != "", F.lit(False))
    liked = stated & F.exists("p_locations", lambda p: loc.contains(p))
    anywhere = stated & loc.contains("anywhere")
    picky = F.size("p_locations") > 0
    points = F.when(remote, 10.0).when(~stated, 5.0).when(liked, 10.0).when(anywhere, 5.0).when(picky, 0.0).otherwise(5.0)
    reason = (F.when(remote, say("remote")).when(~stated | liked, F.lit(None)).when(anywhere, say("anywhere")).when(picky, say("elsewhere", c("location"))))
    return Part([reason], points=points)


def score_org() -> Part:
    listed = c("preferred_org_slugs")
    return Part([], points=F.when(F.size(listed) == 0, 3.0).when(F.array_contains(listed, c("org_slug")), 5.0).otherwise(0.0))


def unread() -> Part:
    bad = ~c("requirements_parsed")
    return Part([F.when(bad, say("unread"))], manual=bad)


def match_score(*parts: Part) -> Column:
    total = reduce(lambda a, b: a + b, [p.points for p in parts if p.points is not None])
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)) + 0.5).cast("int")


def verdict(fail: Column, manual: Column, cap: Column, score: Column) -> Column:
    return (F.when(fail, "NOT_ELIGIBLE").when(manual, "MANUAL_REVIEW").when((score >= 70) & ~cap, "STRONG").when(score >= 45, "POSSIBLE").otherwise("WEAK"))


def prepare(pairs: DataFrame, profiles: DataFrame, jobs: DataFrame, orgs: DataFrame, how: str | None = "merge") -> DataFrame:
    return with_skill_hits(join_pairs(pairs, profiles, jobs, orgs, how))


def as_list(reasons: list[Column]) -> Column:
    """The reasons that apply, in order: array of (kind, text)."""
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def as_text(reasons: list[Column]) -> Column:
    """The reasons that apply, in order, as one text ``kind:text|kind:text``; Spark compiles it, while it interprets a lambda over a list and all that the list is made of."""
    return F.concat_ws("|", *[F.concat(r["kind"], F.lit(":"), r["text"]) for r in reasons])


def scored(prepared: DataFrame, told=as_list) -> DataFrame:
    """Adds ``verdict``, ``score`` and ``reasons``, put together by ``told``, to prepared pairs."""
    flags, verdicts, reasons = _rules()
    return prepared.withColumns(flags).withColumn("verdict", verdicts).withColumn("reasons", told(reasons))


def match(pairs: DataFrame, profiles: DataFrame, jobs: DataFrame, orgs: DataFrame, how: str | None = "merge", told=as_list) -> DataFrame:
    """(user_id, job_id, verdict, score, reasons) of every given pair."""
    return scored(prepare(pairs, profiles, jobs, orgs, how), told).select("user_id", "job_id", "verdict", "score", "reasons")


@once
def _rules() -> tuple[dict[str, Column], Column, list[Column]]:
    """All rules over a prepared pair: (score and flags, verdict, reasons)."""
    before = [elig_discipline()]
    cgpa = elig_cgpa()
    after = [elig_masters(), elig_ssc_hsc(), elig_third_class(), elig_age(), elig_experience(), score_skills(), warn_banking(), score_category(),
             score_role(), score_location(), score_org(), unread()]
    every = before + [cgpa] + after
    any_of = lambda name: reduce(lambda a, b: a | b, [getattr(x, name) for x in every])
    gaps = reduce(lambda a, b: a + b, [x.missing.cast("int") for x in every])
    flags = {"score": match_score(*every), "_fail": any_of("fail"), "_manual": any_of("manual"), "_cap": any_of("cap") | (gaps >= 2)}
    listed = [r for x in before + [elig_cgpa(c("verdict") == "POSSIBLE")] + after for r in x.reasons]
    return flags, verdict(c("_fail"), c("_manual"), c("_cap"), c("score")), listed


def match_for_user(user_id, profiles: DataFrame, jobs: DataFrame, orgs: DataFrame, told=as_list) -> DataFrame:
    """One candidate against every active, approved job: linear in the jobs."""
    live = jobs.where(active_where())
    return match(live.select(F.lit(user_id).cast(profiles.schema["user_id"].dataType).alias("user_id"), "job_id"), profiles.where(c("user_id") == user_id), live, orgs, None, told)


#: Profile fields that the rules read; candidates who agree in all of them get the same result for every job.
SCORED_FIELDS = ["discipline", "has_masters", "bachelor_cgpa", "cgpa_scale", "ssc_gpa", "hsc_gpa", "has_third_division", "experience_years", "banking_experience", "skills", "primary_focus", "preferred_roles",
                 "preferred_org_slugs", "preferred_locations", "open_to_remote", "age"]


def profile_classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one profile for each different set of scored fields, that of the smallest user_id, and (class_id, user_id) of every candidate.

    Sets of fields are compared by a 256-bit digest; classes are combined before the shuffle, so one that holds most candidates costs no more than others.
    """
    keyed = profiles.select("user_id", *SCORED_FIELDS).withColumn("_key", F.sha2(F.to_json(F.struct(*SCORED_FIELDS)), 256))
    classes = keyed.groupBy("_key").agg(F.min_by(F.struct("user_id", *SCORED_FIELDS), "user_id").alias("r")).select("_key", "r.*")
    members = keyed.select("_key", "user_id").join(classes.select("_key", c("user_id").alias("class_id")), "_key").select("class_id", "user_id")
    return classes.drop("_key"), members


def match_for_jobs(changed: DataFrame, profiles: DataFrame, jobs: DataFrame, orgs: DataFrame, blocks: int = 64, told=as_list) -> DataFrame:
    """The changed jobs of one tick, ``changed(job_id)``, against every candidate.

    The result has (candidates x changed jobs) rows by definition.  Candidates are dealt into blocks and every prepared job is sent to each block,
    so pairs are made and scored in the task of their block and never shuffled; those of one class and block are scored once for a job, and listed last.
    """
    classes, members = profile_classes(profiles)
    classes = materialised(classes)
    asked = changed.select("job_id").distinct()
    known, similar = sides(classes, jobs.join(asked, "job_id", "left_semi"), orgs)
    lists = members.groupBy(c("class_id").alias("user_id"), F.pmod(F.xxhash64("user_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("user_id")).alias("_members"))
    dealt = classes.select("user_id").join(known, "user_id").join(lists, "user_id").drop("user_id")
    sent = similar.join(asked, "job_id").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = with_skill_hits(dealt.repartition(blocks, "_b").hint("merge").join(sent.repartition(blocks, "_b"), "_b"))
    return scored(pairs, told).select(F.inline("_members").alias("user_id"), "job_id", "verdict", "score", "reasons")
