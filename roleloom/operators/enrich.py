"""Classification and requirement extraction as native columns over a postings table.

The rule tables live in :mod:`roleloom.functions.rules`.  Lower-cased text and
sentence arrays are computed once in their own ``select`` and reused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, text as T
from ..functions.dates import parse_local_date
from ..functions.patterns import group, has, let, once, spell, sub
from ..sources.tables import materialised
from .containment import GRAM, contained_values

c = F.col
Q_NONE = lambda kind: F.lit(None).cast(kind)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _any(col: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [has(col, p) for p in patterns])


def _first_rule(col: Column, rules) -> Column:
    out = None
    for pattern, value in rules:
        hit = has(col, pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


# --- E1–E3 ----------------------------------------------------------------------
def is_tech_job(title: Column, department: Column, text: Column) -> Column:
    """Arguments in lower case and not null."""
    return (F.when(has(title, R.NON_TECH_ENGINEER), False)
            .when(_any(title, R.TECH_TITLE), True)
            .when(has(department, R.TECH_DEPARTMENT), True)
            .when(has(title, R.GENERIC_ENGINEER), True)
            .otherwise(has(title, R.TRAINEE_TITLE) & has(text, R.TRAINEE_TEXT)))


def category_scores(title: Column, department: Column, text: Column) -> Column:
    """array<struct<score, position, category>> of every category with a positive score, best first."""
    body = F.concat(department, F.lit(" "), text)

    def build(s: Column) -> Column:
        scored = []
        for i, (category, title_rules, body_rules) in enumerate(R.CATEGORY_RULES):
            points = reduce(lambda a, b: a + b, [F.when(has(s["t"], p), 10).otherwise(0) for p in title_rules]
                            + [F.when(has(s["b"], p), 1).otherwise(0) for p in body_rules])
            scored.append(F.struct((-points).alias("minus"), F.lit(i).alias("position"), F.lit(category).alias("category")))
        trainee = has(s["t"], R.TRAINEE_TITLE) & (has(s["t"], R.TRAINEE_TECH_HINT) | has(s["d"], R.TRAINEE_TECH_HINT))
        scored.append(F.struct(F.when(trainee, -25).otherwise(0).alias("minus"), F.lit(len(R.CATEGORY_RULES)).alias("position"), F.lit(R.TRAINEE_CATEGORY).alias("category")))
        return F.array_sort(F.filter(F.array(*scored), lambda x: x["minus"] < 0))

    return let(F.struct(title.alias("t"), body.alias("b"), department.alias("d")), build)


def _low(*names: str) -> list[Column]:
    return [F.lower(F.coalesce(c(n), F.lit(""))) for n in names]


@once
def _scores_of(title: str, department: str, text: str) -> Column:
    return category_scores(*_low(title, department, text))


@once
def _relevant(title: str, department: str, text: str) -> Column:
    return is_tech_job(*_low(title, department, text))


def categorize(df: DataFrame, title: str = "title", department: str = "department", text: str = "text", fallback=None) -> DataFrame:
    """Adds ``scores``, ``category`` and ``secondary_categories``.

    ``fallback(title, text) -> Column`` (for example an Arrow UDF) is asked only where no title rule fired.
    """
    scored = df.withColumn("scores", _scores_of(title, department, text))
    best = F.filter("scores", lambda x: x["minus"] <= -10)
    default = F.lit(R.DEFAULT_CATEGORY)
    other = default if fallback is None else F.coalesce(fallback(c(title), c(text)), default)
    out = scored.withColumn("category", F.when(F.size(best) > 0, best[0]["category"]).otherwise(other))
    second = F.filter("scores", lambda x: (x["minus"] <= -2) & (x["category"] != c("category")))
    return out.withColumn("secondary_categories", F.transform(F.slice(second, 1, 3), lambda x: x["category"]))


def detect_level(title: Column) -> Column:
    return let(F.replace(F.lower(title), F.lit("."), F.lit(" ")), lambda t: _first_rule(t, R.LEVEL_RULES))


# --- E4–E9: numbers and flags -----------------------------------------------------
def _number(text: Column, pattern: str, ok) -> Column:
    return let(group(text, pattern).cast("double"), lambda v: F.when(ok(v), v))


def extract_cgpa(text: Column) -> Column:
    return F.coalesce(*[_number(text, p, lambda v: (v > 1.5) & (v <= 4)) for p in R.CGPA])


def extract_ssc_hsc(sents: Column) -> Column:
    """struct<min_ssc, min_hsc, note> of the first sentence that states a school GPA."""
    def one(s: Column) -> Column:
        def read(low: Column) -> Column:
            value = F.coalesce(*[group(low, p) for p in R.SCHOOL_GPA]).cast("double")
            both = has(low, R.SCHOOL_BOTH) | (has(low, r"\bssc\b") & has(low, r"\bhsc\b"))
            return F.when(has(low, R.SCHOOL_EXAM) & (value <= 5), F.struct(
                F.when(both | has(low, r"\bssc\b|\bsecondary\b"), value).alias("min_ssc"),
                F.when(both | has(low, r"\bhsc\b|\bhigher secondary\b"), value).alias("min_hsc"),
                F.substring(s, 1, 200).alias("note")))
        return let(F.lower(s), read)
    return F.try_element_at(F.filter(F.transform(sents, one), lambda x: x.isNotNull()), F.lit(1))


def extract_masters(text: Column) -> Column:
    return _first_rule(text, R.MASTERS)


def extract_third_division(text: Column) -> Column:
    return F.when(_any(text, R.THIRD_DIVISION), True)


def _years(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for w, n in R.NUMBER_WORDS.items() for x in (w, float(n))])
    return F.coalesce(F.try_element_at(table, F.coalesce(word, F.lit(""))), word.try_cast("double"))


def extract_experience(text: Column) -> Column:
    """struct<min, max> in years, from lower-case text."""
    plain = F.regexp_replace(text, "[–—]", "-")

    def whole(t: Column) -> Column:
        fresh = F.struct(F.lit(0.0).alias("min"), group(t, R.FRESHER_RANGE, 2).cast("double").alias("max"))

        def one(s: Column) -> Column:
            low = _years(group(s, R.EXPERIENCE_RANGE, 1))
            least = F.coalesce(*[group(s, p) for p in R.EXPERIENCE_MIN])
            return (F.when(~s.contains("experience"), F.lit(None))
                    .when(has(s, R.EXPERIENCE_RANGE), F.struct(low.alias("min"), group(s, R.EXPERIENCE_RANGE, 2).cast("double").alias("max")))
                    .when(least.isNotNull(), F.struct(_years(least).alias("min"), Q_NONE("double").alias("max"))))
        found = F.try_element_at(F.filter(F.transform(T.sentences(t), one), lambda x: x.isNotNull()), F.lit(1))
        none = F.struct(Q_NONE("double").alias("min"), Q_NONE("double").alias("max"))
        return F.when(has(t, R.FRESHER), fresh).otherwise(F.coalesce(found, none))
    return let(plain, whole)


def extract_age(text: Column) -> Column:
    return F.coalesce(*[_number(text, p, lambda v: v.between(18, 65)) for p in R.AGE]).cast("int")


# --- E10–E13: disciplines and skills -------------------------------------------------
def _named_hits(text: Column, table) -> Column:
    marked = F.array(*[F.when(has(text, p), F.lit(name)) for name, p in table])
    return F.filter(marked, lambda x: x.isNotNull())


def extract_disciplines(sents: Column) -> Column:
    """struct<codes, note> from the education sentences."""
    edu = F.filter(sents, lambda s: has(F.lower(s), R.EDUCATION_SENTENCE))

    def read(e: Column) -> Column:
        low = F.concat(F.lit(" "), F.lower(F.array_join(e, " \n ")), F.lit(" "))

        def codes(t: Column) -> Column:
            hits = _named_hits(t, R.DISCIPLINES)
            return let(hits, lambda h: F.when((F.size(h) > 0) & has(t, R.RELATED_WORDING), F.concat(h, F.array(F.lit("RELATED")))).otherwise(h))
        return F.struct(let(low, codes).alias("codes"), F.substring(F.try_element_at(e, F.lit(1)), 1, 240).alias("note"))
    return let(edu, read)


def canonical_discipline(value: Column) -> Column:
    low = F.lower(value)
    out = F.when(value.isNull() | (value == ""), Q_NONE("string"))
    for code, pattern in R.DISCIPLINES:
        if code != "ANY":
            out = out.when(has(low, pattern), F.lit(code))
    return out.otherwise(F.upper(T.strip(value)))


def detect_skills(text: Column) -> Column:
    """Skill names in dictionary order; ``text`` in lower case."""
    return _named_hits(text, R.SKILLS)


def split_skills(sents: Column) -> Column:
    """struct<required, preferred>: a skill wanted anywhere as required is not preferred."""
    def tag(s: Column) -> Column:
        return let(F.lower(s), lambda low: F.struct(detect_skills(low).alias("skills"), has(low, R.PREFERRED_WORDING).alias("soft")))

    def collect(tagged: Column, soft: bool) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter(tagged, lambda x: x["soft"] == F.lit(soft)), lambda x: x["skills"])))

    def read(tagged: Column) -> Column:
        required, preferred = collect(tagged, False), collect(tagged, True)
        return F.struct(F.array_remove(required, R.GENERIC_SKILL).alias("required"), F.array_except(preferred, required).alias("preferred"))
    return let(F.transform(sents, tag), read)


# --- E14–E20 -----------------------------------------------------------------------
def extract_vacancies(text: Column) -> Column:
    return group(text, R.VACANCIES).cast("int")


def extract_salary(raw: Column) -> Column:
    return T.strip(group(raw, R.SALARY))


def extract_deadline(raw: Column) -> Column:
    return parse_local_date(F.coalesce(*[group(raw, p) for p in R.DEADLINE]))


def extract_location(text: Column) -> Column:
    was, now = R.CITY_ALIAS
    found = F.filter(F.array(*[F.when(text.contains(city.lower()), F.lit(now if city == was else city)) for city in R.CITIES]), lambda x: x.isNotNull())
    return (F.when(text.contains(R.ANYWHERE.lower()), R.ANYWHERE)
            .otherwise(F.nullif(F.array_join(F.array_distinct(found), ", "), F.lit(""))))


def extract_work_mode(text: Column) -> Column:
    return _first_rule(text, R.WORK_MODE_WORDING)


def banking_preferred(text: Column) -> Column:
    return has(text, R.BANKING_PREFERRED)


def requirements_parsed(codes: Column, *values: Column) -> Column:
    return reduce(lambda a, b: a | b, [v.isNotNull() for v in values], F.coalesce(F.size(codes) > 0, F.lit(False)))


@once
def _requirements(raw: str, lowered: str, sentences: str) -> dict[str, Column]:
    r, low, sents = c(raw), c(lowered), c(sentences)
    return {
        "_edu": extract_disciplines(sents), "_school": extract_ssc_hsc(sents), "_exp": extract_experience(low), "_skills": split_skills(sents),
        "min_cgpa": extract_cgpa(low), "masters_required": extract_masters(low), "no_third_division": extract_third_division(low),
        "age_limit": extract_age(low), "banking_experience_preferred": banking_preferred(low), "x_vacancies": extract_vacancies(low),
        "x_salary": extract_salary(r), "x_deadline": extract_deadline(r), "x_location": extract_location(low), "x_work_mode": extract_work_mode(low)}


def extract_requirements(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds one column per requirement; null or empty means "not stated"."""
    base = (df.withColumn("_raw", F.replace(c(text), F.lit("\r"), F.lit("")))
            .withColumn("_low", F.lower("_raw")).withColumn("_sent", T.sentences(c("_raw"))))
    out = base.withColumns(_requirements("_raw", "_low", "_sent"))
    out = out.withColumns({
        "education_disciplines": c("_edu.codes"), "discipline_note": c("_edu.note"), "min_ssc_gpa": c("_school.min_ssc"), "min_hsc_gpa": c("_school.min_hsc"),
        "ssc_hsc_requirement": c("_school.note"), "min_experience_years": c("_exp.min"), "max_experience_years": c("_exp.max"),
        "required_skills": c("_skills.required"), "preferred_skills": c("_skills.preferred")})
    parsed = requirements_parsed(c("education_disciplines"), c("min_cgpa"), c("masters_required"), c("min_experience_years"), c("age_limit"), c("no_third_division"))
    return out.withColumn("requirements_parsed", parsed).drop("_raw", "_low", "_sent", "_edu", "_school", "_exp", "_skills")


# Optional columns of a posting and their types; absent ones are taken as null.
POSTING_COLUMNS = {
    "department": "string", "description": "string", "responsibilities": "array<string>", "location": "string", "work_mode": "string", "employment_type": "string",
    "salary": "string", "vacancies": "int", "published_at": "timestamp_ntz", "deadline": "timestamp_ntz", "application_url": "string", "source_url": "string",
    "source_job_id": "string", "skip_relevance": "boolean", "hint_min_cgpa": "double", "hint_min_experience_years": "double",
    "hint_disciplines": "array<string>", "hint_skills": "array<string>",
}


def complete(postings: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in POSTING_COLUMNS.items() if n not in postings.columns}
    return postings.withColumns(missing) if missing else postings


def enrich(postings: DataFrame, org_slug: str = "org_slug", fallback=None) -> DataFrame:
    """Relevance gate, requirements, category, level, summary, fingerprint and content hash of every posting that passes."""
    p = complete(postings).withColumn("title", T.collapse(c("title"))).withColumn("text", T.html_to_text(F.coalesce("description", F.lit(""))))
    p = p.where(F.coalesce("skip_relevance", F.lit(False)) | _relevant("title", "department", "text"))
    p = extract_requirements(p.withColumn("full_text", F.concat("title", F.lit("\n"), "text")))
    has_hint = lambda n: F.coalesce(F.size(n) > 0, F.lit(False))
    p = p.withColumns({
        "min_cgpa": F.coalesce("hint_min_cgpa", "min_cgpa"),
        "min_experience_years": F.coalesce("hint_min_experience_years", "min_experience_years"),
        "education_disciplines": F.when(has_hint("hint_disciplines"), c("hint_disciplines")).otherwise(c("education_disciplines")),
        "required_skills": F.when(has_hint("hint_skills"), F.array_union("hint_skills", "required_skills")).otherwise(c("required_skills"))})
    p = categorize(p, fallback=fallback)
    body = F.when(F.startswith("text", "title"), T.strip(F.substr("text", F.length("title") + 1))).otherwise(c("text"))
    p = p.withColumn("_body", sub(body, r"\n+", " "))
    title_low = F.lower("title")
    p = p.withColumns({
        "normalized_title": T.normalize_title(c("title")), "level": detect_level(c("title")),
        "summary": F.when(c("_body") == "", F.concat("title", F.lit(R.SUMMARY_FALLBACK))).otherwise(T.truncate_words(c("_body"), R.SUMMARY_CHARS)),
        "responsibilities": F.transform(F.slice(F.coalesce("responsibilities", _empty()), 1, 12), lambda x: T.truncate_words(x, 200)),
        "location": F.coalesce("location", "x_location"), "work_mode": F.coalesce("work_mode", "x_work_mode", F.lit("ONSITE")),
        "employment_type": F.coalesce("employment_type", F.when(has(title_low, R.CONTRACT_TITLE), "CONTRACT").when(has(title_low, R.INTERN_TITLE), "INTERNSHIP").otherwise("FULL_TIME")),
        "salary": F.coalesce("salary", "x_salary"), "vacancies": F.coalesce("vacancies", "x_vacancies"), "deadline": F.coalesce("deadline", "x_deadline")})
    return p.withColumns({
        "fingerprint": T.job_fingerprint(c(org_slug), c("normalized_title"), c("deadline")),
        "content_hash": T.content_hash(c(org_slug), c("title"), c("department"), c("summary"), T.iso_utc(c("deadline"))),
    }).drop("_body", "text", "full_text", "scores", "x_location", "x_work_mode", "x_salary", "x_vacancies", "x_deadline", "skip_relevance", "description",
            "hint_min_cgpa", "hint_min_experience_years", "hint_disciplines", "hint_skills")


# --- E22 -----------------------------------------------------------------------------
def _alias_text(col: Column) -> Column:
    t = F.regexp_replace(sub(F.lower(col), R.ORG_ALIAS_NOISE, ""), r"[^a-z0-9 ]+", " ")
    return T.collapse(t)


def match_aliases(names: DataFrame, orgs: DataFrame) -> DataFrame:
    """(organization_name, alias_org_id, alias_slug): the first organisation, in list order, whose alias occurs in the name.

    Aliases and names are compared as dictionaries, by the rarest gram of each alias.
    """
    aliases = (orgs.select("org_id", "slug", F.explode(F.array("name", "short_name")).alias("a")).where(c("a").isNotNull())
               .select("org_id", "slug", _alias_text(c("a")).alias("alias")).where(F.length("alias") >= GRAM))
    first = aliases.groupBy("alias").agg(F.min(F.struct("org_id", "slug")).alias("o"))
    distinct = names.select("organization_name").where(c("organization_name").isNotNull() & (c("organization_name") != "")).distinct()
    # Read twice, for the grams and for the names, so both dictionaries are written first.
    first, plain = materialised(first), materialised(distinct.withColumn("plain", T.collapse(F.regexp_replace(F.lower("organization_name"), r"[^a-z0-9 ]+", " "))))
    inside = contained_values(first.select(c("alias").alias("value")), plain.select(c("plain").alias("value")))
    best = inside.join(first, c("part") == c("alias")).groupBy("whole").agg(F.min("o").alias("m"))
    return plain.join(best, c("plain") == c("whole")).select("organization_name", c("m.org_id").alias("alias_org_id"), c("m.slug").alias("alias_slug"))


def resolve_organization(postings: DataFrame, orgs: DataFrame) -> DataFrame:
    """Adds ``org_slug`` and ``new_org``: explicit slug, else the source's, else an alias, else a new or the catch-all organisation."""
    # What depends on the name alone is worked out once per name.
    names = postings.select("organization_name").where(c("organization_name").isNotNull() & (c("organization_name") != "")).distinct().withColumn("_name_slug", T.slugify(c("organization_name")))
    p = postings.join(names.join(match_aliases(postings, orgs), "organization_name", "left"), "organization_name", "left")
    wanted = F.coalesce("organization_slug", "source_org_slug", "alias_slug")
    p = p.withColumn("_wanted", wanted).join(orgs.select(c("slug").alias("_known")), c("_wanted") == c("_known"), "left")
    slug = F.coalesce("_known", "_name_slug", F.lit(R.CATCH_ALL_ORG[0]))
    p = p.withColumn("org_slug", slug).join(orgs.select(c("slug").alias("_have")), c("org_slug") == c("_have"), "left")
    return p.withColumn("new_org", c("_have").isNull()).drop("_wanted", "_known", "_have", "_name_slug", "alias_slug", "alias_org_id")


def new_organizations(resolved: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organisations to create: one row per new slug, typed by the source's default."""
    fresh = resolved.where(c("new_org")).join(orgs.select(c("slug").alias("org_slug")), "org_slug", "left_anti")
    catch_all = c("org_slug") == R.CATCH_ALL_ORG[0]
    return fresh.groupBy("org_slug").agg(
        F.min(F.when(catch_all, F.lit(R.CATCH_ALL_ORG[1])).otherwise(c("organization_name"))).alias("name"),
        F.min(F.when(catch_all, F.lit(R.CATCH_ALL_ORG[2])).otherwise(F.coalesce("default_org_type", F.lit("GOVERNMENT")))).alias("type"))
