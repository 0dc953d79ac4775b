"""Robots rules, due sources, validation, registry refresh and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R, text as T
from ..functions.dates import ts_lit
from ..functions.text import iso_utc
from ..operators.search import VISIBLE, active_where, is_indexable

c = F.col


def robots_policy(fetches: DataFrame) -> DataFrame:
    """What a robots answer means: parse it, allow all or disallow all."""
    shell = c("content_type").contains("html") & F.substring(F.lower("body"), 1, 500).rlike("<html|<!doctype")
    ok = (c("status") >= 200) & (c("status") < 300)
    policy = (F.when(c("status").isNull(), "disallow all").when(ok & shell, "allow all").when(ok, "parse")
              .when(c("status").isin(401, 403) | (c("status") >= 500), "disallow all").otherwise("allow all"))
    return fetches.withColumn("policy", policy)


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, agent, grp, allow, pattern, crawl_delay): consecutive user-agent lines share a group of rules."""
    lines = texts.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"#.*", ""))
    cut = F.instr(line, ":")
    parsed = lines.where(cut > 0).select("host", "pos", F.lower(F.trim(F.substr(line, F.lit(1), cut - 1))).alias("field"), F.trim(F.substr(line, cut + 1)).alias("value"))
    w = W.partitionBy("host").orderBy("pos")  # the lines of one robots file
    is_agent = c("field") == "user-agent"
    marked = parsed.withColumn("_new", is_agent & ~F.coalesce(F.lag(is_agent).over(w), F.lit(False)))
    grouped = marked.withColumn("grp", F.sum(c("_new").cast("int")).over(w)).where(c("grp") > 0)
    agents = grouped.where(is_agent).select("host", "grp", F.lower("value").alias("agent"))
    rules = grouped.where(c("field").isin("allow", "disallow") & ~((c("field") == "disallow") & (c("value") == ""))).select(
        "host", "grp", (c("field") == "allow").alias("allow"), c("value").alias("pattern"))
    delays = grouped.where((c("field") == "crawl-delay") & c("value").try_cast("double").isNotNull()).groupBy("host", "grp").agg(F.max_by(c("value").cast("double"), "pos").alias("crawl_delay"))
    return agents.join(rules, ["host", "grp"], "left").join(delays, ["host", "grp"], "left")


def _rule_regex(pattern: Column) -> Column:
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def robots_filter(frontier: DataFrame, rules: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` and ``crawl_delay``: our own agent's groups, else ``*``; the longest pattern wins, allow wins ties."""
    token = F.lit(agent.lower())
    mine = rules.withColumn("specific", (c("agent") != "*") & token.contains(c("agent"))).where(c("specific") | (c("agent") == "*"))
    kind = mine.groupBy("host").agg(F.max("specific").alias("_any"))
    chosen = mine.join(kind, "host").where(c("specific") == c("_any"))
    delay = chosen.where(c("crawl_delay").isNotNull()).groupBy("host").agg(F.min_by("crawl_delay", "grp").alias("crawl_delay"))
    rx = chosen.where(c("pattern").isNotNull()).select("host", "allow", "pattern", _rule_regex(c("pattern")).alias("rx")).distinct()
    # the rule list of a host is one small file; hits are reduced map-side to the winning rule per URL
    hit = frontier.join(rx, "host").where(F.regexp("path", c("rx"))).groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("win"))
    out = frontier.join(policies.select("host", "policy"), "host", "left").join(hit, ["host", "path"], "left").join(delay, "host", "left")
    allowed = F.when(c("policy") == "allow all", True).when(c("policy") == "parse", F.coalesce("win.allow", F.lit(True))).otherwise(False)
    return out.select("host", "path", allowed.alias("allowed"), F.when(c("policy") == "parse", c("crawl_delay")).alias("crawl_delay"))


def due_sources(sources: DataFrame, now, keys: list[str] | None = None, force: bool = False) -> DataFrame:
    auto = sources.where(c("method") != "MANUAL")
    auto = auto.where(c("source_key").isin(keys)) if keys else auto.where("enabled")
    if force or keys:
        return auto
    next_run = c("last_run_at") + F.expr("INTERVAL '1' MINUTE") * c("fetch_interval_minutes")
    return auto.where(c("last_run_at").isNull() | (next_run <= ts_lit(now) + F.expr("INTERVAL '30' SECOND")))


def validate_postings(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``failed_rule``): the first rule a row breaks."""
    def too_long(col, n):
        return F.length(F.trim(col)) > n
    bad_url = lambda col, required: (c(col).isNull() if required else F.lit(False)) | (c(col).isNotNull() & (~F.coalesce(c(col), F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+") | (F.length(col) > 2000)))
    checks = [
        ("source_job_id", too_long("source_job_id", 200)), ("title", c("title").isNull() | (F.length(F.trim("title")) < 3) | too_long("title", 250)),
        ("organization_slug", too_long("organization_slug", 80)), ("organization_name", too_long("organization_name", 200)), ("department", too_long("department", 200)),
        ("description", F.length("description") > 50_000), ("responsibilities", (F.size("responsibilities") > 30) | F.exists("responsibilities", lambda x: F.length(x) > 500)),
        ("location", too_long("location", 200)), ("employment_type", ~c("employment_type").isin(R.EMPLOYMENT_TYPES)), ("work_mode", ~c("work_mode").isin(R.WORK_MODES)),
        ("salary", too_long("salary", 200)), ("vacancies", (c("vacancies") <= 0) | (c("vacancies") > 10_000)), ("application_url", bad_url("application_url", False)), ("source_url", bad_url("source_url", True)),
    ]
    present = [(n, cond) for n, cond in checks if n in postings.columns]
    marked = postings.withColumn("failed_rule", F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in present]))
    return marked.where(c("failed_rule").isNull()).drop("failed_rule"), marked.where(c("failed_rule").isNotNull())


DESCRIPTIVE = ["name", "url", "method", "org_id"]
ADMIN = ["enabled", "fetch_interval_minutes", "last_run_at", "last_success_at", "consecutive_failures"]


def upsert_sources(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Next source table: descriptive columns follow the registry, what administrators and runs set stays."""
    s = sources.select("source_key", *[c(x).alias(f"s_{x}") for x in DESCRIPTIVE + ADMIN], F.lit(True).alias("_s"))
    r = registry.select("source_key", *[c(x).alias(f"r_{x}") for x in DESCRIPTIVE], c("enabled_by_default"), c("default_interval"), F.lit(True).alias("_r"))
    defaults = {"enabled": c("enabled_by_default"), "fetch_interval_minutes": c("default_interval"), "consecutive_failures": F.lit(0)}
    return s.join(r, "source_key", "full_outer").select(
        "source_key", *[F.when(c("_r").isNotNull(), c(f"r_{x}")).otherwise(c(f"s_{x}")).alias(x) for x in DESCRIPTIVE],
        *[F.when(c("_s").isNotNull(), c(f"s_{x}")).otherwise(defaults.get(x, F.lit(None))).alias(x) for x in ADMIN])


def export_sitemap(jobs: DataFrame, orgs: DataFrame, base: str, now=None) -> DataFrame:
    """Static pages, every organisation and the latest jobs (the sitemap's own limit)."""
    spark = jobs.sparkSession
    none = F.lit(None).cast("timestamp_ntz")
    static = spark.createDataFrame([(p,) for p in R.STATIC_PATHS], "path string").select(
        F.concat(F.lit(base), "path").alias("url"), none.alias("last_modified"), F.lit("hourly").alias("freq"), F.when(c("path") == "/", 1.0).otherwise(0.7).alias("priority"))
    o = orgs.select(F.concat(F.lit(base + "/organizations/"), "slug").alias("url"), c("updated_at").alias("last_modified"), F.lit("daily").alias("freq"), F.lit(0.5).alias("priority"))
    j = jobs.where(active_where() & ~c("is_demo")).orderBy(c("updated_at").desc(), c("job_id").desc()).limit(R.SITEMAP_JOBS)
    return static.unionByName(o).unionByName(j.select(F.concat(F.lit(base + "/jobs/"), "slug").alias("url"), c("updated_at").alias("last_modified"), F.lit("daily").alias("freq"), F.lit(0.8).alias("priority")))


def export_job_posting_jsonld(jobs: DataFrame, orgs: DataFrame, base: str, now) -> DataFrame:
    """(slug, json): one schema.org record per indexable job; absent values leave their key out and ``<`` is escaped."""
    j = jobs.where(is_indexable(now)).join(orgs.select("org_id", c("name").alias("org_name"), c("website").alias("org_site")), "org_id")
    kind = lambda name, *fields: F.struct(F.lit(name).alias("@type"), *fields)
    remote = c("work_mode") == "REMOTE"
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), "title",
        F.concat(F.lit("<p>"), F.regexp_replace("summary", "[<>&]", ""), F.lit("</p>")).alias("description"), iso_utc(F.coalesce("published_at", "first_discovered_at")).alias("datePosted"),
        iso_utc(c("deadline")).alias("validThrough"), F.when(c("employment_type") == "CONTRACT", "CONTRACTOR").otherwise(c("employment_type")).alias("employmentType"),
        kind("Organization", c("org_name").alias("name"), c("org_site").alias("sameAs")).alias("hiringOrganization"),
        kind("Place", kind("PostalAddress", F.coalesce("location", F.lit("Dhaka")).alias("addressLocality"), F.lit("BD").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.when(remote, "TELECOMMUTE").alias("jobLocationType"), F.when(remote, kind("Country", F.lit("Bangladesh").alias("name"))).alias("applicantLocationRequirements"),
        F.when(c("source_job_id") != "", kind("PropertyValue", c("org_name").alias("name"), c("source_job_id").alias("value"))).alias("identifier"),
        F.when(c("min_experience_years").isNotNull(), kind("OccupationalExperienceRequirements", F.floor(c("min_experience_years") * 12 + 0.5).alias("monthsOfExperience"))).alias("experienceRequirements"),
        F.nullif(F.array_join("required_skills", ", "), F.lit("")).alias("skills"), F.when(c("vacancies") != 0, c("vacancies")).alias("totalJobOpenings"), F.lit(False).alias("directApply"),
        F.concat(F.lit(base + "/jobs/"), "slug").alias("url"))
    return j.select("slug", F.replace(F.to_json(record), F.lit("<"), F.lit("\\u003c")).alias("json"))
