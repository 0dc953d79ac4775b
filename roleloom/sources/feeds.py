"""Feed items, read with Spark's own XML functions, and JSON-LD postings, whose nesting has no limit and is walked with a stack."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, text as T
from ..functions.dates import parse_local_date

c = F.col
_RSS = "title string, link string, guid string, description string, `content:encoded` string, pubDate string, category array<string>"
_ATOM = ("title string, link array<struct<_href string, _rel string>>, id string, summary string, content string, published string, updated string, "
         "category array<struct<_term string>>")


def parse_feed(feeds: DataFrame) -> DataFrame:
    """(feed_url, title, link, guid, description, published, categories) of RSS items and Atom entries; blank titles dropped."""
    # Each text is cut once; an element belongs to the format whose tag it opens.
    cut = feeds.select(c("url").alias("feed_url"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<(item|entry)[\s>].*?</\2>)"), 1)).alias("x"))

    def elements(tag: str, schema: str) -> DataFrame:
        # Filters on what is read would be pushed below and read the XML again for each mention; an explode holds them up.
        read = cut.where(c("x").startswith(f"<{tag}")).select("feed_url", F.explode(F.array(F.from_xml("x", schema, {"rowTag": tag, "mode": "PERMISSIVE", "valueTag": "_text"}))).alias("e"))
        return read.select("feed_url", "e", F.explode(F.array(T.clean_text(c("e.title")))).alias("title")).where(c("title") != "")
    none = F.array().cast("array<string>")
    blank = lambda x: F.nullif(T.clean_text(x), F.lit(""))
    rss = elements("item", _RSS).select("feed_url", "title", T.absolute_url(T.clean_text(c("e.link")), c("feed_url")).alias("link"), blank(c("e.guid")).alias("guid"),
                                        F.coalesce(F.nullif(c("e.description"), F.lit("")), c("e.`content:encoded`"), F.lit("")).alias("description"), blank(c("e.pubDate")).alias("published"),
                                        F.coalesce(F.transform("e.category", T.clean_text), none).alias("categories"))
    alternate = F.filter("e.link", lambda x: x["_rel"] == "alternate")
    href = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(c("e.link"), F.lit(0))["_href"])
    atom = elements("entry", _ATOM).select("feed_url", "title", T.absolute_url(href, c("feed_url")).alias("link"), blank(c("e.id")).alias("guid"),
                                           F.coalesce(F.nullif(c("e.summary"), F.lit("")), c("e.content"), F.lit("")).alias("description"), blank(F.coalesce("e.published", "e.updated")).alias("published"),
                                           F.coalesce(F.transform("e.category", lambda x: F.coalesce(x["_term"], F.lit(""))), none).alias("categories"))
    return rss.unionByName(atom)


def title_filter(items: DataFrame, pattern: str | None) -> DataFrame:
    return items.where(c("title").rlike(f"(?iu){pattern}")) if pattern else items


_RFC822 = "d MMM yyyy HH:mm:ss"


def feed_to_postings(items: DataFrame, organization_slug: str | None = None) -> DataFrame:
    """Notices dropped; without a fixed organisation the last part of a split title names the employer."""
    # Cut once a title: an explode keeps the parts from being worked out again at each mention.
    items = items.where(~T.is_non_job_notice(c("title"))).withColumn("_parts", F.explode(F.array(F.split("title", r"\s+[-–—|]\s+|\s+(?i:at)\s+"))))
    parts = c("_parts")
    split = F.lit(organization_slug is None) & (F.size(parts) > 1)
    title = F.when(split, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - ")).otherwise(c("title"))
    stamp = F.regexp_extract("published", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    published = F.coalesce(parse_local_date(c("published")), F.try_to_timestamp(stamp, F.lit(_RFC822)).cast("timestamp_ntz"))
    return items.select(
        c("guid").alias("source_job_id"), title.alias("title"), F.lit(organization_slug).cast("string").alias("organization_slug"), F.when(split, F.element_at(parts, -1)).alias("organization_name"),
        F.get("categories", F.lit(0)).alias("department"), F.concat(title, F.lit("\n"), T.html_to_text(c("description"))).alias("description"), published.alias("published_at"),
        F.lit(None).cast("timestamp_ntz").alias("deadline"), c("link").alias("application_url"), F.coalesce("link", "feed_url").alias("source_url"))


# --- JSON-LD -----------------------------------------------------------------------------
def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


# Texts of a posting that may stand inside {name} or {value} wrappers, at any depth.
_TEXTS = {name: (name,) for name in ("title", "description", "qualifications", "skills", "occupationalCategory", "industry", "jobLocationType", "datePosted", "validThrough", "url")} | {
    "identifier": ("identifier", "value"), "employer": ("hiringOrganization", "name"), "currency": ("baseSalary", "currency"), "unit": ("baseSalary", "value", "unitText"), "amount": ("baseSalary", "value", "value")}


def _text(value) -> str | None:
    """A text or number as trimmed text; an object stands for its ``name`` or, without one, its ``value``."""
    while isinstance(value, dict) and ("name" in value or "value" in value):
        value = value["name"] if "name" in value else value["value"]
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(int(value)) if float(value).is_integer() else repr(value)
    return None


def _at(value, path: tuple[str, ...]):
    for step in path:
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def _postings(html: str | None) -> list[tuple]:
    """(posting, texts, places, education) of every JobPosting of a page, in page order; arrays and ``@graph`` are followed all the way, with a stack."""
    found = []
    for block in _BLOCK.findall(html or ""):
        try:
            stack = [json.loads(block)]
        except (ValueError, RecursionError):
            continue  # a malformed block says nothing
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(reversed(node))
            elif isinstance(node, dict):
                if any(str(k).lower() == "jobposting" for k in _listed(node.get("@type"))):
                    places = [", ".join(filter(None, (_text(_at(x, ("address", "addressLocality"))), _text(_at(x, ("address", "addressRegion")))))) for x in _listed(node.get("jobLocation"))]
                    own = {k: v for k, v in node.items() if k != "@graph"}
                    found.append((json.dumps(own, ensure_ascii=False), {k: _text(_at(node, path)) for k, path in _TEXTS.items()}, places, [x for x in map(_text, _listed(node.get("educationRequirements"))) if x]))
                if node.get("@graph"):
                    stack.append(node["@graph"])
    return found


_BLOCK = re.compile(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)


def extract_jsonld_postings(pages: DataFrame) -> DataFrame:
    """(page_url, posting variant, texts, places, education) of every JobPosting node, however deep in arrays and ``@graph``."""
    def run(batches):
        for pdf in batches:
            out = [(url, *p) for url, html in zip(pdf["url"], pdf["html"]) for p in _postings(html)]
            yield pd.DataFrame(out, columns=["page_url", "posting", "texts", "places", "education"])
    rows = pages.select("url", "html").mapInPandas(run, "page_url string, posting string, texts map<string,string>, places array<string>, education array<string>")
    return rows.withColumn("posting", F.try_parse_json("posting"))


def _plain(v: Column) -> Column:
    """A text or number as trimmed text, null for objects, arrays and blanks."""
    scalar = ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)")
    return F.when(scalar, F.nullif(T.strip(v.cast("string")), F.lit("")))


def _amount(n: Column) -> Column:
    return F.regexp_replace(F.format_number(n, 3), r"\.?0+\z", "")


def jsonld_to_postings(raw: DataFrame, organization_slug: str | None = None) -> DataFrame:
    p = c("posting")
    field = lambda name: c("texts")[name]
    many = lambda name: F.coalesce(_get(p, f"$.{name}", "array<variant>"), F.array(_get(p, f"$.{name}")))
    education = F.concat_ws("; ", "education")
    months = _get(p, "$.experienceRequirements.monthsOfExperience", "double")
    code = F.upper(_plain(F.get(many("employmentType"), F.lit(0))))
    employment = F.create_map(*[F.lit(x) for kv in R.EMPLOYMENT_CODES.items() for x in kv])
    pay = _get(p, "$.baseSalary")
    low, high = _get(pay, "$.value.minValue", "double"), _get(pay, "$.value.maxValue", "double")
    flat = _get(pay, "$.value", "double")
    amount = F.when((low != 0) & (high != 0), F.concat(_amount(low), F.lit("–"), _amount(high))).otherwise(F.coalesce(_amount(F.coalesce(low, high)), field("amount")))
    currency = F.coalesce(field("currency"), F.lit("BDT"))
    unit = F.coalesce(F.concat(F.lit(" per "), F.lower(field("unit"))), F.lit(""))
    salary = F.coalesce(_plain(pay), F.concat(currency, F.lit(" "), _amount(flat)), F.concat(currency, F.lit(" "), amount, unit))
    text = T.html_to_text(F.coalesce(field("description"), F.lit("")))
    lines = F.concat_ws("\n", F.nullif(text, F.lit("")), F.when(education != "", F.concat(F.lit("Education: "), education)), field("qualifications"), field("skills"))
    return raw.where(field("title").isNotNull()).select(
        F.coalesce(_plain(_get(p, "$.identifier")), field("identifier")).alias("source_job_id"), field("title").alias("title"), F.lit(organization_slug).cast("string").alias("organization_slug"),
        field("employer").alias("organization_name"), F.coalesce(field("occupationalCategory"), field("industry")).alias("department"), lines.alias("description"),
        F.nullif(F.array_join(F.filter("places", lambda x: x != ""), " / "), F.lit("")).alias("location"), F.when(F.upper(field("jobLocationType")) == "TELECOMMUTE", "REMOTE").alias("work_mode"),
        F.try_element_at(employment, F.coalesce(code, F.lit(""))).alias("employment_type"), salary.alias("salary"), _get(p, "$.totalJobOpenings", "int").alias("vacancies"),
        parse_local_date(field("datePosted")).alias("published_at"), parse_local_date(field("validThrough")).alias("deadline"),
        T.absolute_url(F.coalesce(field("url"), c("page_url")), c("page_url")).alias("application_url"), c("page_url").alias("source_url"),
        (F.floor(months / 12 * 10 + 0.5) / 10).alias("hint_min_experience_years"))
