"""Worked examples of the scalar rules and extractors."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roleloom.functions import dates as D, text as T
from roleloom.operators import enrich as E, match as M, resolve as X
from roleloom.sources import feeds as Fe, markup as Mk, registry as Rg


def one(spark, build, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("Sr. Officer (IT)", "senior officer it"), ("Urgent Hiring: Asst. Mgr & Dev", "assistant manager developer"), ("", ""), ("SQA – Engineer", "qa engineer"),
])
def test_normalize_title(spark, text, expected):
    assert one(spark, T.normalize_title, text) == expected


@pytest.mark.parametrize("url,expected", [
    ("http://www.Example.com/Jobs/?utm_source=x&b=2&A=1#top", "https://example.com/Jobs?a=1&b=2"), ("https://example.com", "https://example.com/"),
    ("not a url", None), ("https://example.com/a/../b/?q=a b", "https://example.com/b?q=a%20b"), ("https://example.com:443/x/", "https://example.com/x"),
])
def test_normalize_url(spark, url, expected):
    assert one(spark, T.normalize_url, url) == expected


@pytest.mark.parametrize("href,expected", [
    ("view/1", "https://e.com/a/view/1"), ("../x", "https://e.com/x"), ("//cdn.e.com/y", "https://cdn.e.com/y"), ("?p=2", "https://e.com/a/b.html?p=2"),
    ("javascript:void(0)", None), ("mailto:a@b.c", None), ("#", None), ("", None), ("ftp://e.com/x", None),
])
def test_absolute_url(spark, href, expected):
    assert one(spark, T.absolute_url, href, "https://e.com/a/b.html") == expected


def test_html_to_text_decodes_twice(spark):
    assert one(spark, T.html_to_text, "<p>A&amp;lt;B</p><script>x</p></script><!-- c --><li>two  words</li>") == "A<B\n two words".replace("\n ", "\n")


@pytest.mark.parametrize("a,b,low,high", [("abc", "abc", 1, 1), ("a", "b", 0, 0), ("night", "nacht", 0.25, 0.25), ("aaaa", "aa", 0.5, 0.5)])
def test_dice(spark, a, b, low, high):
    assert low <= one(spark, T.dice_similarity, a, b) <= high


@pytest.mark.parametrize("text,expected", [
    ("15th October, 2026", datetime(2026, 10, 15, 17, 59, 59)), ("05/11/2026", datetime(2026, 11, 5, 17, 59, 59)), ("10-Oct-2026", datetime(2026, 10, 10, 17, 59, 59)),
    ("31/02/2026", None), ("2026-10-15T10:30:00+06:00", datetime(2026, 10, 15, 4, 30)), ("soon", None), ("1.1.1999", None),
])
def test_parse_local_date(spark, text, expected):
    assert one(spark, D.parse_local_date, text) == expected


def test_word_boundary_is_ascii(spark):
    assert one(spark, lambda c: E.is_tech_job(F.lower(c), F.lit(""), F.lit("")), "éit works") is True


def requirements(spark, text):
    return E.extract_requirements(spark.createDataFrame([(text,)], "full_text string")).first()


# A sentence for each rule, and what it says; every test joins some of them.
SAYS = {
    "points": ("Minimum CGPA 2.85.", {"min_cgpa": 2.85}), "span": ("4 to 9 years of experience.", {"min_experience_years": 4.0, "max_experience_years": 9.0}),
    "years": ("At least 12+ years of experience.", {"min_experience_years": 12.0, "max_experience_years": None}), "age": ("Age limit: 27 years.", {"age_limit": 27}),
    "class": ("A third class is not allowed.", {"no_third_division": True}), "hsc": ("GPA 4.25 out of 5 in HSC.", {"min_hsc_gpa": 4.25, "min_ssc_gpa": None}),
    "degree": ("BSc in Statistics or Mathematics.", {"education_disciplines": ["STATISTICS", "MATHEMATICS"]}), "nothing": ("We sell umbrellas.", {}),
}
UNSAID = {"min_cgpa": None, "min_experience_years": None, "max_experience_years": None, "age_limit": None, "no_third_division": None, "min_hsc_gpa": None, "min_ssc_gpa": None, "education_disciplines": []}


JOINED = [("nothing",), ("points",), ("span", "age"), ("years", "class"), ("degree", "hsc", "points"), ("age", "degree", "years"), ("class", "span", "hsc", "nothing"), ("points", "span", "age", "class", "degree", "hsc")]


def test_requirements_are_read_alone_and_together(spark):
    """All texts, forwards and backwards, in one table."""
    kinds = JOINED + [k[::-1] for k in JOINED]
    df = spark.createDataFrame([(i, " ".join(SAYS[k][0] for k in ks)) for i, ks in enumerate(kinds)], "i int, full_text string")
    found = {r.i: r for r in E.extract_requirements(df).collect()}
    for i, ks in enumerate(kinds):
        want = dict(UNSAID)
        for k in ks:
            want |= SAYS[k][1]
        got = found[i]
        assert {k: (sorted(got[k]) if isinstance(got[k], list) else got[k]) for k in want} == {k: sorted(v) if isinstance(v, list) else v for k, v in want.items()}, ks
        assert got.requirements_parsed == any(k not in ("nothing", "hsc") for k in ks)


def test_a_skill_wanted_both_ways_is_required(spark):
    r = requirements(spark, "MongoDB is preferred. Kafka and MongoDB run here. Docker would be preferred too.")
    assert r.required_skills == ["MongoDB", "Kafka"] and r.preferred_skills == ["Docker"] and not r.banking_experience_preferred


@pytest.mark.parametrize("title,category,level", [
    ("Lead Database Administrator", "DATABASE", "LEAD"), ("Junior Network Engineer", "NETWORK", "ENTRY"), ("Chief Information Security Officer", "CYBERSECURITY", "EXECUTIVE"),
])
def test_category_and_level(spark, title, category, level):
    df = spark.createDataFrame([(title, None, "")], "title string, department string, text string")
    r = E.categorize(df).withColumn("level", E.detect_level(F.col("title"))).first()
    assert (r.category, r.level) == (category, level)


def test_robots(spark):
    text = "User-agent: zzbot\nUser-agent: loombot\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /\n"
    rules = Rg.robots_rules(spark.createDataFrame([("h", text)], "host string, body string"))
    policy = spark.createDataFrame([("h", "parse")], "host string, policy string")
    paths = spark.createDataFrame([("h", p) for p in ("/p/x", "/p/ok/1", "/f.pdf", "/f.pdf?x", "/q")], "host string, path string")
    got = {r.path: r.allowed for r in Rg.robots_filter(paths, rules, policy, "LoomBot").collect()}
    assert got == {"/p/x": False, "/p/ok/1": True, "/f.pdf": False, "/f.pdf?x": True, "/q": True}
    other = {r.path: r.allowed for r in Rg.robots_filter(paths, rules, policy, "stranger").collect()}
    assert not any(other.values())


def test_jsonld_nested_and_broken(spark):
    html = ('<script type="application/ld+json">{oops</script><script type="application/ld+json">[{"@graph":[{"@type":"Organization"},{"@graph":[{"@type":["x","jobposting"],"title":"T","baseSalary":"Negotiable"}]}]}]</script>')
    rows = Fe.jsonld_to_postings(Fe.extract_jsonld_postings(spark.createDataFrame([("https://e.com/j", html)], "url string, html string"))).collect()
    assert [(r.title, r.salary, r.application_url) for r in rows] == [("T", "Negotiable", "https://e.com/j")]


def test_selector_subset(spark):
    html = '<div class="card x"><h2>Job A</h2><a href="1">d</a><a href="2">e</a></div><div class="card"><p>no title</p></div><section><b><i>z</i></b></section>'
    items = Mk.extract_list_items(spark.createDataFrame([("https://e.com/", html)], "url string, html string"), "div.card:has(> h2)").collect()
    assert [(i.title, i.link, i.detail_link) for i in items] == [("Job A", "https://e.com/2", "https://e.com/1")]


def test_verdict_order(spark):
    df = spark.createDataFrame([(True, True, False, 90), (False, True, False, 90), (False, False, True, 90), (False, False, False, 70), (False, False, False, 44)], "f boolean, m boolean, c boolean, s int")
    got = [r.v for r in df.select(M.verdict(F.col("f"), F.col("m"), F.col("c"), F.col("s")).alias("v")).collect()]
    assert got == ["NOT_ELIGIBLE", "MANUAL_REVIEW", "POSSIBLE", "STRONG", "WEAK"]


def test_similar_titles_match_brute_force(spark):
    titles = ["senior software engineer", "senior software engineer ii", "software engineer", "java developer", "java developer dhaka", "qa", "qa engineer", "engineer qa", "", "x"]
    rows = spark.createDataFrame([(o, t) for o in (1, 2) for t in titles], "org_id int, normalized_title string")
    got = {(r.org_id, r.left_title, r.right_title) for r in X.similar_titles(rows, rows).collect()}
    pairs = spark.createDataFrame([(a, b) for a in titles for b in titles], "a string, b string")
    want = {(o, r.a, r.b) for r in pairs.where(T.title_similarity_normalized(F.col("a"), F.col("b")) >= 0.75).collect() for o in (1, 2)}
    assert got == want


def test_jsonld_any_depth(spark):
    """Postings six graphs down, wrappers three deep, and thousands of nested arrays."""
    import json
    node = {"@type": "JobPosting", "title": {"name": {"value": {"name": " Deep "}}}, "identifier": {"value": {"value": {"value": 7}}}}
    for _ in range(6):
        node = {"@type": "Thing", "@graph": [[node]]}
    html = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">{"[" * 500}{{"@type":"JobPosting","title":"Flat"}}{"]" * 500}</script>'
    rows = Fe.jsonld_to_postings(Fe.extract_jsonld_postings(spark.createDataFrame([("https://e.com/j", html)], "url string, html string"))).collect()
    assert [(r.title, r.source_job_id) for r in rows] == [("Deep", "7"), ("Flat", None)]


def test_normalize_url_keeps_long_queries(spark):
    a, b = ("https://e.com/p?q=" + "x" * 150_000 + end for end in "12")
    got = [one(spark, T.normalize_url, x) for x in (a, b)]
    assert got[0] == a and got[1] == b


@pytest.mark.parametrize("text,expected", [("Nguyễn ﬁn Ａｂc №5", "nguyen-fin-abc-no5"), ("Çelik & Ñandú", "celik-nandu"), ("Æther ǅ", "ther-dz"), ("", "")])
def test_slugify_any_letter(spark, text, expected):
    assert one(spark, T.slugify, text) == expected


def test_selectors():
    html = ('<div id="m" class="job-card x"><ul><li class="a"><a href="/job/1">J</a></li><li><a href="/x">K</a></li></ul><div class="JobCard"><h3 class="head">T</h3></div></div>'
            '<div><span><h3 class="head">deep</h3></span></div>')
    page = Mk.parse(html)
    tags = lambda sel: [n.attrs.get("class") or n.attrs.get("href") or n.tag for n in page.find(sel)]
    assert tags("[class*='job-card'], [class*='JobCard'], li:has(a[href*='job'])") == ["job-card x", "a", "JobCard"]
    assert tags("#m") == ["job-card x"] and tags("ul > li") == tags("ul li") == ["a", "li"] and tags("div > li") == []
    assert tags("div:has(> h3.head)") == ["JobCard"] and tags('a[href^="/job"]') == ["/job/1"] and tags("div span h3") == ["head"]
    for bad in ("li:first-child", "a + b", "li:has(a", "", "a,,b", "[x"):
        with pytest.raises(ValueError):
            Mk.parse_selector(bad)
    deep = Mk.parse("<div>" * 10_000 + "<li class='job'>y</li>")
    assert deep.text() == "y" and len(deep.find("div li.job")) == 1
