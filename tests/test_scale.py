"""Plans and evaluation counts that decide whether a query lasts on larger tables."""

import pytest
from pyspark.sql import functions as F

from roleloom.functions import rules as R, text as T
from roleloom.operators import alerts as A, match as M, resolve
from roleloom.plans.core import Tables
from roleloom.plans.registry import QUERIES
from roleloom.sources.tables import spread

SF = "/root/testdata/sf0.001"
c = F.col


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def regexes(df) -> int:
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(text.count(x) for x in ("regexp_replace(", "regexp_extract(", "rlike", "RLIKE"))


def test_rows_of_one_file_are_spread_without_a_setting(spark):
    one = spark.range(1000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" in plan(QUERIES["extract_table_rows"](spark, SF)) and "RoundRobinPartitioning" in plan(QUERIES["enrich"](spark, SF))


def test_url_steps_are_written_once(spark):
    urls = spark.createDataFrame([("u",)], "u string")
    assert regexes(urls.select(T.normalize_url(c("u")))) < 50
    assert regexes(urls.select(T.absolute_url(c("u"), c("u")))) < 150


@pytest.mark.parametrize("url, want", [
    (" \tHTTP://www.Site.example:80/a/./b/../c//?b=2&utm_source=x&A=1#top ﻿", "https://site.example/a/c?a=1&b=2"),
    ("https://user@host.example", "https://host.example/"), ("https://host.example?", "https://host.example/"), ("mailto:x@y", None), ("　", None), (None, None)])
def test_url_forms(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(T.normalize_url(c("u"))).first()[0] == want


def test_titles_expand_in_order(spark):
    rows = [("Sr. Dev & MTO", "senior developer management trainee officer"), ("Information Technology Exec. (ICT)", "it executive it"), ("Devops Sre", "devops sre"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").select("want", T.normalize_title(c("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.parametrize("name", ["elig_age", "elig_masters", "score_org"])
def test_pairs_meet_profiles_and_jobs_without_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF)).split("Exchange", 1)[0]


def test_wide_pairs_are_shuffled_once(spark):
    """Pairs get their match before jobs and preferences make them wide."""
    text = plan(QUERIES["preference_matches"](spark, SF))
    joins = [line for line in text.splitlines() if "Join" in line and ("user_id" in line or "job_id" in line)]
    assert "LeftOuter" in joins[-1] and not any("LeftOuter" in line for line in joins[:-1])


def test_a_batch_looks_for_titles_that_can_decide_only(spark, monkeypatch):
    """Less similar titles and rows without a deadline can't change a parent; undated rows that are as similar still hide later ones."""
    asked, real = [], resolve.similar_titles

    def watched(left, right, threshold=R.REVIEW_SIMILARITY):
        asked.append((left.where("deadline IS NULL").count(), threshold))
        return real(left, right, threshold)
    monkeypatch.setattr(resolve, "similar_titles", watched)
    t, near, far = "senior software engineer platform", "senior software engineer platforms", "software engineer"
    rows = [(1, 1, t, "2024-01-01"), (2, 1, far, "2024-01-01"), (3, 1, near, "2024-01-03"), (4, 2, t, None), (5, 2, near, "2024-01-01"), (6, 2, t, "2024-01-02"), (7, 1, t, "2024-02-01"), (8, 3, t, "2024-01-01"), (9, 1, near, None)]
    df = spark.createDataFrame(rows, "seq long, org_id long, normalized_title string, d string")
    df = df.select("seq", "org_id", "normalized_title", c("d").cast("timestamp_ntz").alias("deadline"), *[F.concat(F.lit(k), "seq").alias(k) for k in resolve.RUNGS])
    assert {r.seq: r.parent for r in resolve.batch_parents(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert asked == [(0, R.AUTO_MERGE_SIMILARITY)]


ALERT_JOBS = "job_id long, org_id long, slug string, title string, category string, secondary_categories array<string>, level string, location string, work_mode string, deadline timestamp_ntz, review_status string, status string"
ALERT_PREFS = "user_id long, categories array<string>, organization_slugs array<string>, org_types array<string>, levels array<string>, locations array<string>, academic_only boolean, min_match_score int, mode string"


def test_alert_pairs_are_not_shuffled(spark):
    """A pair is made once, at the first key that both sides have, and finds its match there: nothing is shuffled behind the join of users and jobs."""
    jobs = spark.createDataFrame([(1, 1, "j1", "Dev", "A", ["B", "C"], None, None, "ONSITE", None, "APPROVED", "NEW"), (2, 1, "j2", "Ops", "D", [], "MID", None, "ONSITE", None, "APPROVED", "NEW")], ALERT_JOBS)
    orgs = spark.createDataFrame([(1, "o", "T", "O", "Org")], "org_id long, slug string, type string, short_name string, name string")
    pref = lambda u, cats, slugs=(), types=(), levels=(), least=0: (u, list(cats), list(slugs), list(types), list(levels), [], True, least, "IMMEDIATE")
    prefs = spark.createDataFrame([pref(1, ["C", "A", "B"], [], ["T", "U"], ["MID", ""]), pref(2, []), pref(3, ["D", "D"]), pref(4, ["A"], ["o", "p"]), pref(5, [], least=50), pref(5, ["B", "C"]), pref(None, [])], ALERT_PREFS)
    matches = spark.createDataFrame([(5, 1, "WEAK", 40), (2, 1, "STRONG", 80), (2, 1, "WEAK", 10), (2, 2, "NOT_ELIGIBLE", 5), (3, 1, "WEAK", 1), (None, 1, "WEAK", 1), (1, 9, "WEAK", 1)], "user_id long, job_id long, verdict string, score int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.notify_new_jobs(jobs, orgs, prefs, matches, "2024-01-01 00:00:00")
        text = plan(out)
        assert "Exchange" not in text[:text.index("SortMergeJoin")] and "Generate" in text[:text.index("SortMergeJoin")]
        got = sorted((r.user_id, r.job_id, r.body.split(".")[0]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = "Complete your profile and we rate your fit"
    fit = lambda v, n: f"Your fit: {R.VERDICT_LABELS[v]} ({n}/100)"
    assert got == sorted([(1, 1, none), (2, 1, fit("STRONG", 80)), (2, 1, fit("WEAK", 10)), (3, 2, none), (4, 1, none), (5, 1, fit("WEAK", 40)), (5, 2, none)])


def test_match_pairs_are_not_shuffled(spark):
    """Candidates and changed jobs meet in their block, are scored there, and members of a class are listed there: nothing is shuffled behind the join, and reasons put as a text need no list."""
    t = Tables(spark, SF)
    some = t.v_profiles.where("user_id between 1 and 5")
    copy = some.where("user_id < 3").crossJoin(spark.range(1, 40).withColumnRenamed("id", "n")).withColumn("user_id", F.when(c("n") > 1, c("user_id") + 1000 * c("n"))).drop("n")
    many, changed = some.unionByName(copy), t.v_jobs.where("job_id < 40").select("job_id")
    out = M.match_for_jobs(changed.unionByName(changed), many, t.v_jobs, t.v_orgs, blocks=4, told=M.as_text)
    text = plan(out)
    assert "Exchange" not in text[:text.index("SortMergeJoin [_b")] and out.schema["reasons"].dataType.simpleString() == "string"
    got = sorted(((r.user_id, r.job_id), r.verdict, r.score, r.reasons) for r in out.na.fill(0, ["user_id"]).collect())
    ids = [r.job_id for r in changed.collect()]
    own = {k: rest for k, *rest in got if k[0] in range(1, 6)}
    assert len(own) == 5 * len(ids) > 0 and all(":" in reasons for _, _, reasons in own.values())
    twins = [((u + 1000 * n, j), *own[u, j]) for u in (1, 2) for n in range(2, 40) for j in ids] + [((0, j), *own[u, j]) for u in (1, 2) for j in ids]
    assert got == sorted([(k, *rest) for k, rest in own.items()] + twins)


def _joins(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_exact_evidence_meets_by_short_keys(spark):
    """URLs, fingerprints and hashes are not shuffled, 128 bits stand for each piece of evidence."""
    row = (1, 1, "u", "u", "f", "h", "k")
    ours = spark.createDataFrame([row], "posting_id bigint, org_id bigint, application_url string, norm_url string, fingerprint string, content_hash string, external_key string")
    theirs = spark.createDataFrame([(*row, None, None)], "job_id bigint, org_id bigint, application_url string, norm_url string, fingerprint string, content_hash string, external_key string, archived_at timestamp_ntz, created_at timestamp_ntz")
    got = resolve.dedupe_exact(ours, theirs, theirs.select("job_id", "external_key"), "2024-01-01 00:00:00")
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1)]
    met = [j for j in _joins(got) if "key#" in j]
    assert met and not any("kind#" in j for j in met) and got.schema["rung"].dataType.simpleString() == "int"
    assert "unhex(md5(" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("common", [3, 1 << 16])
def test_similar_titles_are_all_found_and_meet_as_numbers(spark, monkeypatch, common):
    monkeypatch.setattr(resolve, "_COMMON", common)
    words = ["software", "engineer", "senior", "data", "base", "officer", "it", "a", "aaaa", "aa aa", "naïve"]
    texts = sorted({" ".join(words[(i * k + k * k) % len(words)] for k in range(1, 2 + i % 4)) for i in range(60)} | {"", "x", "it"})
    rows = lambda step: spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts * 2) if i % 4 != step] + [(None, "it"), (1, None)], "org_id bigint, normalized_title string")
    left, right = rows(0), rows(1)
    got = resolve.similar_titles(left, right, 0.6)
    a, b = (d.dropna().distinct().select("org_id", c("normalized_title").alias(n)) for d, n in ((left, "x"), (right, "y")))
    score = F.when(c("x") == c("y"), 1.0).otherwise(F.greatest(T.dice_of(c("x"), c("y"), T.numbered_bigrams(c("x")), T.numbered_bigrams(c("y"))), T.jaccard_of(T.tokens(c("x")), T.tokens(c("y")))))
    want = a.join(b, "org_id").withColumn("s", score).where("s >= 0.6")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    met = [j for j in _joins(got) if "Cross" not in j]
    assert met and not any("title" in j for j in met)


def test_feed_elements_and_titles_are_read_once(spark):
    """Filters on titles don't read the XML of an element again, nor cut the title at each mention."""
    text = QUERIES["feed_to_postings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_xml(") == text.count("Generate explode(array(from_xml(") == 2  # items and entries
    assert text.count("(?i:at)") == 1


def test_single_selectors_look_at_the_element_alone(monkeypatch):
    from roleloom.sources import markup
    page = markup.parse("<table><tr id='r'><td><a href='x'>1</a></td><th>2</th></tr></table><p class='b c'>t</p>")
    monkeypatch.setattr(markup, "_any", None)  # looks at what is above
    assert [[n.tag for n in page.find(s)] for s in ("tr", "a[href]", ".b", "#r", "*")] == [["tr"], ["a"], ["p"], ["tr"], ["table", "tr", "td", "a", "th", "p"]]


def test_rows_of_a_batch_meet_by_short_keys(spark, monkeypatch):
    monkeypatch.setattr(resolve, "materialised", lambda df: df)
    rows = spark.createDataFrame([(1, 1, "a b", None, "k", "u", "f", "h"), (2, 1, "c d", None, "l", "u", "g", "i")], "seq bigint, org_id bigint, normalized_title string, deadline timestamp_ntz, external_key string, norm_url string, fingerprint string, content_hash string")
    got = resolve.batch_parents(rows)
    met = [j for j in _joins(got) if "key#" in j]
    assert met and not any("rung#" in j for j in met)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1)]
