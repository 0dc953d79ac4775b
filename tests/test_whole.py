"""Queries do the whole job they name: nothing of it is described, left out or switched off."""

import datetime

from pyspark.sql import functions as F

from roleloom.operators import resolve

c = F.col
NOW = "2024-06-01 00:00:00"


def _stored(spark):
    """(job_id, org, days old, archived, fingerprint, content hash, URL)."""
    rows = [(i, 1, 10, False, f"f{i}", f"h{i}", f"https://a.example/{i}") for i in range(1, 31)]
    rows += [(40, 2, 10, False, "f1", "h1", "https://b.example/x"), (41, 2, 200, False, "f41", "h41", "https://b.example/x"), (42, 2, 10, True, "f1", "h1", "https://b.example/x"), (43, 3, 10, False, None, None, None)]
    df = spark.createDataFrame(rows, "job_id bigint, org_id bigint, age int, gone boolean, fingerprint string, content_hash string, application_url string")
    at = F.lit(NOW).cast("timestamp_ntz")
    return df.select("*", F.timestamp_add("DAY", -c("age"), at).alias("created_at"), F.when(c("gone"), at).alias("archived_at")).drop("age", "gone")


def test_every_candidate_pair_is_listed(spark):
    stored = _stored(spark)
    links = spark.createDataFrame([(1, "k:1"), (1, "k:2"), (42, "k:1"), (5, "k:1")], "job_id bigint, external_key string")
    ours = [(100 + i, 1, f"n{i}", f"g{i}", None, None, f"k:{i}") for i in range(1, 21)] + [(200, 2, "f1", "h1", "https://b.example/x", "https://b.example/x", None), (201, 9, "none", "none", "HTTPS://b.example/x", "https://b.example/x", None), (None, 3, None, None, "", "", "k:2")]
    incoming = spark.createDataFrame(ours, "posting_id bigint, org_id bigint, fingerprint string, content_hash string, application_url string, norm_url string, external_key string")
    want = {(100 + i, "org", 30, 1, j) for i in range(1, 21) for j in range(1, 31)} | {(101, "key", 2, 1, 1), (101, "key", 2, 1, 5), (102, "key", 1, 1, 1), (None, "key", 1, 1, 1), (None, "org", 1, 43, 43)}
    want |= {(200, kind, 2, 1, j) for kind in ("fingerprint", "hash") for j in (1, 40)} | {(p, "url", 2, 40, j) for p in (200, 201) for j in (40, 41)} | {(200, "org", 1, 40, 40)}
    for cell in (resolve._CELL, 7):  # as one task's work, and dealt over a grid
        got = [(r.posting_id, r.evidence, r.candidates, r.first_job_id, r.job_id) for r in resolve.dup_candidates(incoming, stored, links, NOW, cell).collect()]
        assert len(got) == len(want) and set(got) == want


def test_collection_scores_new_jobs_for_all_candidates(spark, tmp_path, monkeypatch):
    """The registered query takes every step of a tick: each new job has a match for each profile, and alerts tell it."""
    from roleloom.plans.registry import QUERIES
    from roleloom.sources.tables import SCHEMAS
    from roleloom.streaming import jobs as J
    at = datetime.datetime(2024, 1, 3)
    rows = {"customer": [(u, f"c{u}", u % 5, 0.0, "BUILDING") for u in range(40, 44)], "supplier": [(s, f"s{s}", s, 0.0) for s in range(3)], "orders": [(1, 40, "O", 1.0, at, "5-LOW")],
            "lineitem": [(1, 40, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", at, )], "events": [(i, at, i % 3, "purchase", 1.0, "") for i in (4, 6, 8, 10)]}
    for name, some in rows.items():
        spark.createDataFrame(some, SCHEMAS[name]).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept, run = {}, J.collect_pipeline
    monkeypatch.setattr(J, "collect_pipeline", lambda *a, **kw: kept.setdefault("out", run(*a, **kw)))
    QUERIES["collect_pipeline"](spark, str(tmp_path))
    jobs = {r.job_id for r in kept["out"]["jobs"].select("job_id").collect()}
    matches = {(r.user_id, r.job_id): f"{r.score}/100" for r in kept["out"]["matches"].collect()}
    assert jobs and set(matches) == {(u, j) for u in range(40, 44) for j in jobs}
    told = kept["out"]["notifications"].collect()
    assert told and all(matches[r.user_id, r.job_id] in r.body for r in told)
