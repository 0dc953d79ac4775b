"""Invariants and sequential replays on small data."""

from pyspark.sql import functions as F

from roleloom.operators import resolve as X
from roleloom.plans import q_resolution as Q
from roleloom.plans.registry import QUERIES, Tables
from roleloom.streaming.state import rate_limit_windows

SF = "/root/testdata/sf0.001"


def test_rate_limit_matches_sequential_replay(spark):
    hits = Tables(spark, SF).v_hits
    got = {r.event_id: (r["count"], r.ok) for r in rate_limit_windows(hits, 3, 86_400).collect()}
    want, state = {}, {}
    for r in sorted(hits.collect(), key=lambda r: (r.ts, r.event_id)):
        start, n = state.get(r.key, (None, 0))
        if start is None or (r.ts - start).total_seconds() >= 86_400:
            start, n = r.ts, 0
        state[r.key] = (start, n + 1)
        want[r.event_id] = (n + 1, n + 1 <= 3)
    assert got == want


def test_batch_roots_are_a_partition(spark):
    rows = QUERIES["resolve_batch"](spark, SF).collect()
    roots = {r.seq: r.root for r in rows}
    assert all(roots[root] == root for root in set(roots.values()))
    assert all(root <= seq for seq, root in roots.items())


def test_pointer_chain_of_one_key(spark):
    rows = spark.createDataFrame([(i, 1, f"t{i % 3}", None, f"k{i}", None, "same" if i % 2 else f"f{i}", f"h{i}") for i in range(20)],
                                 "seq bigint, org_id bigint, normalized_title string, deadline timestamp_ntz, external_key string, norm_url string, fingerprint string, content_hash string")
    roots = {r.seq: r.root for r in X.resolve_batch(rows).collect()}
    assert all(roots[i] == 1 for i in range(1, 20, 2)) and all(roots[i] == i for i in range(0, 20, 2))


def test_alert_keys_are_unique(spark):
    for name in ("notify_new_jobs", "deadline_reminders", "notify_job_updates"):
        df = QUERIES[name](spark, SF)
        assert df.count() == df.select("dedupe_key").distinct().count()


def test_scores_in_range_and_hard_fails(spark):
    df = QUERIES["reasons"](spark, SF)
    assert df.where((F.col("score") < 0) | (F.col("score") > 100)).isEmpty()
    assert df.where(F.col("reasons").contains("fail:") & (F.col("verdict") != "NOT_ELIGIBLE")).isEmpty()


def test_every_query_has_a_stable_schema(spark):
    cheap = [n for n in QUERIES if n.startswith(("filter_", "extract_c", "elig_", "source_", "robots_"))]
    for name in cheap:
        assert QUERIES[name](spark, SF).columns


def test_new_numbers_never_collide(spark, monkeypatch):
    """Where hashes are taken, by stored jobs or by each other, keys move on to their next hash."""
    from roleloom.operators import resolve
    monkeypatch.setattr(resolve, "_hashed_id", lambda key, attempt: F.pmod(F.xxhash64(key, F.lit(attempt)), F.lit(40)))
    keys = spark.createDataFrame([(f"k{i}",) for i in range(20)], "external_key string")
    stored = spark.range(0, 10).withColumnRenamed("id", "job_id")
    got = [r.job_id for r in resolve.new_job_ids(keys, stored).collect()]
    assert len(got) == len(set(got)) == 20 and min(got) >= 10


def test_chain_of_duplicates_has_one_root(spark, monkeypatch):
    from roleloom.operators import resolve
    parents = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(100)] + [(200, 200), (201, 50)], "seq long, parent long")
    monkeypatch.setattr(resolve, "batch_parents", lambda rows: rows)
    assert {r.seq: r.root for r in resolve.resolve_batch(parents).collect()} == {i: 0 for i in range(100)} | {200: 200, 201: 0}


def test_emit_once_goes_on_after_a_restart(spark, tmp_path):
    """Several micro-batches, stored keys, and a second run over the same folder."""
    from roleloom.streaming import jobs as J
    schema = "dedupe_key string, created_at timestamp, event_id long"
    put = lambda keys, at: spark.createDataFrame([(k, None, at * 100 + i) for i, k in enumerate(keys)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("z",)], "dedupe_key string")
    alerts = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n, keys in enumerate((["a", "b", "a"], ["b", "c"], ["z", "c", "d"])):
        put(keys, n)
    folder = str(tmp_path / "work")
    assert sorted(r.dedupe_key for r in J.emit_once_stream(alerts(), folder, stored).collect()) == ["a", "b", "c", "d"]
    put(["a", "e", "z"], 9)
    assert sorted(r.dedupe_key for r in J.emit_once_stream(alerts(), folder, stored).collect()) == ["a", "b", "c", "d", "e"]
    # A batch whose commit was lost runs again, and finds its own keys as new as the first time.
    log = tmp_path / "work" / "checkpoint" / "commits"
    last = max((f for f in log.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (log / f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted(r.dedupe_key for r in J.emit_once_stream(alerts(), folder, stored).collect()) == ["a", "b", "c", "d", "e"]
    # The session's own provider is as it was.
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_collect_pipeline_over_micro_batches(spark, tmp_path):
    """Ticks of a stream end in jobs, links, matches and alerts, without doubles; a second run adds nothing."""
    from roleloom.operators import resolve
    from roleloom.plans.q_resolution import stored
    from roleloom.plans.views import NOW
    from roleloom.sources.tables import materialised
    from roleloom.streaming import jobs as J
    t = Tables(spark, SF)
    jobs = stored(t).where("job_id < 60").select("job_id", "slug", "org_id", *resolve.OWNED, "source_name", "source_url", "source_job_id", "first_discovered_at", "last_verified_at", "missing_runs", "review_status", "archived_at",
                                                   "is_demo", "submitted_by", "created_at", "updated_at", "status")
    shape = "user_id bigint, job_id bigint, type string, title string, body string, url string, priority boolean, dedupe_key string, deliver_now boolean, created_at timestamp_ntz"
    state = {"orgs": t.v_orgs, "jobs": jobs, "links": t.v_links.where("job_id < 60"), "queue": t.v_duplicates.where("job_id < 60"), "matches": t.v_matches.where("job_id < 60"), "notifications": spark.createDataFrame([], shape)}
    state = {k: materialised(v) for k, v in state.items()}
    schema = ("posting_id bigint, source_key string, source_name string, source_id bigint, title string, organization_slug string, organization_name string, source_org_slug string, default_org_type string, department string, "
              "description string, deadline timestamp_ntz, application_url string, source_url string, source_job_id string")

    def row(i, title, org="org-1", name=None, key=None, unit="IT", text="Work with Java and Oracle databases."):
        return (i, "feed", "Feed", 1, title, org, name, None, None, unit, text, None, f"https://e.example/{i}", f"https://e.example/v/{i}", key or f"k{i}")
    files = [[row(1, "Cloud Platform Engineer"), row(2, "Cloud Platform Engineer"), row(3, "Branch Cleaner", unit="Facilities", text="Keep the branch clean."), row(4, "x"), row(6, "Java Developer", None, "Brand New Bank")],
             [row(5, "Cloud Platform Engineer", key="k1"), row(7, "Network Engineer", None, "Brand New Bank")]]

    def put(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n, rows in enumerate(files):
        put(rows, n)
    tables = {"profiles": t.v_profiles.where("user_id < 12"), "prefs": t.v_prefs.where("user_id < 60"), "saved": t.v_saved, "applications": t.v_apps}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return J.collect_pipeline(stream, state, str(tmp_path / "work"), NOW, **tables)
    out = run()
    before = jobs.count()
    made = [r for r in out["jobs"].collect() if r.slug not in {x.slug for x in jobs.select("slug").collect()}]
    assert sorted(r.title for r in made) == ["Cloud Platform Engineer", "Java Developer", "Network Engineer"] and out["jobs"].count() == before + 3
    assert all(r.fingerprint and r.content_hash and r.status == "NEW" for r in made)
    assert [r.name for r in out["orgs"].where("slug = 'brand-new-bank'").collect()] == ["Brand New Bank"]
    assert {r.external_key for r in out["links"].collect()} >= {f"feed:id:k{i}" for i in (1, 2, 6, 7)}
    ids = [r.job_id for r in made]
    assert out["matches"].where(F.col("job_id").isin(ids)).count() == 3 * tables["profiles"].count()
    keys = [r.dedupe_key for r in out["notifications"].collect()]
    assert keys and len(keys) == len(set(keys))
    again = run()
    assert sorted(r.dedupe_key for r in again["notifications"].collect()) == sorted(keys) and again["jobs"].count() == before + 3
