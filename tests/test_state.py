"""State kept as change files: folding, compaction, retries, and what is written and kept."""

import pytest
from pyspark.sql import functions as F

from roleloom.operators import match as M
from roleloom.operators.lifecycle import missed_in_run, sources_after
from roleloom.plans.registry import Tables
from roleloom.sources.state import StateStore
from roleloom.sources.tables import materialised, shared_folder, temporary_tables

SF = "/root/testdata/sf0.001"
SHAPE = "k bigint, v string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    base = spark.range(0, 5000).select(F.col("id").alias("k"), F.concat(F.lit("old"), "id").alias("v"))
    s = StateStore(spark, str(tmp_path / "state"), {"t": base.schema, "still": base.schema}, {"t": ["k"], "still": ["k"]}, compact_after=3)
    s.begin({"t": base, "still": base.limit(0)})
    return s


def change(spark, *pairs):
    return spark.createDataFrame(list(pairs), SHAPE)


def test_changes_fold_and_compact(spark, store):
    want = {i: f"old{i}" for i in range(5000)}
    for n in range(7):
        new = {n: f"v{n}", 3: f"three{n}", 9000 + n: "added"}
        store.commit(n, {"t": change(spark, *new.items())})
        want |= new
        assert rows(store.load(n)["t"]) == sorted(want.items()) and store.load(n)["still"].count() == 0
        kinds = [f.kind for f in store.manifest(n) if f.name == "t"]
        assert kinds.count("base") == 1 and kinds.count("change") == (n + 1) % 3
    assert store.last() == 6


def test_a_tick_writes_its_changes_only(spark, store):
    store.commit(0, {"t": change(spark, (1, "a"))})
    assert 0 < store.bytes_of(f"{store.folder}/t/change=0") < store.bytes_of(f"{store.folder}/t/base=-1") / 10
    assert store.bytes_of(f"{store.folder}/still/change=0") == 0


def test_old_versions_go(spark, store):
    for n in range(7):
        store.commit(n, {"t": change(spark, (n, "x"))})
    assert store.manifest(3) == [] and store.manifest(5) and store.manifest(6)
    assert store.bytes_of(f"{store.folder}/t/base=-1") == 0 and store.bytes_of(f"{store.folder}/t/change=0") == 0
    assert rows(store.load(5)["t"])[5] == (5, "x") and rows(store.load(5)["t"])[6] == (6, "old6")


@pytest.mark.parametrize("batch", [1, 2])  # the second one compacts
def test_a_repeated_batch_replaces_its_first_attempt(spark, store, batch):
    for n in range(batch):
        store.commit(n, {"t": change(spark, (n, "x"))})
    store.commit(batch, {"t": change(spark, (7, "first"), (8, "first"))})
    store.commit(batch, {"t": change(spark, (8, "again"))})
    got = dict(rows(store.load(batch)["t"]))
    assert got[7] == "old7" and got[8] == "again" and got[0] == "x" and len(got) == 5000
    with pytest.raises(ValueError):
        store.load(99)
    store.begin({"t": change(spark, (1, "lost")), "still": change(spark)})  # goes on from what is there
    assert dict(rows(store.load(store.last())["t"])) == got


def test_temporary_tables_end_with_their_block(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: len(fs.listStatus(path)) if fs.exists(path) else 0
    kept = materialised(spark.range(3))
    before = count()
    with temporary_tables():
        assert materialised(spark.range(5)).count() == 5 and count() == before + 1
    assert count() == before and kept.count() == 3


def test_misses_and_source_health_of_a_tick(spark):
    now = "2024-03-02 00:00:00"
    runs = spark.createDataFrame([(1, "SUCCESS", 4), (2, "FAILED", 0), (3, "SKIPPED", 0), (4, "PARTIAL", 0)], "source_id bigint, status string, items_found bigint")
    links = spark.createDataFrame([(1, 10, "2024-03-01 00:00:00"), (1, 11, now), (1, 12, "2024-03-01 00:00:00"), (1, 12, now), (2, 13, "2024-03-01 00:00:00"), (4, 14, "2024-03-01 00:00:00"), (None, 15, None)],
                                  "source_id bigint, job_id bigint, seen string").withColumn("last_seen_at", F.col("seen").cast("timestamp_ntz"))
    assert rows(missed_in_run(runs, links, now)) == [(10, 1)]
    sources = spark.createDataFrame([(i, None, None, f) for i, f in ((1, 5), (2, 2), (3, 2), (4, None), (9, 7))], "source_id bigint, last_run_at timestamp_ntz, last_success_at timestamp_ntz, consecutive_failures int")
    got = {r.source_id: (r.consecutive_failures, r.last_success_at is not None, r.last_run_at is not None) for r in sources_after(sources, runs, now).collect()}
    assert got == {1: (0, True, True), 2: (3, False, True), 3: (2, False, True), 4: (0, True, True)}


def test_profiles_of_one_class_are_scored_once(spark):
    t = Tables(spark, SF)
    some = t.v_profiles.where("user_id < 6")
    many = some.unionByName(some.crossJoin(spark.range(1, 30).withColumnRenamed("id", "n")).withColumn("user_id", F.col("user_id") + 1000 * F.col("n")).drop("n"))
    classes, members = M.profile_classes(many)
    assert classes.count() == M.profile_classes(some)[0].count() <= some.count() and members.count() == many.count()
    changed = t.v_jobs.where("job_id < 40").select("job_id")
    got = M.match_for_jobs(changed, many, t.v_jobs, t.v_orgs)
    plain = M.match(many.select("user_id").crossJoin(changed), many, t.v_jobs, t.v_orgs)
    key = lambda df: sorted((r.user_id, r.job_id, r.verdict, r.score, str(r.reasons)) for r in df.collect())
    assert key(got) == key(plain)
