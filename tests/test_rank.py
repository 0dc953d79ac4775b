"""Positions over sampled ranges, and the next mark over time buckets, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from roleloom.operators import rank as K, search as S
from roleloom.operators.alerts import read_state

c = F.col


def table(spark, n=3000):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rnd.choice([None, 1, 2, 2, 3]) if i % 5 else 9) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, g string, v int").repartition(5)


def test_global_positions(spark):
    rows, df = table(spark)
    got = {r.id: r["rank"] for r in K.ranked(df, [c("v").desc_nulls_last(), c("id")], ranges=7).collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    assert K.ranked(df.where("false"), [c("id")]).count() == 0


def test_positions_inside_groups_with_a_hot_one(spark):
    rows, df = table(spark)
    got = {r.id: r.position for r in K.ranked_within(df, ["g"], [c("id")], ranges=6).collect()}
    want, seen = {}, {}
    for i, g, _ in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want
    # The hot group is ranked by several tasks: its rows lie in several ranges.
    spread = df.repartitionByRange(6, "g", "id").withColumn("p", F.spark_partition_id()).where("g = 'hot'").select("p").distinct().count()
    assert spread >= 3


def test_pages_by_both_ways(spark):
    _, df = table(spark, 500)
    for page in (1, 3, 25, 26):
        near, far = (sorted((r["rank"], r.id) for r in S.page_of(df, [c("id").desc()], page, 20, top=top).collect()) for top in (10_000, 0))
        assert near == far and len(near) == (20 if page < 26 else 0)


def test_next_mark_over_buckets_equals_a_scan(spark):
    rnd, start = random.Random(3), dt.datetime(2024, 3, 30, 22)
    when = lambda: start + dt.timedelta(minutes=rnd.randrange(0, 60 * 80))
    alerts = [(i, 1 if i % 3 == 0 else i % 11, when(), None) for i in range(600)]
    alerts.append((600, 2, start, start + dt.timedelta(days=9)))  # read already
    marks = [(rnd.choice([1, 2, 3, 99]), None, when()) for _ in range(60)] + [(1, None, alerts[0][2])] * 2
    single = [(a[1], a[0], when()) for a in alerts[::40]]
    n = spark.createDataFrame(alerts, "notification_id long, user_id long, created_at timestamp_ntz, read_at timestamp_ntz")
    r = spark.createDataFrame(marks + single, "user_id long, notification_id long, ts timestamp_ntz")
    want = {}
    for i, u, t, read in alerts:
        times = [m[2] for m in marks if m[0] == u and m[2] >= t][:] + [s[2] for s in single if s[1] == i]
        want[i] = read or (min(times) if times else None)
    for hours in (1, 7, 10_000):
        assert {x.notification_id: x.read_at for x in read_state(n, r, bucket_hours=hours).collect()} == want
    assert read_state(n, r.where("false")).where("read_at IS NOT NULL").count() == 1
