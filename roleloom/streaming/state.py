"""Anchored fixed-window rate limits over a hit log.

A window starts at the first hit after the previous window ended, so hits of one key
depend on each other in time order.  Two facts keep this parallel and memory-bound:
a pause of at least one window length always starts afresh, which cuts a key into
independent sessions; and inside a session only (start, count) is carried while the
sorted rows stream through the task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

c = F.col


def rate_limit_windows(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """(event_id, key, ts, count, ok): position of every hit in its window and whether it was allowed."""
    span = window_seconds * 1_000_000
    h = hits.withColumn("us", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), "ts")).withColumn("bucket", F.floor(c("us") / span))
    # Inside a bucket all gaps are shorter than a window, so sessions break between buckets only: one row per bucket, not per hit.
    edges = h.groupBy("key", "bucket").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    w = W.partitionBy("key").orderBy("bucket")
    fresh = F.coalesce(c("lo") - F.lag("hi").over(w) >= span, F.lit(True)).cast("int")
    sessions = edges.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w)).select("key", "bucket", "session")
    rows = (h.join(sessions, ["key", "bucket"]).select("event_id", "key", "ts", "us", "session")
            .repartition("key", "session").sortWithinPartitions("key", "session", "us", "event_id"))

    def run(batches):
        at, start, count = None, 0, 0
        for pdf in batches:
            counts = []
            for key, session, us in zip(pdf["key"], pdf["session"], pdf["us"]):
                if (key, session) != at or us >= start + span:
                    at, start, count = (key, session), us, 0
                count += 1
                counts.append(count)
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "ts": pdf["ts"], "count": counts})
    out = rows.mapInPandas(run, "event_id bigint, key string, ts timestamp_ntz, count bigint")
    return out.withColumn("ok", c("count") <= limit)
