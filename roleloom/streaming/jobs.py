"""Structured Streaming forms of the stateful operators.

Every micro-batch writes its own folder (``batch=<id>``, overwritten on a retry), so
a repeated batch never doubles rows; readers fold the folders to the current state.
Stream checkpoints and results live in the shared folder the session names.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.alerts import latest_per
from ..operators.enrich import enrich, resolve_organization
from ..sources.registry import validate_postings
from ..sources.state import StateStore
from ..sources.tables import SCHEMAS, shared_folder, temporary_tables

c = F.col


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one stream, in the shared folder; a stream that is to go on after a restart passes the same one again."""
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream; event time is a plain TIMESTAMP because watermarks need one."""
    raw = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", c("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, folder: str, mode: str, transform=None) -> DataFrame:
    """Process everything available, then return the written rows with their ``batch`` number."""
    out = f"{folder}/rows"

    def write(df: DataFrame, batch_id: int) -> None:
        (transform(df, batch_id) if transform else df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, so it is not bound by an executor's memory; a provider that the session names itself stays."""
    named = spark.conf.get(_PROVIDER, "")
    ours = named == "" or named.endswith("HDFSBackedStateStoreProvider")
    if ours:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if ours:
            spark.conf.set(_PROVIDER, named) if named else spark.conf.unset(_PROVIDER)


def emit_once_stream(alerts: DataFrame, folder: str, stored: DataFrame | None = None) -> DataFrame:
    """Each key at most once, ever: a micro-batch keeps the first alert per key and leaves out keys of earlier batches and of ``stored``.

    The keys met so far are the state of a streaming aggregation, which looks up the keys of the batch and no others.  A key is new where the
    first batch that had it is the present one: Spark logs the time of a batch, so a retried batch has the same.  ``folder`` carries the
    memory: a later run with the same folder goes on where the last one stopped.
    """
    rest = [x for x in alerts.columns if x != "dedupe_key"]
    met = alerts.withColumn("_at", F.current_timestamp()).groupBy("dedupe_key").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "event_id")).alias("r"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    new = met.where(c("_first") == c("_last")).select("dedupe_key", "r.*")

    def unstored(df: DataFrame, batch_id: int) -> DataFrame:
        return df if stored is None else df.join(stored.select("dedupe_key"), "dedupe_key", "left_anti")
    with state_on_disk(alerts.sparkSession):
        return run_to_table(new, folder, "update", unstored).drop("batch")


def saved_state_stream(toggles: DataFrame, folder: str) -> DataFrame:
    counts = toggles.groupBy("user_id", "job_id").agg(F.count("*").alias("n"), F.max("ts").alias("saved_at"))
    return latest_per(run_to_table(counts, folder, "update"), ["user_id", "job_id"], ["batch"]).where(c("n") % 2 == 1).drop("batch", "n")


def application_state_stream(events: DataFrame, folder: str) -> DataFrame:
    latest = events.groupBy("user_id", "job_id").agg(F.max_by(F.struct("event_id", "ts", "status"), F.struct("ts", "event_id")).alias("r"))
    return latest_per(run_to_table(latest, folder, "update"), ["user_id", "job_id"], ["batch"]).select("user_id", "job_id", "r.*")


def run_monitor_stream(runs: DataFrame, folder: str, window: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Runs, runs by status and parse errors per window; rows later than the watermark are left out."""
    states = ["success", "partial", "skipped", "failed"]
    g = (runs.withWatermark("ts", lateness).groupBy(F.window("ts", window)).agg(
        F.count("*").alias("runs"), *[F.count_if(c("status") == x.upper()).alias(x) for x in states], F.sum("parse_errors").alias("parse_errors"))
        .select(c("window.start").alias("window_start"), "runs", *states, "parse_errors"))
    return latest_per(run_to_table(g, folder, "update"), ["window_start"], ["batch"]).drop("batch")


def daily_counts_stream(alerts: DataFrame, folder: str, start_hour_utc: int = 18) -> DataFrame:
    """Pending alerts per user and local day: the streaming side of the daily digest."""
    g = (alerts.withWatermark("created_at", "1 day").groupBy("user_id", F.window("created_at", "1 day", "1 day", f"{start_hour_utc} hours"))
         .agg(F.count("*").alias("items")).select("user_id", c("window.start").alias("day_start"), "items"))
    return latest_per(run_to_table(g, folder, "update"), ["user_id", "day_start"], ["batch"]).drop("batch")


def collect_stream(postings: DataFrame, orgs: DataFrame, folder: str) -> DataFrame:
    """Postings as they arrive: validated, given an organisation, gated and enriched; the rest of a tick reads the written rows."""
    def one_batch(df: DataFrame, batch_id: int) -> DataFrame:
        ok, _bad = validate_postings(df)
        return enrich(resolve_organization(ok, orgs))
    return run_to_table(postings, folder, "append", one_batch)


def collect_pipeline(postings: DataFrame, state: dict[str, DataFrame], folder: str, now, compact_after: int = 8, **tables: DataFrame) -> dict[str, DataFrame]:
    """Whole collection over a stream: every micro-batch is one tick on the state that the tick before it left.  Returns the last state.

    The state lies in ``folder`` as a ``StateStore``: a tick writes the rows that it changes, its own intermediate tables go when it is complete, and old versions of the
    state are deleted.  A retried batch starts from the manifest before its own; a later run with the same folder goes on from the last one, and no alert
    is made twice.  ``now`` is the time of all ticks, or a function of the batch's number.
    """
    from ..operators.collect import KEYS, collect_changes
    spark = postings.sparkSession
    store = StateStore(spark, f"{folder}/state", {k: v.schema for k, v in state.items()}, {k: KEYS[k] for k in state}, compact_after)
    store.begin(state)

    def tick(df: DataFrame, batch_id: int) -> None:
        with temporary_tables():
            out = collect_changes(df, store.load(batch_id - 1), now=now(batch_id) if callable(now) else now, tick=batch_id, **tables)
            store.commit(batch_id, {k: out[k] for k in state if k in out})
    query = postings.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(tick).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.load(store.last())
