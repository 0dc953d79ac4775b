"""Typed table scans and snapshot sinks."""

from __future__ import annotations

import atexit
import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Declared schemas: nothing is inferred, and only the asked columns are read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def scan(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Read one table; the projection and the predicate reach the Parquet scan."""
    df = spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def load(spark: SparkSession, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: scan(spark, folder, name) for name in (tables or SCHEMAS)}


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Append or replace a table of Parquet files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Next snapshot: stored rows without a change, plus all changes. ``changes`` holds one row per key."""
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.select(*current.columns))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], next_path: str) -> None:
    """Write the next snapshot beside the stored one; readers switch to ``next_path`` when it is complete.

    The stored files are only read, so a lost executor or a failed job leaves them whole.
    """
    write_table(upserted(current, changes, keys), next_path)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder that spark.checkpoint.dir names, else the warehouse; executors share both."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/roleloom-work").rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def _remove_made() -> None:
    """Intermediate tables end with the program that made them."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is the operator's to clear then
            return


atexit.register(_remove_made)


@contextmanager
def temporary_tables():
    """Intermediate tables made inside end with the block: a long-running stream keeps none of its earlier ticks' tables."""
    before = len(_MADE)
    try:
        yield
    finally:
        mine, _MADE[before:] = _MADE[before:], []
        for spark, path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to a table of its own in the shared folder and read again: the lineage is cut, lost executors cost nothing, and later steps read only their columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # keys are texts of hex digits, which take half of what snappy leaves
    release(spark)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has collected the plans that named them."""
    gc.collect()
    spark._jvm.System.gc()


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("roleloom.spread", None) or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def over_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by ``keys`` to as many tasks as ``spread`` deals to, however few they are: for joins that make many rows of them."""
    return df.repartition(_tasks(df.sparkSession), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over as many tasks as the session setting ``roleloom.spread`` says; without it, over as many as a shuffle has, and one per core at least.

    A Parquet file is split at its row groups only, so one of a million rows is read by one task; work on each row needs more of them.
    Deal the narrow rows of a table, not what is made of them.
    """
    return df.repartition(_tasks(df.sparkSession))
