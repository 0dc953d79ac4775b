"""Shared folder for tables that cut a job into steps, and small column helpers."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows without a doc_id sort before all others and are one document.
NO_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder that spark.checkpoint.dir names, else the warehouse; executors share both."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/roleloom-work").rstrip("/")


def table(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again: later steps don't depend on lost executors, and read only the columns they use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    release(spark)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has collected the plans that named them."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write ``df``, which holds large texts, once to a table in the warehouse that is bucketed by ``column``: joins on it then move the other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"roleloom_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    release(spark)
    _TABLES.append((spark, name))
    return spark.table(name)


_TABLES: list[tuple[SparkSession, str]] = []


_PATHS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    """Intermediate tables end with the program that made them."""
    while _PATHS:
        try:
            _delete(*_PATHS.pop())
        except Exception:  # the session may be gone; the folder is then the operator's to clear
            return
    while _TABLES:
        spark, name = _TABLES.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be gone; the table is then the operator's to clear
            return


atexit.register(_at_exit)


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(id, text, first, copies), bucketed by id: of each document the smallest id with the same text, and how many have it.  Null texts are empty.

    Equal texts are found by 128 bits of hash and their length.
    """
    src = one_text(documents).select("id", F.coalesce("text", F.lit("")).alias("text"))
    keys = src.select("id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    same = keys.groupBy("n", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    return bucketed(src.join(keys.join(same, ["n", "h1", "h2"]).select("id", "first", "copies"), "id"), "id")


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``table`` whose rows are no longer needed."""
    for t in tables:
        _delete(t.sparkSession, t.shared_path)


def key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID))


def id_of(column: str) -> Column:
    """The doc_id that a key stands for."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def one_text(documents: DataFrame) -> DataFrame:
    """(id, text) with one row per doc_id: where ids repeat, the least text (a null before all) counts.

    Only ids are counted for this; texts are shuffled only if some id does repeat.
    """
    rows = documents.select(key().alias("id"), "text")
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("m")).select("id", F.col("m.text").alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id's decimal text, modulo 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
