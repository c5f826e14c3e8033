"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker, so that a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: A relation of at most this many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: The same for bytes, where rows are wide.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "graphloom", f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: later steps neither recompute it nor depend on an executor's disk."""
    spark, path = df.sparkSession, stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session's Python functions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows; else Spark's shuffled join, which AQE splits where it is skewed. Pass stored or cheap relations: they are counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def if_light(df: DataFrame, text: Column, size: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same where rows are wide: df is also counted to hold at most size bytes of text (a string column of it)."""
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def null_safe_key(*columns: str):
    """A 64-bit key of columns, of which any may be null."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])
