"""Incremental graphs: edges that arrive as a stream update stored degrees batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def degree_stream(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of each batch of edges (src, dst), written under the batch's number, so that a batch that runs twice counts once. degrees() sums them."""

    def save(batch: DataFrame, number: int) -> None:
        ends = batch.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(batch.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    return edges.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degrees(spark: SparkSession, path: str) -> DataFrame:
    sums = spark.read.option("basePath", path).parquet(path).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
