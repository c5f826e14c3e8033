"""Where intermediate results live, and helpers for iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow relation that may be broadcast; beyond that, joins shuffle.
BROADCAST_ROWS = 200_000
#: Edges, and nodes, that a single-task kernel accepts; it holds edges as pairs of 32-bit numbers.
KERNEL_EDGES = 20_000_000
#: Edges, or rows, that a kernel turns at once.
KERNEL_BATCH = 50_000


class TooLarge(ValueError):
    """A kernel that works in one task was given more than it accepts."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = os.path.join(shared_dir(df.sparkSession), "graphloom", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_ordinals(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """df with dense numbers from 0 in the order of columns, without a single-task sort: ranges are numbered apart and shifted by the rows before them."""
    from pyspark.sql import Window

    sorted_ = stored(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = sorted_.groupBy("_part").count().orderBy("_part").collect()  # one row for each partition
    start, offsets = 0, []
    for r in counts:
        offsets.append((r["_part"], start))
        start += r["count"]
    shift = sorted_.sparkSession.createDataFrame(offsets, "_part int, _start long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*columns)).cast("long") - 1
    return sorted_.withColumn("_rank", rank).join(F.broadcast(shift), "_part").withColumn(name, F.col("_start") + F.col("_rank")).drop("_part", "_rank", "_start")


def check_size(nodes: DataFrame, edges: DataFrame, limit: int, what: str) -> None:
    """Raises TooLarge if there are more than limit nodes or more than limit edges. No more than that is counted."""
    for name, df in (("edges", edges), ("nodes", nodes)):
        if df.select(F.lit(1)).limit(limit + 1).count() > limit:
            raise TooLarge(f"{what} takes at most {limit} {name}")


class Pairs:
    """Edges as pairs of node numbers, kept in two arrays."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.src, self.dst = src, dst

    def __len__(self) -> int:
        return len(self.src)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for k in range(0, len(self), KERNEL_BATCH):
            yield from zip(self.src[k : k + KERNEL_BATCH].tolist(), self.dst[k : k + KERNEL_BATCH].tolist(), strict=True)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.stack((self.src, self.dst), axis=1).astype(dtype or self.src.dtype)

    def rows(self, n: int, both: bool = False) -> Callable[[int], list[int]]:
        """What gives the targets of a node's edges in their order; with both, then the sources of its in-edges."""
        src, dst = (np.concatenate((self.src, self.dst)), np.concatenate((self.dst, self.src))) if both else (self.src, self.dst)
        to, ends = dst[np.argsort(src, kind="stable")], np.cumsum(np.bincount(src, minlength=n)).tolist()
        return lambda v: to[ends[v - 1] if v else 0 : ends[v]].tolist()


def kernel(nodes: DataFrame, edges: DataFrame, work: Callable[[list[str], Pairs], Iterable[tuple]], schema: str, limit: int = KERNEL_EDGES) -> DataFrame:
    """Runs a visit-order dependent algorithm in one task: work(ids by ord, edges as pairs of node numbers by idx) gives the rows of schema. Edges that touch unknown nodes are left out. Raises TooLarge beyond limit nodes or edges. Rows come sorted, nodes first, so that names of edges' ends are not kept."""
    check_size(nodes, edges, limit, "a single-task kernel")
    rows = nodes.select(F.lit(0).alias("kind"), F.col("ord").alias("k"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("idx").alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        src, dst, some = [np.empty(0, np.int32)], [np.empty(0, np.int32)], False
        for batch in batches:
            some = some or len(batch) > 0
            for x in batch.loc[batch.kind == 0, "a"]:
                at.setdefault(x, len(at))
            e = batch[batch.kind == 1]
            a, b = (np.fromiter((at.get(x, -1) for x in e[c]), np.int32, len(e)) for c in ("a", "b"))
            known = (a >= 0) & (b >= 0)
            src.append(a[known])
            dst.append(b[known])
        if not some:
            return
        pairs = Pairs(np.concatenate(src), np.concatenate(dst))
        src, dst = [], []
        out = iter(work(list(at), pairs))
        while part := list(islice(out, KERNEL_BATCH)):
            yield pd.DataFrame(part, columns=names)

    names = [x.strip().split()[0] for x in _top_level(schema)]
    return rows.repartition(1).sortWithinPartitions("kind", F.asc_nulls_last("k")).mapInPandas(run, schema)


def _top_level(schema: str) -> list[str]:
    """The fields of a DDL schema, without splitting inside brackets."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def clean_up(spark: SparkSession) -> None:
    """Removes all that stored() wrote to the shared folder. Results that were not yet computed are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), "graphloom"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
