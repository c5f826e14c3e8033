"""Lets Python workers find this package, wherever the driver was started."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def visible(spark: SparkSession) -> None:
    """Puts the package's folder on the path of workers that start from now on. On a cluster the folder must exist there, or the package be installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
