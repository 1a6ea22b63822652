"""Session helpers: worker imports and the folder all executors share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; an own one only where that is unset."""
    spark_dir = spark.conf.get("spark.checkpoint.dir", None)
    if spark_dir:
        return spark_dir
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="paperlake-")
    sc.setCheckpointDir(path)
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(source: DataFrame) -> int:
    """Number of parts for work on texts that costs far more than moving them: no core idle, and more as the source's files grow."""
    spark = source.sparkSession
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Beyond 2^56 Spark doesn't know the size.
    return max(partitions(spark), 4 * spark.sparkContext.defaultParallelism, size // (16 << 20) if size < 1 << 56 else 0)


def by_path(files: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of (path, text or content), those of one path one after the other, in as many parts as the source needs."""
    return files.repartition(parts(source), "path").sortWithinPartitions(*files.columns)
