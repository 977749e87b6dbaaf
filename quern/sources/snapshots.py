"""Snapshots in buckets by key: an update rewrites the buckets that its keys fall into and leaves all other files alone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.staging import staged

_NAME = re.compile(r"bucket_of_(\d+)$")


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def write_snapshot(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Writes ``rows`` as a new snapshot. The folders' name tells the number of buckets. A bucket is one task's file: take as
    many as make files of some hundred megabytes."""
    name = f"bucket_of_{buckets}"
    rows.withColumn(name, _bucket(key, buckets)).repartition(buckets, name).write.partitionBy(name).parquet(path)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    rows = spark.read.parquet(path)
    name = next(c for c in rows.columns if _NAME.match(c))
    return rows, name, int(_NAME.match(name)[1])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    rows, name, _ = _opened(spark, path)
    return rows.drop(name)


def update_snapshot(spark: SparkSession, path: str, key: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Rewrites the buckets of the keys of ``changes`` as ``apply(rows of these buckets, changes)`` gives them, which must keep
    rows of other keys as they are. Returns the buckets.

    What the update reads of the snapshot is pruned to these buckets, and its result is staged before a file goes. Spark
    replaces just the folders that it writes (dynamic overwrite), so a task that is repeated, or the whole update run
    again after a failure, ends in the same snapshot. A bucket that is left without rows goes as a whole.
    """
    rows, name, n = _opened(spark, path)
    changes = staged(changes, "changes")
    touched = sorted(r[0] for r in changes.select(_bucket(key, n)).distinct().collect())
    new = staged(apply(rows.where(F.col(name).isin(touched)).drop(name), changes).withColumn(name, _bucket(key, n)), "update")
    filled = {r[0] for r in new.select(name).distinct().collect()}
    if not filled <= set(touched):
        raise ValueError(f"the update moves rows to buckets {sorted(filled - set(touched))}")
    if filled:
        new.repartition(len(filled), name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    for bucket in set(touched) - filled:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
