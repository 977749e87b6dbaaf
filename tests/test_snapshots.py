"""Snapshots in buckets: what an update touches, and what a second run of it does."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import snapshots


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("*.parquet")}


def put(rows, changes):
    both = rows.join(changes.select("k", F.col("v").alias("new")), "k", "left")
    return both.select("k", F.coalesce("new", "v").alias("v"))


def test_updates_touch_their_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/snapshot"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    snapshots.write_snapshot(rows, f"file://{path}", "k", 16)
    before = files(path)
    assert len(before) == 16
    changes = spark.createDataFrame([(3, "new"), (700, "new")], "k long, v string")
    touched = snapshots.update_snapshot(spark, f"file://{path}", "k", changes, put)
    after = files(path)
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and len(kept) == 16 - len(touched) and all(after.get(f) == before[f] for f in kept)
    read = lambda: sorted(map(tuple, snapshots.read_snapshot(spark, f"file://{path}").collect()))
    once = read()
    assert len(once) == 1000 and [k for k, v in once if v == "new"] == [3, 700]
    snapshots.update_snapshot(spark, f"file://{path}", "k", changes, put)
    assert read() == once and all(files(path).get(f) == before[f] for f in kept)


def test_empty_updates_and_emptied_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    snapshots.write_snapshot(spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v")), path, "k", 8)
    none = spark.createDataFrame([], "k long, v string")
    assert snapshots.update_snapshot(spark, path, "k", none, put) == []
    gone = spark.range(50).select(F.col("id").alias("k"), F.lit("y").alias("v")).where("k % 2 = 0")
    snapshots.update_snapshot(spark, path, "k", gone, lambda rows, changes: rows.join(changes, "k", "left_anti"))
    assert sorted(r.k for r in snapshots.read_snapshot(spark, path).collect()) == list(range(1, 50, 2))
    all_keys = spark.range(50).select(F.col("id").alias("k"), F.lit("y").alias("v")).where("k = 1")
    with pytest.raises(ValueError):
        snapshots.update_snapshot(spark, path, "k", all_keys, lambda rows, changes: rows.unionByName(spark.range(50).select(F.col("id").alias("k"), F.lit("z").alias("v"))))
