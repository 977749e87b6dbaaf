"""Intermediate tables and working folders, where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset and the master is local, a temporary one of ours;
    on a cluster that would be a different folder on each machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; :func:`release` deletes it."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends here, and a lost executor
    costs no more than the tasks that read it. ``group_bytes``: size of row groups, which tasks hold in memory."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`staged`, dealt by ``key`` to as many buckets as the session shuffles to: groupings and joins by ``key`` read
    it in place, without an exchange, however often they do so.

    Buckets are a property of tables, so this one is entered in the session's current database (``USE`` another one before,
    where that may not be written), and stays there until :func:`release`; a write that fails leaves none."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"quern_{path.rsplit('-', 1)[1]}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def release(spark: SparkSession) -> int:
    """Deletes what this application has staged, once its results are read or written; returns how many paths."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
