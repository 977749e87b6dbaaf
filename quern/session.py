"""Session settings the operators rely on: UTC, adaptive execution, RocksDB for streaming state."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Rows and bytes that go to a Python worker at once: texts may be long, and each task holds a batch on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, for operators over texts."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def configured(spark: SparkSession) -> SparkSession:
    """The session with the settings that can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass its own session to :func:`configured`."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configured(spark)


def shipped(spark: SparkSession) -> SparkSession:
    """The session with this package sent to its executors, once for each Spark application."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if not any(f.endswith("/quern-package.zip") for f in context.listFiles):
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quern-")
        context.addPyFile(shutil.make_archive(f"{folder}/quern-package", "zip", home.parent, home.name))
    return bounded(spark)
