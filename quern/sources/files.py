"""Files as tables: model catalogues, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tasks for each core that list folders; unset, each folder is a task.
LISTING = 4


def _listing(spark: SparkSession) -> SparkSession:
    """The session with many folders listed by one task."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING * spark.sparkContext.defaultParallelism)
    return spark


def file_catalog(spark: SparkSession, folder: str, glob: str = "*.gguf") -> DataFrame:
    """Files below a folder, newest first: ``id`` (stem), ``name``, ``path``, ``size_bytes``, ``modified_at``. Contents are not read."""
    files = _listing(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), name.alias("name"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).orderBy(F.col("modified_at").desc(), "path")


def ingest_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Whole text files with one of the extensions, any case: ``path``, ``text``."""
    files = _listing(spark).read.text(folder, wholetext=True, recursiveFileLookup=True)
    kinds = "|".join(e.lstrip(".") for e in extensions)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.rlike("path", F.lit(rf"(?i)\.({kinds})$")))
