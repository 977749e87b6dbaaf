"""Corpus listing and its upkeep: status, missing documents, deletion, selection, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """A relative path without empty segments."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")


def index_status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with ``chunk_count`` and ``indexed``."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0)).cast("long")).withColumn("indexed", F.col("chunk_count") > 0).drop("n")


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path``, ``name``, ``size`` (UTF-8 bytes), ``indexed``, ``chunk_count``; status is derived, not stored. docs: doc_id, path, text."""
    rows = docs.select("doc_id", "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("size"))
    return index_status(rows, chunks).drop("doc_id")


def document_content(docs: DataFrame, path: str) -> DataFrame:
    """The document at a path, whose empty segments count for nothing."""
    wanted = "/".join(p for p in path.split("/") if p)
    return docs.where(normal_path(F.col("path")) == wanted)


def missing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a chunk."""
    return docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the given ids."""
    gone = ids.select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def selected(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a selected set of ids; Spark broadcasts the set while it is small."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id`` and content hash, as kept after an ingestion."""
    return docs.select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("hash"))


def delta(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Ids and hashes that are new or changed against a manifest."""
    return manifest(docs).join(known.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def collection_stats(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Points, indexed vectors, the gap between them, and the dimension. vectors: embedding."""
    points = chunks.agg(F.count("*").alias("points"))
    indexed = vectors.agg(F.count_if(F.size("embedding") == dimension).alias("indexed"))
    # One row each.
    return points.join(F.broadcast(indexed)).withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("points") - F.col("indexed"))).withColumn("dimension", F.lit(dimension).cast("long"))


def ingest_history(runs: DataFrame) -> DataFrame:
    """Ingestion runs with their chunk count: upserted, else processed, else 0.

    runs: id, collection, completed_at, mode, chunks_upserted, processed_chunks, files_updated, duration_s, errors.
    """
    return runs.select("id", "collection", "completed_at", "mode", F.coalesce("chunks_upserted", "processed_chunks", F.lit(0)).cast("long").alias("chunks"), "files_updated", "duration_s", "errors")


def ingest_totals(runs: DataFrame) -> DataFrame:
    """Runs, chunks, files and errors by mode."""
    return ingest_history(runs).groupBy("mode").agg(F.count("*").alias("runs"), F.sum("chunks").alias("chunks"), F.sum("files_updated").alias("files"), F.sum("errors").alias("errors"))


def visible_profiles(profiles: DataFrame, session: Column) -> DataFrame:
    """Profiles a session may see: private ones only of its own; a missing flag hides nothing."""
    own = F.coalesce(F.col("owner_session") == session, F.lit(False))
    return profiles.where((~F.coalesce("private_to_session", F.lit(False)) | own) & F.coalesce("can_access", F.lit(True)))
