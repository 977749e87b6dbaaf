"""Ingestion plans: incremental chunking of documents and forum threads, image search, payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import chunks as cut
from quern.operators.documents import delta, manifest, missing
from quern.operators.forum import gallery, post_images, slice_with_total
from quern.operators.messages import drop_nulls, inject_system


@dataclass
class Ingested:
    """What an ingestion leaves: all chunks, the new manifest, and the ids it worked on with their ``change``."""

    chunks: DataFrame
    manifest: DataFrame
    changes: DataFrame


def ingest(docs: DataFrame, known: DataFrame, chunks: DataFrame, mode: str = "incremental", ids: DataFrame | None = None, target: int = 500, most: int = 700, overlap: int = 75) -> Ingested:
    """Upserts documents. Modes: ``incremental`` (new or changed), ``missing`` (without chunks), ``selected`` (``ids``),
    ``full``. Chunks of documents worked on are replaced; a second run with the same input changes nothing.

    docs: doc_id, text; known: doc_id, hash; chunks: id, chunk_no, n_tokens, text. New tables are returned, to be
    written as a new snapshot; no file is changed in place.
    """
    if mode == "incremental":
        wanted = delta(docs, known).select("doc_id")
    elif mode == "missing":
        wanted = missing(docs, chunks.select(F.col("id").alias("doc_id"))).select("doc_id")
    elif mode == "selected":
        wanted = docs.select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    elif mode == "full":
        wanted = docs.select("doc_id")
    else:
        raise ValueError(f"unknown mode {mode}")
    work = docs.join(wanted, "doc_id", "left_semi")
    made = cut(work, target, most, overlap)
    kept = chunks.join(wanted.select(F.col("doc_id").alias("id")), "id", "left_anti")
    changes = wanted.join(known.select("doc_id", F.lit(True).alias("seen")), "doc_id", "left").select("doc_id", F.when(F.col("seen"), "changed").otherwise("new").alias("change"))
    fresh = manifest(work)
    return Ingested(kept.unionByName(made), known.select("doc_id", "hash").join(wanted, "doc_id", "left_anti").unionByName(fresh), changes)


def forum_ingest(posts: DataFrame, known: DataFrame, most_posts: int = 10, target: int = 800, most: int = 1000, overlap: int = 75) -> DataFrame:
    """Chunks of the first posts of each thread that is new or changed. posts: thread, post, author, body; known: doc_id, hash."""
    order = Window.partitionBy("thread").orderBy("post")
    first = posts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_posts)
    line = F.concat(F.coalesce("author", F.lit("")), F.lit(": "), F.coalesce("body", F.lit("")))
    threads = first.groupBy(F.col("thread").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))
    return cut(threads.join(delta(threads, known), "doc_id", "left_semi"), target, most, overlap)


def image_search(hits: DataFrame, posts: DataFrame, offset: int = 0, count: int = 4) -> DataFrame:
    """Images of the posts that were hit, by rank of the hit and place in the post, each once a query, as a page.

    hits: query_id, thread, post, rank; posts: thread, post, body. At most eight a page.
    """
    found = post_images(posts).select("thread", "post", F.posexplode("images").alias("pos", "url"))
    own = hits.join(found, ["thread", "post"]).groupBy("query_id", "url").agg(F.min(F.struct("rank", "pos")).alias("at"))
    rows = own.select("query_id", "url", F.col("at.rank").alias("rank"), F.col("at.pos").alias("pos"))
    return slice_with_total(rows, "query_id", ["rank", "pos", "url"], offset, max(1, min(8, count)))


def thread_galleries(posts: DataFrame) -> DataFrame:
    return gallery(post_images(posts))


def build_payload(turns: DataFrame, parameters: Column, prompt: str = "") -> DataFrame:
    """A JSON request for each conversation: messages by turn, after the system prompt, and parameters that are set.

    turns: conv_id, turn, role, text; parameters: a map column of constants.
    """
    every = inject_system(turns.select("conv_id", "turn", "role", "text"), prompt)
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rows = every.groupBy("conv_id").agg(messages.alias("messages"))
    return rows.select("conv_id", F.to_json(F.struct("messages", drop_nulls(parameters).alias("parameters"))).alias("payload"))
