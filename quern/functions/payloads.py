"""JSON payloads of model servers, health probes, chat answers and forum threads.

Three rules of falling through are kept apart: where only null does, where '' does too, and where an absent key
differs from a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    """'' as null."""
    return F.nullif(c, F.lit(""))


def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def delta_token(frame: Column) -> Column:
    """Text of a stream frame: the first of seven places that is not null; '' ends the search. Null without choices."""
    first = "choices[0]"
    places = [f"{first}.delta.content", f"{first}.delta.reasoning_content", f"{first}.text", f"{first}.message.content", f"{first}.message.reasoning_content", "content", "reasoning_content"]
    return F.when(_at(frame, first).isNotNull(), F.coalesce(*[_at(frame, p) for p in places]))


def completion(body: Column) -> Column:
    """Whole answers as a struct: content, else reasoning, else text ('' falls through); ``stop`` and 0 by default."""
    m = "choices[0]"
    text = F.coalesce(*[_or_null(_at(body, p)) for p in (f"{m}.message.content", f"{m}.message.reasoning_content", f"{m}.text")], F.lit(""))
    count = lambda k: F.coalesce(_at(body, f"usage.{k}").try_cast("long"), F.lit(0)).cast("long")
    return F.struct(text.alias("content"), F.coalesce(_or_null(_at(body, f"{m}.finish_reason")), F.lit("stop")).alias("finish_reason"), count("prompt_tokens").alias("prompt_tokens"), count("completion_tokens").alias("completion_tokens"), count("total_tokens").alias("total_tokens"))


def health(body: Column) -> Column:
    """Old and new health payloads as one struct: ``healthy``, ``reachable``, ``api_ok``, ``qdrant_ok``, ``points``,
    ``indexed``, ``heap_percent``.

    A new payload has ``reachable`` (or the probe's ``status_code``, below 500) and its fields under ``details``; an old
    one has them at the top. Old ones are healthy if the status, the API and the vector store all are.
    """
    nested = _at(body, "details").isNotNull()
    field = lambda path: F.when(nested, _at(body, f"details.{path}")).otherwise(_at(body, path))
    number = lambda *paths: F.coalesce(*[field(p).try_cast("double") for p in paths], F.lit(0.0))
    no = F.lit(False)
    told = F.coalesce(_at(body, "reachable").try_cast("boolean"), _at(body, "status_code").try_cast("int") < 500)
    api = F.coalesce(field("services.api") == "ok", no) | F.coalesce(_at(body, "reachable") == "true", no)
    qdrant = F.coalesce(field("services.qdrant") == "ok", no) | F.coalesce(field("qdrant.status") == "ok", no)
    old = (_at(body, "status") == "healthy") & (_at(body, "services.api") == "ok") & (_at(body, "services.qdrant") == "ok")
    used, total = number("memory.heapUsed"), number("memory.heapTotal")
    return F.struct(
        (F.coalesce(old, no) | F.coalesce(told, no)).alias("healthy"),
        F.coalesce(told, F.coalesce(field("status") == "healthy", no) | api).alias("reachable"),
        api.alias("api_ok"),
        qdrant.alias("qdrant_ok"),
        number("collection.pointsCount", "qdrant.details.collections.documents.points_count").cast("long").alias("points"),
        number("collection.indexedVectorsCount").cast("long").alias("indexed"),
        F.when(total > 0, F.round(used / total * 100, 1)).otherwise(F.lit(0.0)).alias("heap_percent"),
    )


def chat(body: Column) -> Column:
    """Chat answers: '' and empty lists by default; the total falls back to the number of images if it is 0 or absent."""
    links = lambda name, fields: F.coalesce(F.from_json(_at(body, name), f"array<struct<{fields}>>"), F.array().cast(f"array<struct<{fields}>>"))
    sources, images = links("sources", "title:string,url:string,section:string"), links("images", "url:string,sourceTitle:string")
    total = F.nullif(_at(body, "totalImages").try_cast("long"), F.lit(0).cast("long"))
    return F.struct(F.coalesce(_at(body, "answer"), F.lit("")).alias("answer"), sources.alias("sources"), images.alias("images"), F.coalesce(total, F.size(images).cast("long")).alias("total_images"), F.coalesce(_or_null(_at(body, "conversationId")), _or_null(_at(body, "conversation_id"))).alias("conversation_id"))


def last_usage(frames: DataFrame) -> DataFrame:
    """Last usage counters of each run. A counter that is present as null resets to null; an absent one changes
    nothing. frames: run_id, pos, json."""
    usage = F.get_json_object("json", "$.usage")
    keys = F.coalesce(F.json_object_keys(usage), F.array().cast("array<string>"))
    rows = frames.select("run_id", "pos", usage.alias("u"), keys.alias("k"))
    out = [F.expr(f"max_by(get_json_object(u, '$.{k}'), pos) filter (where array_contains(k, '{k}'))").cast("long").alias(k) for k in ("prompt_tokens", "completion_tokens")]
    return rows.groupBy("run_id").agg(*out)


THREAD = "threadId string, threadUrl string, threadTitle string, forumCategory string, forumPath array<string>, stats struct<totalPosts:bigint,substantivePosts:bigint,uniqueUsers:bigint,totalImages:bigint,totalLinks:bigint>, participants array<string>, posts array<struct<postId:string,username:string,date:string,rawDate:string,contentFull:string,content:string,images:array<string>,links:array<string>>>"


def thread(path: Column, content: Column) -> Column:
    """A forum thread from a ``.json`` file whose ``posts`` is an array; else null."""
    parsed = F.from_json(content, THREAD)
    is_array = F.startswith(F.coalesce(F.get_json_object(content, "$.posts"), F.lit("")), F.lit("["))
    return F.when(F.rlike(path, F.lit(r"(?i)\.json$")) & is_array, parsed)


def post_rows(threads: DataFrame) -> DataFrame:
    """A row per post: ``thread_id``, ``pos`` (from 0), ``body``, ``label``, ``date``, ``username``, ``images``. threads: path, thread."""
    rows = threads.where("thread is not null").select("path", F.col("thread.threadId").alias("thread_id"), F.posexplode("thread.posts").alias("pos", "p"))
    return rows.select("path", "thread_id", F.col("pos").cast("long").alias("pos"), F.coalesce(_or_null(F.col("p.contentFull")), F.col("p.content"), F.lit("")).alias("body"), F.coalesce(_or_null(F.col("p.postId")), F.concat(F.lit("#"), (F.col("pos") + 1).cast("string"))).alias("label"), post_date(F.col("p.rawDate"), F.col("p.date")).alias("date"), F.col("p.username").alias("username"), F.coalesce("p.images", F.array().cast("array<string>")).alias("images"))


def post_date(raw: Column, date: Column) -> Column:
    """The raw date, else the parsed one (ISO, seconds), else a fixed text."""
    return F.coalesce(_or_null(raw), F.date_format(F.try_to_timestamp(date), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("Unknown date"))
