"""Queries over forum posts, images and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import forum as ops
from quern.plans import ingest as plans
from quern.plans.registry._views import joined, query, views
from quern.sources import tables


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return ops.post_images(tables.posts(spark, d))


@query(f"{views('images')} SELECT thread, post, len(list_distinct(every)) AS n_images FROM images WHERE len(every) > 0")
def posts_with_images(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_images(_posts(spark, d)).select("thread", "post", F.size("images").cast("long").alias("n_images"))


@query(f"""{views('images')} SELECT thread, post, array_to_string(list_transform(list_filter(list_transform(a, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(a, s.x) = s.i), lambda s: s.x), '|') AS urls
    FROM (SELECT thread, post, list_concat(['https://img.example/' || thread || '/a?c=1', 'https://own.example/' || post], every) AS a FROM images)""")
def union_image_urls(spark: SparkSession, d: str) -> DataFrame:
    declared = F.array(F.concat(F.lit("https://img.example/"), F.col("thread").cast("string"), F.lit("/a?c=1")), F.concat(F.lit("https://own.example/"), F.col("post").cast("string")))
    return _posts(spark, d).select("thread", "post", joined(ops.all_images(declared, F.col("images"))).alias("urls"))


@query(f"""{views('image_rows')} SELECT thread, string_agg(url, '|' ORDER BY post, pos) AS gallery FROM (SELECT thread, url, post, pos, row_number() OVER (PARTITION BY thread, url ORDER BY post, pos) AS n FROM image_rows) WHERE n = 1 GROUP BY thread""")
def thread_gallery(spark: SparkSession, d: str) -> DataFrame:
    return ops.gallery(_posts(spark, d)).select("thread", joined("gallery").alias("gallery"))


@query(f"""{views('images')}, p AS (SELECT i.thread, i.author, coalesce(quality, 0) = 1 AS good, len(list_distinct(every)) AS n FROM images i LEFT JOIN labels ON doc_id = thread * 10 + post)
    SELECT thread, CASE WHEN thread % 5 = 0 THEN 77 ELSE count(*) END AS posts, count(*) FILTER (good) AS substantive_posts, count(DISTINCT author) AS users, CAST(sum(n) AS BIGINT) AS images, CAST(0 AS BIGINT) AS links FROM p GROUP BY thread""")
def thread_stats(spark: SparkSession, d: str) -> DataFrame:
    labels = tables.table(spark, d, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("substantive"))
    p = _posts(spark, d).withColumn("key", F.col("thread") * 10 + F.col("post")).join(labels, "key", "left")
    p = p.select("thread", "author", "substantive", F.size("images").alias("images"), F.lit(0).alias("links"))
    stored = p.select("thread").distinct().select("thread", F.when(F.col("thread") % 5 == 0, 77).cast("long").alias("posts"))
    return ops.thread_stats(p, stored)


@query(f"""{views('posts')}, p AS (SELECT thread, post, row_number() OVER (PARTITION BY thread ORDER BY post) AS n, count(*) OVER (PARTITION BY thread) AS total FROM posts), q AS (SELECT *, greatest(1, CAST(ceil(total / 3.0) AS BIGINT)) AS pages FROM p)
    SELECT thread, post, least(2, pages) AS page, pages FROM q WHERE n > (least(2, pages) - 1) * 3 AND n <= least(2, pages) * 3""")
def page_posts(spark: SparkSession, d: str) -> DataFrame:
    return ops.page(tables.posts(spark, d), "thread", ["post"], 2, 3).select("thread", "post", "page", "pages")


@query(f"""{views('image_rows')}, r AS (SELECT thread, url, post, pos, row_number() OVER (PARTITION BY thread ORDER BY post, pos, url) AS n, count(*) OVER (PARTITION BY thread) AS total FROM image_rows) SELECT thread, url, total, total > 4 AS has_more FROM r WHERE n > 2 AND n <= 4""")
def more_images(spark: SparkSession, d: str) -> DataFrame:
    rows = _posts(spark, d).select("thread", "post", F.posexplode("images").alias("pos", "url"))
    return ops.slice_with_total(rows, "thread", ["post", "pos", "url"], 2, 2).select("thread", "url", "total", "has_more")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages as sources of the answer with their remainder by a twentieth of their number."""
    p = tables.table(spark, d, "pages")
    i = F.col("page_id")
    title = F.concat(F.when(i % 4 == 0, "Thread ").otherwise("Page "), i.cast("string"), F.lit(" "), F.repeat(F.lit("long "), (i % 25).cast("int")))
    return p.select(F.floor(i / 8).cast("long").alias("answer"), i.alias("pos"), title.alias("title"), F.when(i % 3 == 0, "Post by someone").when(i % 3 == 1, "Intro").alias("section"), F.when(i % 5 == 0, "doc.md").otherwise(F.col("url")).alias("url"))


_SOURCES = "SELECT page_id // 8 AS answer, page_id AS pos, CASE WHEN page_id % 4 = 0 THEN 'Thread ' ELSE 'Page ' END || page_id || ' ' || repeat('long ', page_id % 25) AS title, CASE page_id % 3 WHEN 0 THEN 'Post by someone' WHEN 1 THEN 'Intro' END AS section, CASE WHEN page_id % 5 = 0 THEN 'doc.md' ELSE url END AS url FROM pages"


@query(f"WITH s AS ({_SOURCES}), k AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY pos) AS n FROM s WHERE starts_with(url, 'http')) SELECT answer, n, CASE WHEN length(title) > 60 THEN left(title, 57) || '...' ELSE title END AS label, url FROM k WHERE n <= 3")
def linkable_sources(spark: SparkSession, d: str) -> DataFrame:
    return ops.source_links(_sources(spark, d))


@query(f"""WITH s AS ({_SOURCES}), k AS (SELECT answer, url, section, title AS whole, left(title, 100) AS title, row_number() OVER (PARTITION BY answer ORDER BY pos) AS n FROM s)
    SELECT answer, string_agg(n || '. ' || CASE WHEN contains(coalesce(section, ''), 'Post by') OR contains(title, 'Thread') THEN coalesce(nullif(section, ''), title) ELSE '[' || title || '](' || url || ')' END, chr(10) ORDER BY n) AS sources FROM k WHERE n <= 5 GROUP BY answer""")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return ops.source_list(_sources(spark, d))


@query(f"""{views('image_rows')}, h AS (SELECT thread % 10 AS query_id, thread, post, row_number() OVER (PARTITION BY thread % 10 ORDER BY thread, post) AS rank FROM posts),
    f AS (SELECT query_id, url, min(struct_pack(rank := rank, pos := pos)) AS place FROM h JOIN image_rows USING (thread, post) GROUP BY 1, 2), r AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY place.rank, place.pos, url) AS n, count(*) OVER (PARTITION BY query_id) AS total FROM f)
    SELECT query_id, url, total, total > 8 AS has_more FROM r WHERE n > 4 AND n <= 8""")
def image_search(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = tables.posts(spark, d)
    hits = p.select((F.col("thread") % 10).alias("query_id"), "thread", "post", F.row_number().over(Window.partitionBy(F.col("thread") % 10).orderBy("thread", "post")).alias("rank"))
    return plans.image_search(hits, p, 4, 4).select("query_id", "url", "total", "has_more")
