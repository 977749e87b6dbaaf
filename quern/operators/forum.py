"""Forum threads: images, galleries, statistics, paging, links to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ellipsize
from quern.functions.urls import image_urls, source_label


def post_images(posts: DataFrame) -> DataFrame:
    """Adds ``images`` found in ``body``."""
    return posts.withColumn("images", image_urls(F.col("body")))


def all_images(declared: Column, found: Column) -> Column:
    """Declared, then found links, each once."""
    return F.array_distinct(F.concat(declared, found))


def with_images(posts: DataFrame) -> DataFrame:
    """Posts that have an image."""
    return posts.where(F.size("images") > 0)


def gallery(posts: DataFrame) -> DataFrame:
    """Each thread's distinct image links in order of first sight. posts: thread, post, images."""
    each = posts.select("thread", "post", F.posexplode("images").alias("pos", "url"))
    first = each.groupBy("thread", "url").agg(F.min(F.struct("post", "pos")).alias("at"))
    return first.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("gallery"))


def thread_stats(posts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Posts, substantive posts, users, images and links of each thread; a stored value wins over the count.

    posts: thread, author, substantive, images, links (numbers); stored: thread and any of the five columns.
    """
    names = ["posts", "substantive_posts", "users", "images", "links"]
    counted = posts.groupBy("thread").agg(F.count("*").alias("posts"), F.count_if(F.coalesce("substantive", F.lit(False))).alias("substantive_posts"), F.countDistinct("author").alias("users"), F.sum("images").cast("long").alias("images"), F.sum("links").cast("long").alias("links"))
    if stored is None:
        return counted
    kept = stored.select("thread", *[F.col(c).alias(f"_{c}") for c in names if c in stored.columns])
    both = counted.join(kept, "thread", "left")
    return both.select("thread", *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in both.columns else F.col(c) for c in names])


def page(df: DataFrame, by: str, order: list[str], number: int, size: int) -> DataFrame:
    """A page of each series, with ``page`` and ``pages``; numbers beyond the ends are clamped."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_all") / size)).cast("long")
    rows = rows.withColumn("pages", pages).withColumn("page", F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages"))).cast("long"))
    return rows.where((F.col("_n") > (F.col("page") - 1) * size) & (F.col("_n") <= F.col("page") * size)).drop("_n", "_all")


def slice_with_total(df: DataFrame, by: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 .. offset+limit of each series, with ``total`` and ``has_more``."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return rows.where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit).drop("_n")


def source_links(sources: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` sources of each answer with a web address; labels over 60 characters end in dots. sources: answer, pos, title, url."""
    order = Window.partitionBy("answer").orderBy("pos")
    kept = sources.where(F.startswith("url", F.lit("http"))).withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= n)
    label = F.when(F.length("title") > 60, F.concat(F.left(F.col("title"), F.lit(57)), F.lit("..."))).otherwise(F.col("title"))
    return kept.select("answer", "n", label.alias("label"), "url")


def source_list(sources: DataFrame, n: int = 5) -> DataFrame:
    """Numbered lines of the first ``n`` sources of each answer, as one text."""
    order = Window.partitionBy("answer").orderBy("pos")
    kept = sources.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    line = F.concat(F.col("n").cast("string"), F.lit(". "), source_label(ellipsize(F.col("title"), 100, ""), F.col("section"), F.col("url")))
    return kept.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("sources"))
