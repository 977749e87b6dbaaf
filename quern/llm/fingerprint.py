"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's shingles (five words, or the
whole sequence where there are fewer). The sketch of two parts is the k smallest of their union, so sketches merge;
resemblance, containment and the distinct shingle count are estimated from them, exactly where a text has at most k
distinct shingles.

Nulls: a null text is an empty one with an empty sketch; two empty sketches have likeness 1, an empty and another
one 0. Rows with a null id come first in the order of ids. Rows that repeat an id follow each other in an order that
depends on their texts. The only document of a table is its own next one; an empty table gives no rows. Very long texts
are sketched whole, in one row. Ties cannot arise: a sketch is a set. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, K = 5, 128
#: Rows meant for a bucket of consecutive ids, and the most buckets (their bounds and first ids are broadcast).
BUCKET_ROWS, MOST_BUCKETS = 500, 1 << 16
_NO_ID = -(1 << 63)
_SPAN = float(1 << 48)


def words(text: Column) -> Column:
    """Lower-cased words between runs of white space."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def sketch(word: Column, size: int = SIZE, k: int = K) -> Column:
    """Bottom-k sketch of the shingles of an array of words (a column, as it is used once for each word of one)."""
    shingle = F.transform(word, lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *[F.get(word, i + n) for n in range(1, size)]), 16))
    whole = F.slice(shingle, F.lit(1), F.greatest(F.size(word) - (size - 1), F.lit(1)))
    return F.slice(F.sort_array(F.array_distinct(whole)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    both = merged(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), both)), F.size(both)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets, 0 to 1."""
    shared, of = _shared(a, b, k)
    return F.when(of == 0, F.lit(1.0)).otherwise(shared / of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    n = F.size(a)
    return F.when(n < k, n.cast("double")).otherwise(F.lit(k - 1.0) / ((F.element_at(a, -1).cast("double") + 1) / _SPAN))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    union = distinct_shingles(merged(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def printed(a: Column) -> Column:
    """A sketch as text: twelve hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 12, "0")), ""))


def _places(bounds: list[int], x: Column, inclusive: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``x`` (or equal to it): a binary search inside the row."""
    array, n = F.lit(np.array(bounds, np.int64)), len(bounds)

    def step(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = ((low + high) / 2).cast("int")
        at = F.get(array, middle)
        right = (low < high) & ((at <= x) if inclusive else (at < x))
        return F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right | (low >= high), high).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda s: s["low"])


def buckets_by_rank(rows: DataFrame, n: int) -> Column | None:
    """Bucket of about ``BUCKET_ROWS`` rows (or 1/``MOST_BUCKETS`` of all) by rank of ``id``, ascending: bounds are
    approximate quantiles, at most ``MOST_BUCKETS`` numbers. An id that fills several buckets is split by the order of ``h``."""
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) or 1
    if buckets == 1:
        return F.lit(0)
    shares = F.lit(np.arange(1, buckets) / buckets)
    bounds = sorted(rows.agg(F.percentile_approx("id", shares, 16 * buckets)).first()[0])
    low, high = _places(bounds, F.col("id"), False), _places(bounds, F.col("id"), True)
    part = F.floor((F.col("h") / float(1 << 64) + 0.5) * (high - low + 1)).cast("int")
    return F.when(high - low < 2, high).otherwise(F.least(high, low + part))


def with_next(docs: DataFrame) -> DataFrame:
    """``id``, ``doc_id``, ``text``, ``next_text`` of every row: the text of the row with the next higher id, and of
    the first after the last.

    Ids are cut into buckets of about equal numbers of rows, however they are spread; a bucket's rows meet in one task,
    and the first row of the next bucket is sent along. So the texts are shuffled once, and no task sorts all rows. Only
    rows equal in id and text are never parted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    cut = keyed.withColumn("bucket", buckets_by_rank(rows, rows.count()))
    starts = cut.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("s"))
    around = Window.orderBy(F.col("bucket").desc())
    sent = starts.select("s.id", "s.h", F.lead("bucket").over(around).alias("to"), F.max("bucket").over(Window.partitionBy(F.lit(0))).alias("last"))
    sent = sent.select("id", "h", F.coalesce("to", "last").alias("to"))
    # Rows that are equal in id and text are alike; any one of them is sent.
    tie = Window.partitionBy("to").orderBy("id")
    first = keyed.join(F.broadcast(sent), ["id", "h"]).withColumn("n", F.row_number().over(tie)).where("n = 1")
    both = cut.withColumn("sent", F.lit(False)).unionByName(first.select("doc_id", "text", "id", "h", F.col("to").alias("bucket"), F.lit(True).alias("sent")))
    order = Window.partitionBy("bucket").orderBy("sent", "id", "h")
    return both.withColumn("next_text", F.lead("text").over(order)).where("not sent").select("id", "doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """``doc_id`` and ``sketch`` (array of long) of every text: one scan, no shuffle."""
    split = docs.select("doc_id", words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    return split.select("doc_id", sketch(F.col("w"), size, k).alias("sketch"))


def edited(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """Each text, its edited form and the next text compared by sketches: ``doc_id``, ``n_chars``, ``edited_sha256``,
    the three sketches ``own``, ``changed``, ``following``, and the estimates.

    The edited text has the last quarter of its code points replaced by the first as many of the next text.
    """
    rows = with_next(docs).select("doc_id", "text", "next_text", F.length("text").alias("n"))
    tail = F.floor(F.col("n") / 4).cast("int")
    rows = rows.select("doc_id", "n", words(F.col("text")).alias("w"), words(F.col("next_text")).alias("w_next"), F.concat(F.substring("text", F.lit(1), F.col("n") - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    rows = rows.select("doc_id", "n", "w", "w_next", F.sha2("edited", 256).alias("edited_sha256"), words(F.col("edited")).alias("w_edited"))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", *[sketch(F.col(w), size, k).alias(s) for w, s in (("w", "own"), ("w_edited", "changed"), ("w_next", "following"))])
    return rows.select("*", resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("following"), k).alias("near_next"))
