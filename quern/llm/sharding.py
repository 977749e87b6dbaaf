"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row r of n goes to place p(r) of a keyed permutation of 0..n-1; its shard is p mod shards and its slot p div shards.
So counts differ by one at most (law ``rows``), slots have no gap, and either can be computed from the other without
a look-up. Row numbers depend on the rows alone: rows are ordered by a hash bucket, then by id, CRC and size. Rows that
very many others equal in all three (null ids with empty texts) come after all others and are counted by stretches of
rows, so that no task sees them all; being interchangeable, they give the same result whichever comes first.

Nulls: a null text has size 16 and CRC 0; rows with a null id take part and stand first in their bucket. Repeated
rows are interchangeable and get places of their own. An empty table gives an empty result. Columns beyond doc_id and
text are not read. Of a text of any length only size and CRC are kept; the text is one cell and does not move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._bytes import mixed
from quern.sources.staging import staged

#: Rows meant for a bucket of the row numbering, and the most buckets there are (their counts are broadcast).
BUCKET_ROWS, MOST_BUCKETS = 1_000, 1 << 16

#: Equal rows are numbered apart beyond so many usual buckets; the logarithm of the rows of a stretch of them.
MANY, STRETCH_BITS = 4, 16

_OVERHEAD = 16


class Permutation:
    """A keyed bijection of 0..n-1: four-round-plus Feistel network on the next even number of bits; a value that
    falls outside walks on along its cycle until it is inside (less than four steps on average)."""

    ROUNDS = 6

    def __init__(self, n: int, seed: int):
        self.n = max(1, n)
        self.half = max(1, ((self.n - 1).bit_length() + 1) // 2)
        self.keys = mixed(np.arange(1, self.ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        return mixed(x + key) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        if back:
            for key in self.keys[::-1]:
                left, right = right ^ self._round(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._round(right, key)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        far = np.flatnonzero(out >= self.n)
        while far.size:
            out[far] = self._once(out[far], back)
            far = far[out[far] >= self.n]
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def row(self, places: np.ndarray) -> np.ndarray:
        """The inverse: which row stands at a place."""
        return self._walk(places, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id``, ``size``, ``text_crc32`` and a gapless ``row`` from 0 of every row, and the number of rows.

    The text is read once and does not move: only ids, sizes and CRCs are staged and shuffled, by hash bucket. The
    number of buckets follows the rows up to a fixed most, so the broadcast offsets are bounded.
    """
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data).cast("long") + _OVERHEAD).alias("size"), F.crc32(data).alias("text_crc32"))
    slim = staged(slim.withColumn("stretch", F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS)), "slim")
    n = slim.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    counts = {r.bucket: r.n for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    many = MANY * max(BUCKET_ROWS, -(-n // buckets))
    full = [b for b, k in counts.items() if k > many]
    if not full:
        return _by_bucket(dealt, counts), n
    # At most n / many kinds of rows, a quarter of the buckets, are that frequent.
    kinds = dealt.where(F.col("bucket").isin(full)).groupBy("bucket", *_KIND).agg(F.count("*").alias("n")).where(F.col("n") > many).collect()
    if not kinds:
        return _by_bucket(dealt, counts), n
    for kind in kinds:
        counts[kind.bucket] -= kind.n
    first, of = sum(counts.values()), []
    for kind in sorted(kinds, key=lambda k: (k.doc_id is not None, k.doc_id or 0, k.text_crc32, k.size)):
        of.append((kind.doc_id, kind.text_crc32, kind.size, first))
        first += kind.n
    frequent = F.broadcast(docs.sparkSession.createDataFrame(of, "id long, crc long, bytes long, first long"))
    told = dealt.join(frequent, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_crc32") == F.col("crc")) & (F.col("size") == F.col("bytes")), "left").drop("id", "crc", "bytes")
    rest = _by_bucket(told.where("first is null").drop("first"), counts)
    # ``first`` names the kind from here on.
    equal = told.where("first is not null")
    stretches = equal.groupBy("first", "stretch").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("first").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = equal.join(stretches.select("first", "stretch", before.alias("before")), ["first", "stretch"])
    inner = F.row_number().over(Window.partitionBy("first", "stretch").orderBy("size"))
    return rest.unionByName(equal.select(*_KIND, (F.col("first") + F.col("before") + inner - 1).alias("row"))), n


_KIND = ["doc_id", "size", "text_crc32"]


def _by_bucket(dealt: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Row numbers of rows in buckets of a usual size: an offset for each bucket (broadcast; bounded), and the rank inside."""
    offsets, before = [], 0
    for bucket in sorted(counts):
        offsets.append((bucket, before))
        before += counts[bucket]
    offsets = F.broadcast(dealt.sparkSession.createDataFrame(offsets, "bucket long, before long"))
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    return dealt.withColumn("inner", inner).join(offsets, "bucket").select(*_KIND, (F.col("before") + F.col("inner") - 1).alias("row"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row, with ``row``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = numbered(docs)
    permutation = Permutation(n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permutation.place(batch.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], [*batch.schema.names, "shard", "slot"])

    placed = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, row long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def locate(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """Shard and slot of a row number, computed."""
    place = int(Permutation(n, seed).place(np.array([row]))[0])
    return place % shards, place // shards


def row_at(shard_: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """Row number at a shard and slot, computed."""
    return int(Permutation(n, seed).row(np.array([slot * shards + shard_]))[0])


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 42) -> None:
    """The rows of ``docs`` (unique doc_id) as Parquet under ``path/shard=k``, by slot."""
    placed = shard(docs, shards, seed).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
