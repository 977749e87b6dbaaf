"""Exact sparse top-k over document-partitioned inverted lists with block maxima.

An index is a table of blocks of documents. A block has its inverted lists (buckets, the documents that have each, and
their weights) and the largest weight of each bucket, so it bounds what any of its documents can score with a query.
A query passes over a block whose bound does not reach the k-th best score that it has found elsewhere. Documents are
dealt to blocks by falling total weight, so that scores fall from block to block and the bounds with them; the first
block of each task's share is scored ahead, for thresholds that hold over all tasks. Nothing is approximate: a block
is left out only if none of its documents can be among the best k, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import _Best, _blocks, _flat, _plain, raise_bars, top_k
from quern.sources.staging import staged

#: Documents of a block.
BLOCK_ROWS = 256
_INDEX = "no int, ids binary, buckets binary, most binary, starts binary, places binary, weights binary"
_FOUND = "query_id long, id long, score double, blocks long, skipped long"


def inverted_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of rows (id, pairs: array of idx and w, w at least 0), staged: a row for each block, numbered within its
    task's share. Rows stay in their partition, sorted by falling total weight. Rows with a null id have no place in it;
    rows without pairs score nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held, n = 0, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                yield _block(no, table.slice(0, block_rows))
                no, n = no + 1, n - block_rows
                held = table.slice(block_rows).to_batches() if n else []
        if n:
            yield _block(no, pa.Table.from_batches(held))

    total = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["w"])
    given = rows.select(F.col("id").cast("long").alias("id"), "pairs").withColumn("_total", total).where("id is not null")
    # Sorting comes before the rows are cut, so that pairs are computed once.
    return staged(given.sortWithinPartitions(F.col("_total").desc(), "id").select("id", "pairs").mapInArrow(run, _INDEX), "blocks")


def _block(no: int, table: pa.Table) -> pa.RecordBatch:
    of, idx, w = _flat(_plain(table["pairs"]))
    order = np.argsort(idx, kind="stable")
    of, idx, w = of[order], idx[order], w[order]
    buckets, first = np.unique(idx, return_index=True)
    starts = np.append(first, idx.size)
    most = np.maximum.reduceat(w, first) if first.size else w
    blobs = [table["id"].to_numpy().astype("<i8"), buckets.astype("<i8"), most.astype("<f8"), starts.astype("<i4"), of.astype("<i4"), w.astype("<f8")]
    return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], [f.split(" ")[0] for f in _INDEX.split(", ")])


class _Queries:
    """A broadcast block of queries by bucket, and what scores they must reach."""

    def __init__(self, block: pa.Table, bars: dict[int, float]):
        self.number = block["query_id"].to_numpy()
        of, idx, w = _flat(_plain(block["pairs"]))
        order = np.argsort(idx, kind="stable")
        self.of, self.w = of[order], w[order].astype(np.float64)
        self.bucket, self.first, self.each = np.unique(idx[order], return_index=True, return_counts=True)
        self.bars = np.array([bars.get(int(q), 0.0) for q in self.number])

    def pairs(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``buckets`` and in the queries' entries of all entries with equal buckets."""
        if not self.bucket.size or not buckets.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.bucket, buckets).clip(max=self.bucket.size - 1)
        hit = np.flatnonzero(self.bucket[at] == buckets)
        n = self.each[at[hit]]
        return np.repeat(hit, n), np.arange(int(n.sum())) + np.repeat(self.first[at[hit]] - (np.cumsum(n) - n), n)

    def scores(self, row: dict) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """Results of a block, and which queries have a bucket in it and which of them it was scored for."""
        read = lambda c, kind: np.frombuffer(row[c], kind)
        buckets, starts = read("buckets", "<i8"), read("starts", "<i4")
        hit, entry = self.pairs(buckets)
        bound = np.bincount(self.of[entry], read("most", "<f8")[hit] * self.w[entry], self.number.size)
        met = np.zeros(self.number.size, bool)
        met[self.of[entry]] = True
        # Scores are rounded to six digits; bounds may be off by the last bits of a sum.
        active = met & (bound * (1 + 1e-12) + 1e-6 >= self.bars)
        some = active[self.of[entry]]
        hit, entry = hit[some], entry[some]
        n = (starts[1:] - starts[:-1])[hit]
        place = np.arange(int(n.sum())) + np.repeat(starts[hit] - (np.cumsum(n) - n), n)
        ids = read("ids", "<i8")
        local = np.cumsum(active) - 1
        key = np.repeat(local[self.of[entry]], n) * ids.size + read("places", "<i4")[place]
        s = np.round(np.bincount(key, np.repeat(self.w[entry], n) * read("weights", "<f8")[place], int(active.sum()) * ids.size), 6)
        at = np.flatnonzero(s)
        of, doc = np.flatnonzero(active)[at // max(1, ids.size)], at % max(1, ids.size)
        return (self.number[of], ids[doc], s[at]), met, active


def _searched(index: DataFrame, block: pa.Table, bars: dict[int, float], k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((block, bars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = _Queries(*sent.value), _Best(k, len(sent.value[0]))
        blocks, skipped = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                found, met, active = queries.scores(row)
                blocks, skipped = blocks + int(met.sum()), skipped + int((met & ~active).sum())
                if found[0].size:
                    best.add(*found)
                    best.held = [best.cut()]
                    raise_bars(queries.bars, queries.number, best.held[0], k)
        number, ids, score = best.cut()
        none = pa.nulls(number.size, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids), pa.array(score), none, none], [f.split(" ")[0] for f in _FOUND.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([blocks]), pa.array([skipped])], [f.split(" ")[0] for f in _FOUND.split(", ")])

    return index.mapInArrow(run, _FOUND)


def inverted_search(queries: DataFrame, index: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` documents of each stated query (query_id, pairs; weights at least 0) with ``rank``, ties by id; and one
    row of ``blocks`` (pairs of a query and a block that share a bucket) and ``skipped`` (those that were not scored).

    Queries are broadcast in blocks of bounded bytes, each with one number for a query. Repeated query ids are searched as
    one query each only if their pairs are equal; give each its own id.
    """
    own, out = queries.select(F.col("query_id").cast("long").alias("query_id"), "pairs"), []
    for block in _blocks(own, F.size("pairs") * 16 + 16)[1]:
        ahead = top_k(_searched(index.where("no = 0"), block, {}, k).where("id is not null"), k)
        bars = {r[0]: r[1] for r in ahead.where(F.col("rank") == k).select("query_id", "score").collect()}
        out.append(staged(_searched(index, block, bars, k), "found"))
    found = reduce(DataFrame.unionAll, out)
    best = top_k(found.where("id is not null").select("query_id", "id", "score"), k)
    return best, found.agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))
