"""Benchmark decontamination: broadcast hash set of item n-grams, windows scanned in place, hits verified.

A text's words are lower-cased ASCII (A-Z) runs of letters, digits and non-ASCII characters. A window is ``size``
consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

Nulls: a null text has no words; an item with a null id or text gives no window. Repeated items with one id count as
one item, and items with one text share its windows. An empty benchmark or document table gives zero hits or no rows.
Very long texts are scanned whole, one in memory at a time; a very long item is a block of its own. Repeated rows each
give a row, whatever their ids. Other columns are passed through by ``remove`` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._bytes import ALNUM, LOWER, buffer, hashes, joined, mixed, pieces, words
from quern.sources.staging import staged

#: Bytes of benchmark text in one broadcast set. A larger benchmark is scanned in blocks of about this, one after the
#: other; a worker's windows of such a block take some 200 MB.
BLOCK_BYTES = 16 << 20

#: Row numbers, where several blocks are united.
_ROW = "__row"
_SCAN = "doc_id long, n_words long, hits array<int>, item_ids array<string>"


def _windows(word: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``size`` words from each place in ``at``."""
    h = np.full(at.size, seed, np.uint64)
    for k in range(size):
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15) + word[at + k])
    return h


class _Lengths:
    """Windows of one length: sorted hashes, each with the place of one occurrence in the block and its items."""

    def __init__(self, word: np.ndarray, at: np.ndarray, item: np.ndarray, size: int):
        # Windows are told apart by 128 bits here; what a text has is compared byte by byte with the occurrence kept.
        first_hash = _windows(word, at, size)
        order = np.lexsort((item, _windows(word, at, size, 1), first_hash))
        h, second = first_hash[order], _windows(word, at[order], size, 1)
        item = item[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
        self.hash, self.place = h[new], at[order][new].astype(np.int32)
        own = new.copy()
        own[1:] |= item[1:] != item[:-1]
        self.item = item[own].astype(np.int32)
        self.first = np.append(np.searchsorted(np.flatnonzero(own), np.flatnonzero(new)), self.item.size).astype(np.int32)
        #: One bit per residue: most windows end here.
        self.bitmap = np.zeros(1 << max(16, (8 * self.hash.size - 1).bit_length()), bool)
        self.bitmap[self.hash & np.uint64(self.bitmap.size - 1)] = True


class ItemWindows:
    """The windows of a block of items, as arrays: by length, sorted hashes, an occurrence of each, and its items."""

    def __init__(self, ids: list[str], texts: pa.Array, size: int):
        self.items = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.items)}
        data, offsets = buffer(texts)
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, ALNUM)
        word = hashes(data, starts, ends)
        count = np.bincount(owner, minlength=len(ids))
        #: The words of all items end to end, one space apart.
        text, self.starts, self.ends = joined(data, starts, ends)
        self.text = text.tobytes()
        owned = np.array([number[i] for i in ids], np.int64)
        length, first = np.minimum(size, count), np.cumsum(count) - count
        self.lengths: dict[int, _Lengths] = {}
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            each = count[of] - n + 1
            at = np.arange(int(each.sum())) + np.repeat(first[of] - (np.cumsum(each) - each), each)
            self.lengths[n] = _Lengths(word, at, np.repeat(owned[of], each), n)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """Per text: number of words, places of hit words, items with an occurring window."""
        data, offsets = buffer(texts)
        data, n_texts = LOWER[data], len(offsets) - 1
        starts, ends, owner = words(data, offsets, ALNUM)
        word = hashes(data, starts, ends)
        count = np.bincount(owner, minlength=n_texts)
        first = np.cumsum(count) - count
        hit = np.zeros(starts.size, bool)
        items: dict[int, set[int]] = {}
        for n, known in self.lengths.items():
            if starts.size < n:
                continue
            at = np.flatnonzero(owner[: starts.size - n + 1] == owner[n - 1 :])
            h = _windows(word, at, n)
            likely = np.flatnonzero(known.bitmap[h & np.uint64(known.bitmap.size - 1)])
            place = np.searchsorted(known.hash, h[likely])
            same = place < known.hash.size
            same[same] = known.hash[place[same]] == h[likely[same]]
            for p, k in zip(at[likely[same]].tolist(), place[same].tolist(), strict=True):
                text, key = b" ".join(data[starts[q] : ends[q]].tobytes() for q in range(p, p + n)), known.hash[k]
                while k < known.hash.size and known.hash[k] == key:
                    q = known.place[k]
                    if self.text[self.starts[q] : self.ends[q + n - 1]] == text:
                        hit[p : p + n] = True
                        items.setdefault(int(owner[p]), set()).update(known.item[known.first[k] : known.first[k + 1]].tolist())
                    k += 1
        places = np.flatnonzero(hit)
        cut = np.searchsorted(owner[places], np.arange(n_texts + 1))
        hits = [places[cut[k] : cut[k + 1]] - first[k] for k in range(n_texts)]
        return count, hits, [[self.items[i] for i in sorted(items.get(k, ()))] for k in range(n_texts)]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The stated query set, read to the driver one bounded block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, row.text))
        held += len(row.text.encode()) + 64
        if held >= block_bytes:
            yield block
            block, held = [], 0
    yield block


#: The windows that this Python worker has made last, and the broadcast they are of.
_MADE: dict[str, tuple[int, ItemWindows]] = {}


def _made(sent: Broadcast, number: int, size: int) -> ItemWindows:
    """Windows of a broadcast block, built once in a worker and not in each task."""
    if _MADE.get("last", (None,))[0] != number:
        _MADE.clear()
        ids, texts = sent.value
        _MADE["last"] = (number, ItemWindows(ids, texts, size))
    return _MADE["last"][1]


def _broadcast(spark: SparkSession, items: list[tuple[str, str]]) -> tuple[Broadcast, int]:
    sent = spark.sparkContext.broadcast(([i for i, _ in items], pa.array([t for _, t in items], pa.large_string())))
    return sent, uuid.uuid4().int


def _scanned(docs: DataFrame, known: tuple[Broadcast, int], size: int, row_id: str, carried: str = "") -> DataFrame:
    """``carried``: names and types of further columns that are passed through, as a schema."""
    sent, number = known
    more = [x.split()[0] for x in carried.split(",") if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _made(sent, number, size)
        for batch in batches:
            for part in pieces(batch, "text"):
                count, hits, items = windows.scan(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count), pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *(part.column(c) for c in more)], ["doc_id", "n_words", "hits", "item_ids", *more]
                )

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return rows.mapInArrow(run, f"{_SCAN}, {carried}" if carried else _SCAN)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for every row, fixed by staging, so that all blocks see the same rows."""
    return staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def _merged(numbered: DataFrame, blocks: Iterable[list[tuple[str, str]]], size: int, row_id: str) -> DataFrame:
    """What one block of all items would find in each row: hits and items of the blocks, united by row.

    Blocks are scanned one after the other, and a block's broadcast goes before the next is read. The first one keeps
    all rows, the others those with a hit.
    """
    each: list[DataFrame] = []
    for block in blocks:
        known = _broadcast(numbered.sparkSession, block)
        found = _scanned(numbered, known, size, row_id, f"{_ROW} long")
        each.append(staged(found.where(F.size("hits") > 0) if each else found, "block"))
        known[0].destroy()
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return reduce(DataFrame.unionAll, each).groupBy(_ROW, "doc_id").agg(F.max("n_words").alias("n_words"), united("hits").alias("hits"), united("item_ids").alias("item_ids"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``hits`` (places of hit words, from 0) and ``item_ids`` (as strings, sorted) per row.

    One scan without a shuffle for each block of the benchmark. Several blocks scan numbered rows, and are united by
    number, so that the result does not depend on the blocks.
    """
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, _broadcast(docs.sparkSession, first), size, "doc_id").withColumn("item_ids", F.array_sort("item_ids"))
    return _merged(_numbered(docs.select("doc_id", "text")), chain([first, second], blocks), size, "doc_id").select("doc_id", "n_words", "hits", "item_ids")


def summary(scanned: DataFrame) -> DataFrame:
    """The contract's columns, from what ``scan`` returns."""
    n_hit = F.size("hits").cast("long")
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, size: int = 10, whole_documents_from: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark passages, all columns kept: hit spans are cut out (with the text between adjacent
    hit words), and a document goes if at least ``whole_documents_from`` of its words are hit. ``n_chars``, where it
    is a column, is set to the new length. Rows without a hit stay as they are, bytes included.
    """
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _cut(docs, first, size, whole_documents_from)
    # All blocks are looked up in the original text; the words they hit are united by row, and cut once.
    numbered = _numbered(docs)
    found = _merged(numbered, chain([first, second], blocks), size, _ROW).where(F.size("hits") > 0).select(F.col(_ROW).alias("__of"), F.col("n_words").alias("__n_words"), F.col("hits").alias("__hits"))
    joined = numbered.join(staged(found, "hits"), F.col(_ROW) == F.col("__of"), "left").drop(_ROW, "__of")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                count = np.array([n or 0 for n in part.column("__n_words").to_pylist()])
                hits = [np.array(h or [], np.int64) for h in part.column("__hits").to_pylist()]
                yield _without_hits(part.select(names), count, hits, whole_documents_from)

    return joined.mapInArrow(run, docs.schema)


def _cut(docs: DataFrame, items: list[tuple[str, str]], size: int, most: float) -> DataFrame:
    sent, number = _broadcast(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _made(sent, number, size)
        for batch in batches:
            for part in pieces(batch, "text"):
                count, hits, _ = windows.scan(part.column("text"))
                yield _without_hits(part, count, hits, most)

    return docs.mapInArrow(run, docs.schema)


def _without_hits(part: pa.RecordBatch, count: np.ndarray, hits: list[np.ndarray], most: float) -> pa.RecordBatch:
    """Rows whose share of hit words is below ``most``, without those words."""
    touched = [k for k, h in enumerate(hits) if len(h)]
    if not touched:
        return part
    texts = part.column("text").to_pylist()
    for k in touched:
        texts[k] = without_words(texts[k], hits[k])
    keep = np.array([len(h) < max(1, most * c) for h, c in zip(hits, count, strict=True)])
    columns = []
    for name, column in zip(part.schema.names, part.columns, strict=True):
        if name == "text":
            column = pa.array(texts, column.type)
        elif name == "n_chars":
            old = column.to_pylist()
            for k in touched:
                old[k] = len(texts[k])
            column = pa.array(old, column.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(keep))


def without_words(text: str, hits: np.ndarray) -> str:
    """``text`` without the words at the places ``hits`` and without what stands between two adjacent ones."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(LOWER[data], np.array([0, data.size]), ALNUM)
    gone = np.zeros(data.size + 1, np.int32)
    np.add.at(gone, starts[hits], 1)
    np.add.at(gone, ends[hits], -1)
    adjacent = hits[:-1][np.diff(hits) == 1]
    np.add.at(gone, ends[adjacent], 1)
    np.add.at(gone, starts[adjacent + 1], -1)
    return data[np.cumsum(gone[:-1]) == 0].tobytes().decode()


def digest(item_ids: list[str]) -> str:
    """Digest of sorted item ids, as ``summary`` gives it."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
