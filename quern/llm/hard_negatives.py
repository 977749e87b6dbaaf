"""Hard-negative mining by exact integer inner products, several candidates to one multiplication.

Each component x of a vector becomes floor(256 x); a score is the inner product of two such vectors. An anchor's
positives are its best rows of the same label; for each, the best rows of other labels are found whose score lies in a
band below the positive's: between ``low`` and ``high`` hundredths of it.

Products are Kronecker-packed. Components are biased to be at least 0, so a sum of products is at least 0 and below
2^F, with F from the actual ranges. Candidates' components of one dimension are put into one wide integer, F bits
apart, which is multiplied by the anchor's component once; the sums over all dimensions stay in their fields, and exact
scores are unpacked and unbiased. The wide integer is the 53-bit one that a double holds exactly, so the products are a
matrix product; where not even one field fits, it is a Python integer of 1,024 fields' width at most.

How it runs. Anchors are the stated query set. They are numbered, staged, and broadcast in blocks of ``BLOCK_BYTES``,
and each block is held against all rows, which do not move: first for positives, with candidates of the anchor's label
only, then for negatives, with all others. A task sends its best of each anchor (and positive) alone, so shuffles hold
anchors times tasks, not pairs. A hot label is no key of any shuffle.

Nulls: rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do vectors of
another length with an anchor. Rows that repeat an id take part each on its own (anchors too, so that results repeat),
but none is a partner of an anchor with its own id. Ties go to the smaller id. An empty table, or one without anchors,
gives no rows; empty vectors have score 0. Finite components of any size are multiplied exactly; a score beyond 64 bits
counts as the largest or smallest long. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.staging import staged

SCALE = 256.0
#: Bytes of anchors that are broadcast at once, scores that a task holds at once, and rows that wait to be cut to the best.
BLOCK_BYTES, AT_ONCE, WAITING = 8 << 20, 1 << 21, 1 << 18
#: Bits of integers that a double holds exactly, and fields of a wider integer.
EXACT_BITS, WIDE_FIELDS = 53, 1024
_LONG = (1 << 63) - 1


def prepared(rows: DataFrame) -> DataFrame:
    """``id``, ``label``, ``vector`` of rows (vec_id, label, embedding) that may take part. Components that are null or not
    finite are found by the tasks that read the vectors."""
    out = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return out.where("id is not null and label is not null and vector is not null")


def _floored(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: their rows, and a matrix of floor(256 x). Rows with a component that is null or not
    finite are left out. Components beyond 2^40 or so make a matrix of Python integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets, flat = vectors.offsets.to_numpy().astype(np.int64), vectors.values
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    sizes = np.diff(offsets)
    fine = bad[offsets[1:]] == bad[offsets[:-1]]
    out = []
    for size in np.unique(sizes[fine]).tolist():
        at = np.flatnonzero(fine & (sizes == size))
        part = np.floor(x[(offsets[at][:, None] + np.arange(size)[None, :]).ravel()] * SCALE).reshape(at.size, size)
        if not np.isfinite(part).all():  # 256 x itself is too large for a double
            part = np.array([[math.floor(int(v) * 256) for v in x[offsets[k] : offsets[k] + size]] for k in at.tolist()], object).reshape(at.size, size)
        elif part.size and np.abs(part).max() >= 1 << 40:
            part = np.array([[int(v) for v in row] for row in part], object).reshape(at.size, size)
        out.append((at, part))
    return out


def field_bits(candidates: np.ndarray, anchors: np.ndarray) -> int:
    """Bits of a field that holds any sum of products of biased components."""
    if not candidates.size or not anchors.size:
        return 1
    span = lambda m: int(m.max()) - int(m.min())
    return max(1, (candidates.shape[1] * span(candidates) * span(anchors)).bit_length())


def _whole(m: np.ndarray) -> np.ndarray:
    """As Python integers."""
    return m if m.dtype == object else m.astype(np.int64).astype(object)


def packed_scores(candidates: np.ndarray, anchors: np.ndarray, bits: int = 0) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers of one width, a row for each candidate: exact, and
    clipped to 64 bits. ``bits``: least width of a field, for tests."""
    n, m = len(candidates), len(anchors)
    if not n or not m or not candidates.shape[1]:
        return np.zeros((n, m), np.int64)
    bits = max(bits, field_bits(candidates, anchors))
    narrow = bits <= EXACT_BITS and candidates.dtype != object and anchors.dtype != object
    # What the biases took away is added in 64 bits.
    narrow = narrow and candidates.shape[1] * float(np.abs(candidates).max()) * float(np.abs(anchors).max()) < 1 << 60
    fields = min(n, EXACT_BITS // bits if narrow else WIDE_FIELDS)
    if not narrow:
        candidates, anchors = _whole(candidates), _whole(anchors)
    low_c, low_a = candidates.min(), anchors.min()
    groups = -(-n // fields)
    biased = np.zeros((groups * fields, candidates.shape[1]), candidates.dtype)
    biased[:n] = candidates - low_c
    # Row g + k * groups is field k of the wide integers of group g.
    packed = biased[:groups].copy()
    for k in range(1, fields):
        packed += biased[k * groups : (k + 1) * groups] * (2.0 ** (bits * k) if narrow else 1 << bits * k)
    products = packed @ (anchors - low_a).T
    whole = np.int64 if narrow else object
    products = products.astype(whole)
    found = np.concatenate([(products >> bits * k) & ((1 << bits) - 1) for k in range(fields)])[:n]
    by_candidate, by_anchor = biased[:n].sum(axis=1).astype(whole), anchors.sum(axis=1).astype(whole)
    found = found + int(low_a) * by_candidate[:, None] + int(low_c) * by_anchor[None, :]
    return found if narrow else np.clip(found, -_LONG - 1, _LONG).astype(np.int64)


class _Best:
    """The best ``k`` rows of each group so far: parallel arrays of group, id and score; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held, self.n, self.most = k, [(np.zeros(0, np.int64),) * 3], 0, WAITING

    def add(self, group: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        self.held.append((group, id_, score))
        self.n += group.size
        if self.n > self.most:
            self.held = [self.cut()]
            self.n = self.held[0][0].size
            self.most = max(WAITING, 2 * self.n)

    def cut(self) -> tuple[np.ndarray, ...]:
        group, id_, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((id_, ~score, group))
        group, id_, score = group[order], id_[order], score[order]
        keep = np.arange(group.size) - np.searchsorted(group, group) < self.k
        return group[keep], id_[keep], score[keep]


def _reach(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that fit and are among the best ``k`` of their column, with ties."""
    if len(scores) > k:
        held = np.where(fit, scores, -_LONG - 1)
        fit = fit & (held >= np.partition(held, len(held) - k, axis=0)[len(held) - k])
    return np.nonzero(fit)


class _Anchors:
    """A block of anchors in a task, by length of their vectors."""

    def __init__(self, block: pa.Table):
        self.id, self.label = (block[c].to_numpy() for c in ("id", "label"))
        self.of = dict()
        for at, m in _floored(block["vector"]):
            self.of[m.shape[1]] = at, m

    def scores(self, batch: pa.RecordBatch, same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates' ids, anchors' places and scores of each label's candidates with the anchors of the same, or of
        the other labels."""
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for at, vectors in _floored(batch.column("vector")):
            if vectors.shape[1] not in self.of:
                continue
            where, anchors = self.of[vectors.shape[1]]
            for label in np.unique(labels[at]).tolist():
                own = np.flatnonzero((self.label[where] == label) == same_label)
                rows = np.flatnonzero(labels[at] == label)
                if not own.size:
                    continue
                step = max(1, AT_ONCE // own.size)
                for lo in range(0, rows.size, step):
                    some = rows[lo : lo + step]
                    yield ids[at[some]], where[own], packed_scores(vectors[some], anchors[own])


def _against(rows: DataFrame, anchors: DataFrame, size: int, schema: str, work: Callable) -> DataFrame:
    """``work(block, batches)`` of all rows for each block of anchors (a table with a column ``number``), whose results
    are staged, so that a block's broadcast goes before the next is read. ``size``: bytes of all anchors."""
    n, out = max(1, -(-size // BLOCK_BYTES)), []
    for k in range(n):
        block = (anchors if n == 1 else anchors.where(F.pmod(F.xxhash64("number"), F.lit(n)) == k)).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast(block)
        out.append(staged(rows.mapInArrow(lambda batches, sent=sent: work(sent.value, batches), schema), "best"))
        sent.destroy()
    return reduce(DataFrame.unionAll, out)


def _top(rows: DataFrame, by: list[str], k: int, place: str) -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "found"))).where(F.col(place) <= k)


def mine(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: for each row (vec_id,
    label, embedding) that ``is_anchor`` (SQL over ``id`` and ``label``) and each of its best ``positives`` rows of the same
    label, the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    """
    given = prepared(rows)
    anchors = staged(given.where(is_anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64 + 16 * positives), F.lit(0))).first()[0]

    def near(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = _Anchors(block), _Best(positives)
        for batch in batches:
            for ids, at, scores in held.scores(batch, True):
                row, col = _reach(scores, ids[:, None] != held.id[at][None, :], positives)
                best.add(at[col], ids[row], scores[row, col])
        group, ids, scores = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block["number"].to_numpy()[group]), pa.array(ids), pa.array(scores)], ["number", "found", "score"])

    best = _top(_against(given, anchors, size, "number long, found long, score long", near), ["number"], positives, "place")
    best = staged(best.select("number", "place", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bars = best.groupBy("number").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("bars"))

    def far(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = _Anchors(block), _Best(negatives)
        # By place: which anchors have a positive there, and the bounds of its negatives' scores.
        floor, ceiling = (np.full((positives, block.num_rows), v) for v in (_LONG, -_LONG - 1))
        for a, bars in enumerate(block["bars"].to_pylist()):
            for bar in bars:
                floor[bar["place"] - 1, a] = max(-_LONG - 1, min(_LONG, -(-low * bar["score"] // 100)))
                ceiling[bar["place"] - 1, a] = max(-_LONG - 1, min(_LONG, high * bar["score"] // 100))
        for batch in batches:
            for ids, at, scores in held.scores(batch, False):
                other = ids[:, None] != held.id[at][None, :]
                for place in range(positives):
                    fit = other & (scores >= floor[place, at]) & (scores <= ceiling[place, at])
                    row, col = _reach(scores, fit, negatives)
                    best.add(at[col] * positives + place, ids[row], scores[row, col])
        group, ids, scores = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block["number"].to_numpy()[group // positives]), pa.array((group % positives + 1).astype(np.int32)), pa.array(ids), pa.array(scores)], ["number", "place", "found", "score"])

    found = _against(given, anchors.join(bars, "number"), size, "number long, place int, found long, score long", far)
    found = _top(found, ["number", "place"], negatives, "rank").select("number", "place", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(best, ["number", "place"]).join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
