"""Exact dense top-k with blocks of vectors that are passed over by the triangle inequality.

An index has blocks of unit vectors, near to each other as far as a task's share allows: rows are sorted by their nearest
pivot and their angle to it. A block knows, for each pivot, the least and largest angle of its vectors to it. A query
whose angle to a pivot is t meets none of them at less than max(t - largest, least - t), so the block's best cosine is
bounded by the sharpest pivot, and a block that cannot reach a query's k-th best score is not multiplied. For scores to
begin with, each query is first held against the few blocks with its best bounds. Nothing is approximate.

Pivots are chosen from a bounded sample (``SAMPLE`` rows, the farthest from all before each time); they make the bounds
sharp or not, and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.retrieval import _Best, _blocks, _plain, _unit, raise_bars, top_k
from quern.sources.staging import staged

#: Rows of the sample that pivots are chosen from, pivots, rows of a block, and blocks that each query is held against first.
SAMPLE, PIVOTS, BLOCK_ROWS, FIRST = 2048, 32, 256, 2
#: What rounding may take from an angle or a cosine.
_SLACK = 1e-7
_INDEX = "block string, dimension int, ranges binary, ids binary, vectors binary"
_FOUND = "query_id long, id long, score double, blocks long, skipped long"


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of the commonest length in the sample of rows (id, embedding) with the smallest hashes."""
    few = vectors.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    column = _plain(few["embedding"])
    sizes = np.diff(column.offsets.to_numpy())
    if not sizes.size:
        return np.zeros((0, 0))
    unit, _ = _unit(column, int(np.bincount(sizes).argmax()))
    unit = unit[np.isfinite(unit).all(axis=1)]
    picked, near = [0] if len(unit) else [], unit @ unit[0] if len(unit) else np.zeros(0)
    while picked and len(picked) < min(n, len(unit)) and near.min() < 1 - _SLACK:
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    return unit[picked]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def vector_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS, pivots: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """The index of rows (id, embedding), staged, and its pivots. Rows stay in their partition. Rows with a null id or
    vector, or a vector of another length than the pivots', have no place in it."""
    pivots = choose_pivots(vectors) if pivots is None else pivots
    dimension = pivots.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ok = _unit(batch.column("embedding"), dimension)
            angle = _angles(unit, pivots)
            nearest = angle.argmin(axis=1) if len(pivots) else np.zeros(0, np.int64)
            own = angle[np.arange(len(unit)), nearest]
            offsets = np.arange(len(unit) + 1, dtype=np.int32) * dimension
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ok)), pa.array(nearest.astype(np.int32)), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))], ["id", "pivot", "angle", "unit"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        task = uuid.uuid4().hex
        ids, units, number = [], [], 0
        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            units.append(batch.column("unit").flatten().to_numpy().reshape(-1, dimension))
            while sum(map(len, ids)) >= block_rows:
                i, u = np.concatenate(ids), np.concatenate(units)
                yield block(f"{task}-{number}", i[:block_rows], u[:block_rows])
                ids, units, number = [i[block_rows:]], [u[block_rows:]], number + 1
        if sum(map(len, ids)):
            yield block(f"{task}-{number}", np.concatenate(ids), np.concatenate(units))

    def block(name: str, ids: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        angle = _angles(unit, pivots)
        ranges = np.stack([angle.min(axis=0), angle.max(axis=0)]) if len(unit) else np.zeros((2, len(pivots)))
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ranges.astype("<f8"), ids.astype("<i8"), unit.astype("<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([dimension], pa.int32()), *blobs], [f.split(" ")[0] for f in _INDEX.split(", ")])

    rows = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    near = rows.mapInArrow(placed, "id long, pivot int, angle double, unit array<double>")
    return staged(near.sortWithinPartitions("pivot", "angle", "id").mapInArrow(cut, _INDEX), "vectors"), pivots


class _Queries:
    def __init__(self, block: pa.Table, pivots: np.ndarray, bars: dict[int, float]):
        self.unit, ok = _unit(_plain(block["embedding"]), pivots.shape[1])
        self.number = block["query_id"].to_numpy()[ok]
        self.angle = _angles(self.unit, pivots)
        self.bars = np.array([bars.get(int(q), -2.0) for q in self.number])

    def bounds(self, ranges: bytes) -> np.ndarray:
        """The largest cosine that a vector of a block may have with each query."""
        least, most = np.frombuffer(ranges, "<f8").reshape(2, -1)
        apart = np.maximum(self.angle - most, least - self.angle).max(axis=1, initial=0)
        return np.cos(np.clip(apart - _SLACK, 0, np.pi)) + _SLACK


def _searched(index: DataFrame, block: pa.Table, pivots: np.ndarray, bars: dict[int, float], k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((block, pivots, bars))
    names = [f.split(" ")[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = _Queries(*sent.value), _Best(k, len(sent.value[0]))
        blocks, skipped = 0, 0
        for batch in batches:
            for ranges, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("ranges", "ids", "vectors")), strict=True):
                active = np.flatnonzero(queries.bounds(ranges) + 1e-6 >= queries.bars)
                blocks, skipped = blocks + queries.number.size, skipped + queries.number.size - active.size
                ids = np.frombuffer(ids, "<i8")
                s = np.round(np.frombuffer(vectors, "<f8").reshape(ids.size, -1) @ queries.unit[active].T, 6) + 0.0
                row, col = np.nonzero(s >= queries.bars[active][None, :])
                if row.size:
                    best.add(queries.number[active][col], ids[row], s[row, col])
                    best.held = [best.cut()]
                    raise_bars(queries.bars, queries.number, best.held[0], k)
        number, ids, score = best.cut()
        none = pa.nulls(number.size, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids), pa.array(score), none, none], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([blocks]), pa.array([skipped])], names)

    return index.mapInArrow(run, _FOUND)


def _nearest(index: DataFrame, block: pa.Table, pivots: np.ndarray, n: int = FIRST) -> DataFrame:
    """``block``: the names of the blocks with the best bounds of each query. Reads no vectors."""
    sent = index.sparkSession.sparkContext.broadcast((block, pivots, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _Queries(*sent.value)
        best = [(np.full(queries.number.size, -9.0), np.full(queries.number.size, "", object)) for _ in range(n)]
        for batch in batches:
            for name, ranges in zip(batch.column("block").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                bound, names = queries.bounds(ranges), np.full(queries.number.size, name, object)
                for value, held in best:
                    more = bound > value
                    value[more], bound[more], held[more], names[more] = bound[more], value[more], names[more], held[more]
        for value, held in best:
            some = held != ""
            yield pa.RecordBatch.from_arrays([pa.array(queries.number[some]), pa.array(held[some].tolist(), pa.string()), pa.array(value[some])], ["query_id", "block", "bound"])

    found = index.select("block", "ranges").mapInArrow(run, "query_id long, block string, bound double")
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("block").distinct()


def pivot_search(queries: DataFrame, index: DataFrame, pivots: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` vectors of each stated query (query_id, embedding; ids are its own) by cosine, with ``rank``, ties by id;
    and one row of ``blocks`` (pairs of a query and a block) and ``skipped`` (those that were not multiplied)."""
    own, out = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), []
    for block in _blocks(own, F.size("embedding") * 8 + 16)[1]:
        first = index.join(_nearest(index, block, pivots), "block", "left_semi").select(*index.columns)
        ahead = top_k(_searched(first, block, pivots, {}, k).where("id is not null"), k)
        bars = {r[0]: r[1] for r in ahead.where(F.col("rank") == k).select("query_id", "score").collect()}
        out.append(staged(_searched(index, block, pivots, bars, k), "found"))
    found = reduce(DataFrame.unionAll, out)
    best = top_k(found.where("id is not null").select("query_id", "id", "score"), k)
    return best, found.agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))
