"""Retrieval legs, fusion, ranking and comparison. Scores are rounded to six digits before they rank; ties go by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import dot, l2_normalize
from quern.sources.staging import staged

#: Bytes of queries that are broadcast at once, and scores that a task holds at once.
BROADCAST_BYTES, AT_ONCE = 32 << 20, 1 << 21
#: A bucket that one query in so many has is scored by matrix products, in as many bytes of queries at most.
COMMON, COMMON_BYTES = 8, 32 << 20
#: So many queries have some rows scored ahead: about so many, or one in so many if that is more.
MANY, AHEAD_ROWS, AHEAD_SHARE = 1024, 8192, 128
#: Groups that the buckets without a matrix product are bounded by; scores are worked out one by one if so few are left.
GROUPS, FEW = 16, 8
#: Bounds are as much above what they bound as sums and the rounding of scores may take from it.
_SLACK, _ROUNDING = 1e-9, 1e-6


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", id_column: str = "id") -> DataFrame:
    """Best ``k`` per query with ``rank`` from 1; ties by id. Spark limits groups before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_column))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def raise_bars(bars: np.ndarray, numbers: np.ndarray, best: tuple[np.ndarray, ...], k: int) -> None:
    """Sets each query's bar to its k-th best score, where it has so many and that is more. best: sorted by query."""
    number, _, score = best
    if number.size:
        last = np.flatnonzero(np.append(number[1:] != number[:-1], True))
        full = np.diff(np.append(-1, last)) >= k
        order = np.argsort(numbers)
        where = order[np.searchsorted(numbers, number[last[full]], sorter=order)]
        bars[where] = np.maximum(bars[where], score[last[full]])


class _Best:
    """The best ``k`` of each query so far: parallel arrays, cut back whenever they have grown; ties by id."""

    def __init__(self, k: int, queries: int):
        self.k, self.most, self.ahead = k, max(1 << 16, 4 * k * queries), max(1 << 16, k * queries // 2)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, *rows: np.ndarray) -> None:
        self.held.append(rows)
        if sum(x[0].size for x in self.held) > self.most:
            self.held = [self.cut()]

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, id_, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(query.size) - first < self.k
        return query[keep], id_[keep], score[keep]

    def raised(self, bars: np.ndarray, numbers: np.ndarray) -> None:
        """Raises the bars, once there is so much new that it pays; at first, as soon as there is anything."""
        if sum(x[0].size for x in self.held[1:]) > self.ahead or not np.isfinite(bars).any():
            self.held = [self.cut()]
            raise_bars(bars, numbers, self.held[0], self.k)


def _reaching(s: np.ndarray, bars: np.ndarray, k: int, some: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores (rows by queries) that may be among a query's best ``k``: those that reach its bar or, where a
    query has none yet, the k-th best here; ties stay."""
    if s.shape[0] > k:
        without = np.flatnonzero(~np.isfinite(bars))
        if without.size:
            bars = bars.copy()
            found = np.where(some if some is True else some[:, without], s[:, without], -np.inf)
            bars[without] = np.partition(found, s.shape[0] - k, axis=0)[s.shape[0] - k]
    return np.nonzero(~(s < bars) & some)


def _blocks(queries: DataFrame, size: Column) -> tuple[int, Iterator[pa.Table], int]:
    """How many blocks of about ``BROADCAST_BYTES`` the stated queries make, these, and how many queries there are; ``size``:
    bytes of one. Queries are staged, so that what they are derived from is read once."""
    queries = staged(queries, "queries")
    total, many = queries.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // BROADCAST_BYTES))
    return n, ((queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)).toArrow() for k in range(n)), many


def _against_all(rows: DataFrame, queries: tuple[int, Iterator[pa.Table], int], scorer: Callable, k: int | None, weight: Column) -> DataFrame:
    """Scores of all rows with each block of queries, which is broadcast; rows do not move. With ``k``, a task sends
    only its best ``k`` of each query, and its k-th best score so far is the bar for what comes. Where queries are many,
    some rows, chosen by hash in proportion to their ``weight``, are scored first: bars that hold in all tasks.
    scorer(block, bars) -> (ids of queries, bars of these, function from a batch and bars to query, id, score)."""
    names, (n, blocks, many) = ["query_id", "id", "score"], queries
    first = k is not None and many >= MANY
    if first:
        rows = staged(rows.withColumn("weight", F.coalesce(weight, F.lit(0.0))), "rows")
        count, total = rows.agg(F.count("*"), F.sum("weight")).first()
        part = F.col("weight") * max(AHEAD_ROWS, count // AHEAD_SHARE) / (total or 1.0)
        chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * float(1 << 30)
    elif n > 1:
        rows = staged(rows, "rows")

    def scored(some: DataFrame, block: pa.Table, given: pa.Table | None = None) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((block, given))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, given = sent.value
            numbers, bars, score = scorer(block, _bars(block["query_id"].to_numpy(), given))
            best, bars = (None, None) if k is None else (_Best(k, numbers.size), bars)
            for batch in batches:
                for found in score(batch, bars):
                    if best is None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
                    elif found[0].size:
                        best.add(*found)
                        best.raised(bars, numbers)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.cut()], names)

        return some.mapInArrow(run, "query_id long, id long, score double")

    out = []
    for block in blocks:
        if first:
            found = staged(top_k(scored(rows.where(chosen), block), k), "ahead")
            bars = found.where(F.col("rank") == k).select("query_id", "score").toArrow()
            out += [found.select(names), scored(rows.where(~chosen), block, bars)]
        else:
            out.append(scored(rows, block))
    return reduce(DataFrame.unionAll, out)


def _bars(numbers: np.ndarray, given: pa.Table | None) -> np.ndarray:
    """The bars given (query_id, score), in the order of the queries' numbers; where there is none, minus infinity."""
    bars = np.full(numbers.size, -np.inf)
    if given is not None and given.num_rows:
        of, score = given["query_id"].to_numpy(), given["score"].to_numpy()
        order = np.argsort(of)
        at = np.searchsorted(of, numbers, sorter=order).clip(max=of.size - 1)
        has = of[order[at]] == numbers
        bars[has] = score[order[at[has]]]
    return bars


def _below(bars: np.ndarray) -> np.ndarray:
    """What a bound must reach, so that rounding takes nothing that reaches the bar."""
    return bars - _ROUNDING - _SLACK * np.where(np.isfinite(bars), abs(bars), 0.0)


def _unit(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (a zero vector stays), and which of the rows have this dimension."""
    sizes = np.diff(vectors.offsets.to_numpy())
    ok = np.flatnonzero((sizes == dimension) & ~vectors.is_null().to_numpy(zero_copy_only=False))
    x = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(ok.size, dimension)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1), ok


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def dense_scores(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """Cosine of every stated query with every vector, or with ``k`` of the best of each task: ``query_id``, ``id``, ``score``.

    queries: query_id, embedding; vectors: id, embedding; ids are whole numbers. Vectors of another length than the
    queries' or null ones have no score. Products are matrix products over a batch, in double.
    """

    def scorer(block: pa.Table, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        wanted = _plain(block["embedding"])
        dimension = int(np.diff(wanted.offsets.to_numpy()).max(initial=0))
        q, ok = _unit(wanted, dimension)
        number = block["query_id"].to_numpy()[ok]

        def score(batch: pa.RecordBatch, bars: np.ndarray | None) -> Iterator[tuple]:
            v, ok = _unit(batch.column("embedding"), dimension)
            ids = batch.column("id").to_numpy()[ok]
            step = max(1, AT_ONCE // max(1, number.size))
            for lo in range(0, ids.size, step):
                s = v[lo : lo + step] @ q.T
                if k is not None and np.isfinite(bars).all():
                    # Few reach their bar, and only these are rounded.
                    row, col = np.nonzero(~(s < bars - _ROUNDING))
                    found = np.round(s[row, col], 6) + 0.0
                    some = np.flatnonzero(~(found < bars[col]))
                    row, col, found = row[some], col[some], found[some]
                else:
                    s = np.round(s, 6) + 0.0
                    row, col = (x.ravel() for x in np.indices(s.shape)) if k is None else _reaching(s, bars, k)
                    found = s[row, col]
                yield number[col], ids[lo : lo + step][row], found

        return number, bars[ok], score

    own = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    return _against_all(rows, _blocks(own, F.size("embedding") * 8 + 16), scorer, k, F.lit(1.0))


def sparse_scores(queries: DataFrame, rows: DataFrame, k: int | None = None) -> DataFrame:
    """Sparse dot products of stated queries with all rows that share a bucket: ``query_id``, ``id``, ``score``; or, with
    ``k``, each task's best ``k`` of each query. A row's pairs are together, so its scores need no shuffle.

    queries: query_id, pairs; rows: id, pairs (arrays of idx and w, as ``text.sparse_rows`` gives them); ids are whole
    numbers. Without ``k`` the result has a row for every query and every row that shares a bucket with it: that is what is asked for.
    With ``k``, what cannot reach a query's bar is passed over: rows by their length (a product of two vectors is at most that
    of their lengths), then pairs by the exact product over common buckets and the lengths in groups of the others.
    """

    def scorer(block: pa.Table, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        known = _Sparse(block, bars)
        return known.number, known.bars, lambda batch, bars: known.scores(batch, bars, k)

    # No filter on pairs: it would be pushed down and have them computed twice. Null ones score nothing.
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), "pairs")
    given = rows.select(F.col("id").cast("long").alias("id"), "pairs").where("id is not null")
    # Long rows have the best scores; by their squared lengths, each kind of text has its share of those scored first.
    square = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["w"] * p["w"])
    return _against_all(given, _blocks(own, F.size("pairs") * 16 + 16), scorer, k, square)


class _Sparse:
    """A block of queries by bucket, those first that short rows can reach the bars of."""

    def __init__(self, block: pa.Table, bars: np.ndarray):
        self.number, self.bars = block["query_id"].to_numpy(), bars
        of, idx, w = _once(*_flat(_plain(block["pairs"])))
        n = self.number.size
        self.length = np.sqrt(_sums(of, w * w, n))
        order = np.argsort(self.needed(bars), kind="stable")
        self.number, self.bars, self.length = self.number[order], bars[order], self.length[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        of = place[of]
        by_query = np.argsort(of, kind="stable")
        order = np.argsort(idx, kind="stable")
        self.of, self.w = of[order], w[order]
        self.bucket, self.first, self.each = np.unique(idx[order], return_index=True, return_counts=True)
        # The same by query, for scores one by one.
        self.entry, self.entry_w = np.searchsorted(self.bucket, idx[by_query]), w[by_query]
        self.entries = np.bincount(of, minlength=n)
        self.entry_first = np.cumsum(self.entries) - self.entries
        # Buckets that many queries have, by matrix products; a query's weights of them side by side.
        common = np.argsort(-self.each, kind="stable")[: COMMON_BYTES // (8 * max(1, n))]
        common = common[self.each[common] * COMMON >= n]
        self.common, self.slot = common.size, np.full(self.bucket.size, -1)
        self.slot[common] = np.arange(common.size)
        slot = np.repeat(self.slot, self.each)
        self.wide = _sums(slot[slot >= 0] * n + self.of[slot >= 0], self.w[slot >= 0], self.common * n).reshape(self.common, n)
        # The others in groups: a product is at most that of the lengths in each, added up.
        rare = slot < 0
        self.group = np.arange(self.bucket.size) % GROUPS
        self.lengths = np.sqrt(_sums((np.repeat(self.group, self.each) * n + self.of)[rare], self.w[rare] ** 2, GROUPS * n)).reshape(GROUPS, n)
        self.laid = max(1, AT_ONCE // max(1, self.bucket.size))
        self.rows = np.zeros(self.laid * self.bucket.size)
        # Buckets' places by a table, where their numbers are small enough for one.
        self.table = None
        if self.bucket.size and self.bucket[0] >= 0 and self.bucket[-1] < AT_ONCE:
            self.table = np.full(self.bucket[-1] + 2, -1, np.int32)
            self.table[self.bucket] = np.arange(self.bucket.size)

    def needed(self, bars: np.ndarray) -> np.ndarray:
        """How long a row must be at least to reach each query's bar."""
        plain = np.isfinite(self.length) & (self.length > 0)
        return np.where(plain, _below(bars) / np.where(plain, self.length, 1.0), np.where(self.length == 0, np.inf, -np.inf))

    def scores(self, batch: pa.RecordBatch, bars: np.ndarray | None, k: int | None) -> Iterator[tuple]:
        """Query, id and score of all pairs in a batch that share a bucket; with ``k``, of those that may be among the best."""
        if not self.bucket.size:
            return
        of, idx, w = _once(*_flat(batch.column("pairs")))
        every = np.bincount(of, minlength=batch.num_rows)
        begin, rows = np.cumsum(every) - every, np.flatnonzero(every)
        if k is not None:
            length = np.sqrt(_sums(of, w * w, batch.num_rows))
            rows = rows[~(length[rows] < self.needed(bars).min())]
            rows = rows[np.argsort(-length[rows], kind="stable")]
        ids = batch.column("id").to_numpy()
        step = max(1, AT_ONCE // max(1, self.number.size, self.common, GROUPS))
        # Long rows come first and few at a time: they meet more queries than the others.
        lo, size = 0, step if k is None else min(step, 32)
        while lo < rows.size:
            some = rows[lo : lo + size]
            lo, size = lo + some.size, min(step, 2 * size)
            place = _ranges(begin[some], every[some])
            part = self.met(np.repeat(np.arange(some.size), every[some]), idx[place], w[place])
            narrow = self.narrow(some.size, *part)
            found = None if k is None else self.few(some.size, narrow, part, bars, length[some[0]])
            if found is None:
                s = self.whole(some.size, narrow, *part)
                row, col = np.nonzero(s) if k is None else _reaching(s, bars, k, s != 0)
                found = row, col, s[row, col]
            row, col, s = found
            yield self.number[col], ids[some[row]], s

    def met(self, of: np.ndarray, idx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, bucket's place and weight of those pairs of rows whose bucket a query has."""
        if self.table is not None:
            # What is below or above all buckets is looked up in the last place, which no bucket has.
            at = self.table[np.where((idx >= 0) & (idx < self.table.size), idx, self.table.size - 1)]
            hit = np.flatnonzero(at >= 0)
        else:
            at = np.searchsorted(self.bucket, idx).clip(max=self.bucket.size - 1)
            hit = np.flatnonzero(self.bucket[at] == idx)
        return of[hit], at[hit].astype(np.int64), w[hit]

    def narrow(self, n: int, of: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rows' weights of the common buckets side by side."""
        often = self.slot[at] >= 0
        return _sums(of[often] * self.common + self.slot[at[often]], w[often], n * self.common).reshape(n, self.common)

    def whole(self, n: int, narrow: np.ndarray, of: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of all rows with all queries."""
        s = (narrow @ self.wide).ravel()
        rare = self.slot[at] < 0
        of, at, w = of[rare], at[rare], w[rare]
        for a, b in _slices(self.each[at]):
            each = self.each[at[a:b]]
            place = _ranges(self.first[at[a:b]], each)
            s += _sums(np.repeat(of[a:b], each) * self.number.size + self.of[place], np.repeat(w[a:b], each) * self.w[place], s.size)
        return np.round(s, 6).reshape(n, self.number.size)

    def few(self, n: int, narrow: np.ndarray, part: tuple[np.ndarray, ...], bars: np.ndarray, longest: float) -> tuple[np.ndarray, ...] | None:
        """Row, query and score of what reaches the bars, if bounds leave few pairs; else none."""
        if not np.isfinite(bars).any():
            return None
        reached = np.flatnonzero(~(longest < self.needed(bars)))
        m = int(reached[-1]) + 1 if reached.size else 0
        of, at, w = part
        rare = self.slot[at] < 0
        lengths = np.sqrt(_sums(of[rare] * GROUPS + self.group[at[rare]], w[rare] ** 2, n * GROUPS)).reshape(n, GROUPS)
        bound = narrow @ self.wide[:, :m]
        bound += lengths @ self.lengths[:, :m]
        row, col = np.nonzero(~(bound < _below(bars[:m])))
        if row.size * FEW > n * self.number.size:
            return None
        # Some rows at a time are laid out over all buckets, and the queries' entries are looked up there.
        s, begin, wide = np.zeros(row.size), np.searchsorted(of, np.arange(n + 1)), self.bucket.size
        for lo in range(0, n, self.laid):
            a, b = np.searchsorted(row, (lo, lo + self.laid))
            own = slice(begin[lo], begin[min(n, lo + self.laid)]) if a < b else slice(0, 0)
            own_place = (of[own] - lo) * wide + at[own]
            self.rows[own_place] = w[own]
            for x, y in _slices(self.entries[col[a:b]]):
                q, each = col[a + x : a + y], self.entries[col[a + x : a + y]]
                place = _ranges(self.entry_first[q], each)
                weights = self.entry_w[place] * self.rows[np.repeat((row[a + x : a + y] - lo) * wide, each) + self.entry[place]]
                s[a + x : a + y] = _sums(np.repeat(np.arange(y - x), each), weights, y - x)
            self.rows[own_place] = 0.0
        s = np.round(s, 6)
        some = np.flatnonzero((s != 0) & ~(s < bars[col]))
        return row[some], col[some], s[some]


def _sums(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Weights added up by key, as doubles also where there are none."""
    return np.bincount(keys, weights, n).astype(np.float64, copy=False)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of ranges of lengths ``n``, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _once(of: np.ndarray, idx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with each bucket once in a row, weights added up: so lengths bound products."""
    if ((np.diff(of) > 0) | (np.diff(idx) > 0)).all():
        return of, idx, w
    order = np.lexsort((idx, of))
    of, idx, w = of[order], idx[order], w[order]
    first = np.flatnonzero(np.append(True, (np.diff(of) > 0) | (np.diff(idx) > 0))[: of.size])
    return of[first], idx[first], np.add.reduceat(w, first)


def _flat(pairs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, idx and w of all pairs."""
    if pairs.null_count:
        pairs = pairs.fill_null(pa.scalar([], pairs.type))
    sizes = np.diff(pairs.offsets.to_numpy())
    flat = pairs.flatten()
    return np.repeat(np.arange(sizes.size), sizes), flat.field("idx").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes add up to at most ``AT_ONCE``, or one place."""
    total, at = np.cumsum(sizes), 0
    while at < sizes.size:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield at, to
        at = to


def fuse_rrf(legs: list[DataFrame], k: int = 12, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(constant + rank) over the lists a hit is in, best ``k``."""
    every = legs[0].select("query_id", "id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "id", "rank"))
    return top_k(every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 6).alias("score")), k)


def fuse_relative(legs: list[DataFrame], k: int = 12) -> DataFrame:
    """Relative score fusion: each list's scores scaled to 0..1 by query (all equal: 1), added up, best ``k``."""
    scaled = None
    for n, leg in enumerate(legs):
        own = Window.partitionBy("query_id")
        low, high = F.min("score").over(own), F.max("score").over(own)
        one = leg.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias("s"), F.lit(n).alias("leg"))
        scaled = one if scaled is None else scaled.unionByName(one)
    return top_k(scaled.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 6, scorer=None) -> DataFrame:
    """Candidates scored anew, best ``k``. By default by exact cosine; else by ``scorer``, a function of the joined
    candidates (query_id, id, q, v, and what else the inputs have) to a score column."""
    pairs = candidates.select("query_id", "id").join(queries.withColumnRenamed("embedding", "q"), "query_id").join(vectors.withColumnRenamed("embedding", "v"), "id")
    score = scorer(pairs) if scorer is not None else F.round(dot(l2_normalize(F.col("q")), l2_normalize(F.col("v"))), 6)
    return top_k(pairs.select("query_id", "id", score.alias("score")), k)


def cite(hits: DataFrame, chunks: DataFrame, n: int = 6) -> DataFrame:
    """Title, section and url of the first ``n`` hits of each query. chunks: id, title, section, url."""
    return hits.where(F.col("rank") <= n).join(chunks.select("id", "title", "section", "url"), "id")


def compare_modes(a: DataFrame, b: DataFrame, shown: int = 3) -> DataFrame:
    """Two result lists of the same queries aligned by id, ``shown`` of each: ranks, scores, and where a hit is found."""
    left = a.where(F.col("rank") <= shown).select("query_id", "id", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    right = b.where(F.col("rank") <= shown).select("query_id", "id", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    where = F.when(F.col("rank_b").isNull(), "a").when(F.col("rank_a").isNull(), "b").otherwise("both")
    return left.join(right, ["query_id", "id"], "full_outer").withColumn("found_in", where)


def pack_context(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """Ranked hits whose running number of tokens stays within the budget; a list ends at the first that does not fit.

    hits: query_id, rank, n_tokens.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("running", F.sum("n_tokens").over(order)).where(F.col("running") <= budget)
