"""Faults that the review of round 4 found, each on a small case."""

import random

import numpy as np
import pyarrow as pa
import pytest

PAIRS = "array<struct<idx: long, w: double>>"


def _texts(draw, n, words=300, longest=120):
    """Texts of two languages, most of them short, some long and alike; every tenth is a copy, so that scores are equal."""
    out = []
    for i in range(n):
        if out and i % 10 == 0:
            out.append((i, draw.choice(out)[1]))
            continue
        size, base = int(longest ** draw.random() ** 2), words * (i % 2)
        counts = {}
        for _ in range(4 * size):
            w = base + int(words * draw.random() ** 3)
            counts[w] = counts.get(w, 0.0) + 1.0
        out.append((i, [{"idx": w, "w": counts[w]} for w in sorted(counts)]))
    return out


def _best(texts, queries, k):
    """Best ``k`` of each query by plain dictionaries."""
    rows = [(i, {p["idx"]: p["w"] for p in pairs or []}) for i, pairs in texts]
    out = set()
    for q, pairs in queries:
        scores = sorted((-sum(p["w"] * row.get(p["idx"], 0.0) for p in pairs or []), i) for i, row in rows)
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate([x for x in scores if x[0]][:k])}
    return out


def test_bars_of_rows_scored_ahead_hold_in_all_tasks(spark, monkeypatch):
    from quern.operators import retrieval as ops

    draw, k = random.Random(7), 20
    texts = _texts(draw, 4000) + [(9000, None), (9001, [])]
    queries = [(i, p) for i, p in texts if i % 67 == 3] + [(9100, [{"idx": 5000, "w": 1.0}]), (9101, []), (9102, None)]
    rows = spark.createDataFrame(texts, f"id long, pairs {PAIRS}").repartition(8)
    q = spark.createDataFrame(queries, f"query_id long, pairs {PAIRS}")
    monkeypatch.setattr(ops, "MANY", 2)
    monkeypatch.setattr(ops, "AHEAD_ROWS", 64)
    for bytes_ in (32 << 20, 20_000):
        monkeypatch.setattr(ops, "BROADCAST_BYTES", bytes_)
        found = ops.sparse_scores(q, rows, k).cache()
        assert set(map(tuple, ops.top_k(found, k).select("query_id", "id", "score", "rank").collect())) == _best(texts, queries, k)
        # Before, each of eight tasks sent its best 20 of each query, some 9,000.
        assert found.count() < 7200


def test_pairs_that_cannot_reach_a_bar_are_not_scored(monkeypatch):
    from quern.operators import retrieval as ops

    draw, k = random.Random(8), 5
    texts = _texts(draw, 1500)
    queries = texts[3::50] + [(9100, [{"idx": 5000, "w": 1.0}]), (9101, [])]
    kind = pa.list_(pa.struct([("idx", pa.int64()), ("w", pa.float64())]))
    table = lambda rows, name: pa.table({name: [r[0] for r in rows], "pairs": pa.array([r[1] for r in rows], kind)})
    want, whole = _best(texts, queries, k), ops._Sparse.whole
    scored = []
    monkeypatch.setattr(ops._Sparse, "whole", lambda self, n, *x: scored.append(n * self.number.size) or whole(self, n, *x))
    for at_once, far, wide in ((1 << 21, 0, 8), (700, 0, 8), (700, 0, 0), (1 << 21, 1 << 40, 8)):
        monkeypatch.setattr(ops, "AT_ONCE", at_once)
        monkeypatch.setattr(ops, "COMMON", wide)
        moved = lambda rows: [(i, p and [{"idx": x["idx"] * 3 + far, "w": x["w"]} for x in p]) for i, p in rows]  # noqa: E731, B023
        batch = table(moved(texts), "id").combine_chunks().to_batches()[0]
        block = table(moved(queries), "query_id")
        last = {q: s for q, _, s, n in want if n == k}
        bars = np.array([last.get(q, -np.inf) for q, _ in queries])
        known = ops._Sparse(block, bars)
        scored.clear()
        parts = list(known.scores(batch, known.bars, k))
        got = {(int(q), int(i), float(s)) for part in parts for q, i, s in zip(*part, strict=True)}
        assert {x[:3] for x in want} <= got and len(got) < 2 * len(want)
        # Before, all pairs were.
        assert sum(scored) < len(texts) * len(queries) / 4
        # Without k, the pairs are all that share a bucket.
        every = ops._Sparse(block, np.full(len(queries), -np.inf))
        assert sum(part[0].size for part in every.scores(batch, None, None)) == len(_best(texts, queries, len(texts)))


def test_buckets_that_are_twice_in_a_row_count_twice():
    from quern.operators import retrieval as ops

    twice = [np.array([0, 0, 0, 1]), np.array([4, 2, 4, 4]), np.array([1.0, 2.0, 3.0, 5.0])]
    of, idx, w = ops._once(*twice)
    assert (of.tolist(), idx.tolist(), w.tolist()) == ([0, 0, 1], [2, 4, 4], [2.0, 4.0, 5.0])
    assert ops._once(*(x[:0] for x in twice))[0].size == 0


@pytest.mark.parametrize("k", [None, 3])
def test_queries_without_a_common_bucket_have_scores(spark, k):
    from quern.operators import retrieval as ops

    # Each of 20 queries has a bucket of its own, so none is common: before, sums of nothing were whole numbers and failed.
    q = spark.createDataFrame([(i, [{"idx": i, "w": 0.5}]) for i in range(20)], f"query_id long, pairs {PAIRS}")
    rows = spark.createDataFrame([(i, [{"idx": i % 25, "w": 3.0}]) for i in range(50)], f"id long, pairs {PAIRS}").repartition(2)
    got = {tuple(r) for r in ops.sparse_scores(q, rows, k).collect()}
    assert got == {(i % 25, i, 1.5) for i in range(50) if i % 25 < 20}


def test_dense_bars_of_rows_scored_ahead_change_no_score(spark, monkeypatch):
    from quern.operators import retrieval as ops

    draw = np.random.default_rng(5)
    points = np.repeat(draw.normal(size=(700, 8)), 2, axis=0)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(None, [1.0] * 8), (5000, None), (5001, [1.0]), (5002, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(8)
    q = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 400, 5)] + [(8000, [0.0] * 8), (8001, [2.0])], "query_id long, embedding array<double>")
    shown = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    want = shown(ops.top_k(ops.dense_scores(q, v), 7))
    monkeypatch.setattr(ops, "MANY", 2)
    monkeypatch.setattr(ops, "AHEAD_ROWS", 100)
    found = ops.dense_scores(q, v, 7).cache()
    assert shown(ops.top_k(found, 7)) == want and len(want) == 81 * 7
    assert found.count() < 8 * len(want)
