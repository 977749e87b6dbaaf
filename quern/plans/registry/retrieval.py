"""Queries over retrieval: benchmark passages against documents, vectors against vectors, and both together.

In the hybrid ones a vector's id and a document's id are the same number by convention; every 25th vector is a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import inverted, pivots
from quern.operators import retrieval as ops
from quern.plans import search
from quern.plans.registry._views import joined, query, views
from quern.sources import tables


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return T.sparse_rows(tables.spread(tables.table(spark, d, "documents").select("doc_id", "text")), "doc_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return T.sparse_rows(tables.table(spark, d, "benchmark"), "item_id").withColumnRenamed("id", "query_id")


def _hybrid(spark: SparkSession, d: str) -> tuple[search.Queries, search.Corpus]:
    e = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    own = e.where("id % 25 = 0").withColumnRenamed("id", "query_id")
    asked = tables.table(spark, d, "documents").join(own.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    sparse = T.sparse_rows(asked, "doc_id").withColumnRenamed("id", "query_id")
    return search.Queries(own, sparse), search.Corpus(e, _docs(spark, d))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_SPARSE = "p AS (SELECT q.id AS query_id, d.id, round(sum(q.w * d.w), 6) AS score FROM query_postings q JOIN doc_postings d USING (idx) GROUP BY 1, 2)"


@query(f"{views('doc_postings', 'query_postings')}, {_SPARSE} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 50")
def sparse_search(spark: SparkSession, d: str) -> DataFrame:
    """Over an inverted index with block maxima, whose blocks that cannot reach a query's best 50 are passed over."""
    return _shown(inverted.inverted_search(_items(spark, d), inverted.inverted_blocks(_docs(spark, d)), 50)[0])


@query(f"{views('doc_postings', 'query_postings')}, {_SPARSE} SELECT query_id, id, score FROM p")
def postings_join(spark: SparkSession, d: str) -> DataFrame:
    return ops.sparse_scores(_items(spark, d), _docs(spark, d)).select("query_id", "id", "score")


@query(f"{views('dense_mode')} SELECT * FROM dense_mode")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return _shown(search.dense_search(q, c, 6))


@query(f"{views('dense_mode')} SELECT * FROM dense_mode")
def dense_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same over blocks of vectors, of which those that cannot reach a query's best six are not multiplied."""
    q, c = _hybrid(spark, d)
    index, chosen = pivots.vector_blocks(c.vectors)
    return _shown(pivots.pivot_search(q.vectors, index, chosen, 6)[0])


@query(f"{views('dense_leg')} SELECT * FROM dense_leg")
def top_k_per_query(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return _shown(ops.top_k(ops.dense_scores(q.vectors, c.vectors, 30), 30))


@query(f"{views('rrf')} SELECT * FROM rrf")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return _shown(search.hybrid_search(q, c, search.Settings()))


@query(f"""{views('dense_leg', 'sparse_leg')}, s AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM dense_leg WINDOW w AS (PARTITION BY query_id)
    UNION ALL SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END FROM sparse_leg WINDOW w AS (PARTITION BY query_id))
    SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(s), 6) AS score FROM s GROUP BY 1, 2)) WHERE rank <= 12""")
def fuse_relative(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return _shown(search.hybrid_search(q, c, search.Settings(fusion="relative")))


@query(f"{views('reranked')} SELECT * FROM reranked")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return _shown(search.retrieve(q, c, search.Settings(mode="hybrid_rerank")))


@query(f"{views('dense_mode', 'rrf', 'reranked')} SELECT 'dense' AS mode, * FROM dense_mode UNION ALL SELECT 'hybrid', * FROM rrf UNION ALL SELECT 'hybrid_rerank', * FROM reranked")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """All queries in each mode; the legs are worked out once."""
    q, c = _hybrid(spark, d)
    out = None
    for mode, found in search.all_modes(q, c, search.Settings()).items():
        one = _shown(found).select(F.lit(mode).alias("mode"), "query_id", "id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{views('dense_mode', 'rrf', 'reranked')}, m AS (SELECT 'dense' AS mode, * FROM dense_mode UNION ALL SELECT 'hybrid', * FROM rrf UNION ALL SELECT 'hybrid_rerank', * FROM reranked)
    SELECT m.mode, m.query_id, m.id, m.score, m.rank, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'a' ELSE 'b' END AS found_in FROM m LEFT JOIN dense_mode a USING (query_id, id) LEFT JOIN rrf b USING (query_id, id)""")
def retrieval_debug(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    return search.retrieval_debug(q, c, search.Settings()).select("mode", "query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "found_in")


@query(f"""{views('dense_mode', 'rrf')}, a AS (SELECT * FROM dense_mode WHERE rank <= 3), b AS (SELECT * FROM rrf WHERE rank <= 3)
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS rank_a, b.rank AS rank_b, CASE WHEN b.id IS NULL THEN 'a' WHEN a.id IS NULL THEN 'b' ELSE 'both' END AS found_in FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id""")
def retrieval_compare(spark: SparkSession, d: str) -> DataFrame:
    q, c = _hybrid(spark, d)
    lists = search.all_modes(q, c, search.Settings())
    out = ops.compare_modes(lists["dense"], lists["hybrid"])
    return out.select("query_id", "id", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"), "found_in")


@query(f"""{views('doc_postings', 'query_postings')}, {_SPARSE}, h AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 6)
    SELECT query_id, id, rank, 'Doc ' || id AS title, lang AS section, 'http://docs.example/' || source || '/' || id AS url FROM h JOIN documents ON doc_id = id""")
def hit_citations(spark: SparkSession, d: str) -> DataFrame:
    hits = ops.top_k(ops.sparse_scores(_items(spark, d), _docs(spark, d), 50), 50)
    i = F.col("doc_id").cast("string")
    meta = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), i).alias("title"), F.col("lang").alias("section"), F.concat(F.lit("http://docs.example/"), "source", F.lit("/"), i).alias("url"))
    return ops.cite(hits, meta).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "title", "section", "url")


@query(f"""{views('doc_postings', 'query_postings')}, {_SPARSE}, n AS (SELECT id, CAST(sum(w) AS BIGINT) AS n_tokens FROM doc_postings GROUP BY id), h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p),
    r AS (SELECT query_id, id, rank, CAST(sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running FROM h JOIN n USING (id) WHERE rank <= 50) SELECT * FROM r WHERE running <= 20000""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = ops.top_k(ops.sparse_scores(_items(spark, d), docs, 50), 50)
    size = docs.select("id", F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["w"]).cast("long").alias("n_tokens"))
    return ops.pack_context(hits.join(size, "id"), 20000).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "running")


@query(f"{views('doc_postings')} SELECT id, string_agg(idx, '|' ORDER BY idx) AS indices FROM doc_postings WHERE id IN (SELECT vec_id FROM embeddings) GROUP BY id")
def backfill_sparse(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    e = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    have = T.sparse_vectors(T.sparse_rows(docs.where("id % 2 = 0"), "id"))
    return search.backfill_sparse(e, have, docs).select("id", joined("sparse.indices").alias("indices"))


@query(f"{views('doc_postings')} SELECT d.doc_id AS id, coalesce(string_agg(idx, '|' ORDER BY idx), '') AS indices, CAST(64 AS BIGINT) AS dimension FROM documents d LEFT JOIN doc_postings p ON p.id = d.doc_id GROUP BY d.doc_id")
def embed_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    out = search.embed_hybrid(docs, search.HashEmbedder(64))
    return out.select("id", joined("sparse.indices").alias("indices"), F.size("embedding").cast("long").alias("dimension"))


@query(f"""{views('doc_postings')}, f AS (SELECT id, idx % 64 AS place, sum(w * CASE WHEN (idx // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM doc_postings GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM f GROUP BY id)
    SELECT f.id, place, round(CASE WHEN n > 0 THEN x / n ELSE 0.0 END, 6) AS x FROM f JOIN n USING (id) WHERE x <> 0""")
def embedder(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    out = search.HashEmbedder(64)(docs).select("id", F.posexplode_outer("embedding").alias("place", "x")).where("x <> 0")
    return out.select("id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query(f"""{views('doc_postings', 'query_postings')}, {_SPARSE}, h AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 20),
    w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS q FROM benchmark), t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS p FROM documents),
    s AS (SELECT query_id, id, round(len(list_intersect(q, p))::DOUBLE / greatest(1, len(q)), 6) AS score FROM h JOIN w ON item_id = query_id JOIN t ON doc_id = id)
    SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 6""")
def scorer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the sparse leg reranked by a Python scorer: the share of a query's words in the passage."""

    def load():
        return lambda queries, passages: [len(set(q.split()) & set(p.split())) / max(1, len(set(q.split()))) for q, p in zip(queries, passages, strict=True)]

    hits = ops.top_k(ops.sparse_scores(_items(spark, d), _docs(spark, d), 20), 20)
    q = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.lit(None).cast("array<float>").alias("embedding"))
    v = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"), F.lit(None).cast("array<float>").alias("embedding"))
    return _shown(ops.rerank(hits, q, v, 6, search.model_scorer(load)))
