"""Search plans: embedding, dense, sparse, hybrid and reranked retrieval over one corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import clean_weights, let, run_ends, sparse_rows, sparse_vectors
from quern.functions.vectors import checked, l2_normalize
from quern.operators.retrieval import compare_modes, dense_scores, fuse_relative, fuse_rrf, rerank, sparse_scores, top_k
from quern.sources.staging import staged


class Embedder(Protocol):
    """Adds an ``embedding`` to rows of ``id`` and ``text``."""

    dimension: int

    def __call__(self, texts: DataFrame) -> DataFrame: ...


@dataclass
class HashEmbedder:
    """Signed feature hashing of the sparse buckets into ``dimension`` places, of unit length: needs no model.

    A bucket's place is its remainder, its sign the parity of the quotient. A text without tokens has a zero vector.
    """

    dimension: int = 1024

    def __call__(self, texts: DataFrame) -> DataFrame:
        return sparse_rows(texts, "id").select("id", self.of(F.col("pairs")).alias("embedding"))

    def of(self, pairs: Column) -> Column:
        """The embedding of a text's pairs."""
        place = lambda x: (x["idx"] % self.dimension).cast("int")
        signed = lambda x: x["w"] * F.when(F.floor(x["idx"] / self.dimension) % 2 == 0, 1.0).otherwise(-1.0)
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)

        def summed(p: Column, ends: Column) -> Column:
            """Runs of one place added up."""
            start = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
            return F.transform(ends, lambda e, k: F.struct(F.get(p, e - 1)["key"].alias("at"), F.aggregate(F.slice(p, start(k) + 1, e - start(k)), F.lit(0.0), lambda a, x: a + x["x"]).alias("x")))

        def filled(s: Column) -> Column:
            """Zeros between the places, and after the last."""
            at = lambda k: F.coalesce(F.get(s, k)["at"], F.lit(-1))
            return F.concat(F.flatten(F.transform(s, lambda p, k: F.concat(zeros(p["at"] - at(k - 1) - 1), F.array(p["x"])))), zeros(F.lit(self.dimension - 1) - at(F.size(s) - 1)))

        by_place = F.sort_array(F.transform(pairs, lambda x: F.struct(place(x).alias("key"), signed(x).alias("x"))))
        return let(let(by_place, lambda p: let(let(run_ends(p), lambda ends: summed(p, ends)), filled)), l2_normalize)


@dataclass
class ModelEmbedder:
    """Embeddings of a Python model, loaded once in each worker; a second one takes over if the first fails.

    load and fall_back return a function from a list of texts to a list of vectors.
    """

    dimension: int
    load: Callable[[], Callable]
    fall_back: Callable[[], Callable] | None = None

    def __call__(self, texts: DataFrame) -> DataFrame:
        load, fall_back = self.load, self.fall_back

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, second = None, None
            for batch in batches:
                rows = batch.fillna("").tolist()
                try:
                    model = model or load()
                    vectors = model(rows)
                except Exception:
                    if fall_back is None:
                        raise
                    second = second or fall_back()
                    vectors = second(rows)
                yield pd.Series([[float(x) for x in v] for v in vectors], index=batch.index)

        return texts.select("id", embed("text").alias("embedding"))


def model_scorer(load: Callable[[], Callable]) -> Callable[[DataFrame], Column]:
    """A reranker for :func:`rerank` from a Python model of (queries, passages) to scores, loaded once in each worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, passage in batches:
            yield pd.Series(model(query.tolist(), passage.tolist()), index=query.index).astype(float)

    return lambda pairs: F.round(score("query_text", "passage"), 6)


def embed_hybrid(texts: DataFrame, embedder: Embedder, weights: DataFrame | None = None) -> DataFrame:
    """``id``, ``embedding`` and ``sparse`` of each text (id, text). Model weights (id, weights: map of strings) are
    cleaned, and used where any is left; else the hashed counts."""
    sparse = F.struct(F.transform("pairs", lambda x: x["idx"]).alias("indices"), F.transform("pairs", lambda x: x["w"]).alias("values")).alias("sparse")
    if isinstance(embedder, HashEmbedder):
        # Both are of the same pairs, so no text is read or moved twice.
        out = sparse_rows(texts, "id").select("id", embedder.of(F.col("pairs")).cast("array<float>").alias("embedding"), sparse)
    else:
        dense, _ = checked(embedder(texts), "embedding", embedder.dimension)
        out = sparse_rows(texts, "id").select("id", sparse).join(dense, "id", "left").select("id", "embedding", "sparse")
    if weights is None:
        return out
    clean = weights.select("id", clean_weights(F.col("weights")).alias("p")).where(F.size("p") > 0)
    given = clean.select("id", F.struct(F.transform("p", lambda x: x["idx"]).alias("indices"), F.transform("p", lambda x: x["w"]).alias("values")).alias("given"))
    return out.join(given, "id", "left").withColumn("sparse", F.coalesce("given", "sparse")).drop("given")


@dataclass
class Corpus:
    """vectors: id, embedding; sparse: id, pairs."""

    vectors: DataFrame
    sparse: DataFrame


@dataclass
class Queries:
    """vectors: query_id, embedding; sparse: query_id, pairs."""

    vectors: DataFrame
    sparse: DataFrame


@dataclass
class Settings:
    """Sizes of the lists: dense mode, dense and sparse leg, fused list, reranked list; and how legs are fused."""

    mode: str = "hybrid"
    dense: int = 6
    dense_leg: int = 30
    sparse_leg: int = 50
    fused: int = 12
    reranked: int = 6
    fusion: str = "rrf"
    constant: int = 60


def dense_search(queries: Queries, corpus: Corpus, k: int = 6) -> DataFrame:
    return top_k(dense_scores(queries.vectors, corpus.vectors, k), k)


def sparse_search(queries: Queries, corpus: Corpus, k: int = 50) -> DataFrame:
    return top_k(sparse_scores(queries.sparse, corpus.sparse, k), k)


def _fused(legs: list[DataFrame], settings: Settings) -> DataFrame:
    return fuse_rrf(legs, settings.fused, settings.constant) if settings.fusion == "rrf" else fuse_relative(legs, settings.fused)


def hybrid_search(queries: Queries, corpus: Corpus, settings: Settings) -> DataFrame:
    return _fused([dense_search(queries, corpus, settings.dense_leg), sparse_search(queries, corpus, settings.sparse_leg)], settings)


def retrieve(queries: Queries, corpus: Corpus, settings: Settings) -> DataFrame:
    """Results of the mode asked for: ``query_id``, ``id``, ``score``, ``rank``."""
    if settings.mode == "dense":
        return dense_search(queries, corpus, settings.dense)
    fused = hybrid_search(queries, corpus, settings)
    if settings.mode == "hybrid":
        return fused
    if settings.mode == "hybrid_rerank":
        return rerank(fused, queries.vectors, corpus.vectors, settings.reranked)
    raise ValueError(f"unknown mode {settings.mode}")


def all_modes(queries: Queries, corpus: Corpus, settings: Settings) -> dict[str, DataFrame]:
    """The lists of all modes. Both legs and the fused list are worked out once and staged."""
    columns = ["query_id", "id", "score", "rank"]
    dense = staged(dense_search(queries, corpus, max(settings.dense, settings.dense_leg)).select(columns), "dense")
    sparse = staged(sparse_search(queries, corpus, settings.sparse_leg).select(columns), "sparse")
    fused = staged(_fused([dense.where(F.col("rank") <= settings.dense_leg), sparse], settings).select(columns), "fused")
    return {"dense": dense.where(F.col("rank") <= settings.dense), "hybrid": fused, "hybrid_rerank": rerank(fused, queries.vectors, corpus.vectors, settings.reranked)}


def retrieval_debug(queries: Queries, corpus: Corpus, settings: Settings) -> DataFrame:
    """All modes of the same queries in one table (``mode`` first), dense and hybrid lists aligned in ``found_in``."""
    lists = all_modes(queries, corpus, settings)
    out = None
    for mode, found in lists.items():
        one = found.select(F.lit(mode).alias("mode"), "query_id", "id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    found = compare_modes(lists["dense"], lists["hybrid"], settings.fused).select("query_id", "id", "found_in")
    return out.join(found, ["query_id", "id"], "left")


def backfill_sparse(vectors: DataFrame, existing: DataFrame, texts: DataFrame) -> DataFrame:
    """Sparse vectors of all rows of ``vectors`` (id): existing ones (id, sparse), and new ones for the rest."""
    lacking = texts.join(vectors.select("id"), "id", "left_semi").join(existing.select("id"), "id", "left_anti")
    return existing.join(vectors.select("id"), "id", "left_semi").unionByName(sparse_vectors(sparse_rows(lacking, "id")))
