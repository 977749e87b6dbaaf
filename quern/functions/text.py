"""Text functions: tokens, hashed sparse vectors, clipping, chunk boundaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a text that count, index space, and the 32-bit FNV-1a offset and prime.
TOKENS, BUCKETS, FNV_OFFSET, FNV_PRIME = 4096, 250_000, 2166136261, 16777619


def tokenize(text: Column, most: int = TOKENS) -> Column:
    """Runs of letters and digits, the first ``most``, lower-cased character by character: a capital sigma is a plain
    small one wherever it stands, and what a dotted capital I turns into (i and a dot above) stays in its token."""
    runs = lambda c: F.slice(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, most)
    plain = F.translate(text, "\u03a3", "\u03c3")
    # Only the dotted I gets longer, so only texts with one are cut first and lower-cased after.
    return F.when(F.contains(text, F.lit("\u0130")), F.transform(runs(plain), lambda t: F.lower(t))).otherwise(runs(F.lower(plain)))


def fnv_bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """FNV-1a over the code points of a token, modulo the index space. Products stay below 2^56."""
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")).__mul__(F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit((1 << 32) - 1))
    return F.aggregate(F.split(token, ""), F.lit(FNV_OFFSET).cast("long"), step) % buckets


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body uses it (a column that is used
    inside a lambda function may be put in there, and computed for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_ends(items: Column) -> Column:
    """Places (from 1) where runs of equal ``key`` end, in an array of structs sorted by it."""
    n, at = F.size(items), lambda i: F.get(items, i)["key"]
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (at(i - 1) != at(i)))
    return F.when(n > 0, ends).otherwise(F.array().cast("array<int>"))


def fnv_buckets(tokens: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """:func:`fnv_bucket` of many tokens, one place of all of them after the other."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    points = np.frombuffer("".join(tokens).encode("utf-32-le"), "<u4").astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    first, size = (np.cumsum(size) - size)[order], size[order]
    h, prime, low = np.full(len(tokens), FNV_OFFSET, np.uint64), np.uint64(FNV_PRIME), np.uint64((1 << 32) - 1)
    longer = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for at, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ points[first[:n] + at]) * prime & low
    out = np.empty(len(tokens), np.int64)
    out[order] = (h % np.uint64(buckets)).astype(np.int64)
    return out


def _counted(tokens: pa.Array) -> pa.Array:
    """How often each bucket occurs in each list of tokens, by bucket."""
    rows, sizes = len(tokens), np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    bucket = fnv_buckets(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    key, n = np.unique(np.repeat(np.arange(rows), sizes) * BUCKETS + bucket, return_counts=True)
    pairs = pa.StructArray.from_arrays([pa.array(key % BUCKETS), pa.array(n.astype(np.float64))], ["idx", "w"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(rows + 1) * BUCKETS).astype(np.int32)), pairs)


def sparse_rows(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id`` and ``pairs``: an array of (``idx``, ``w``) by ``idx``, how often each bucket occurs among a text's tokens.

    A text's tokens are in one row, and are hashed and counted there: nothing is shuffled. Tokens go to Python in Arrow
    batches, and each one is hashed once for a batch: a lambda function for each character took most of the time.
    """
    counted = F.arrow_udf(_counted, "array<struct<idx: bigint, w: double>>")
    return df.select(F.col(id_column).alias("id"), counted(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("pairs"))


def postings(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id``, ``idx``, ``w``: :func:`sparse_rows` as one row for each bucket of a text."""
    # An outer generator: for an inner one Spark infers a filter on the pairs, which would have them computed once more.
    return sparse_rows(df, id_column, text).select("id", F.inline_outer("pairs")).where("idx is not null")


def sparse_vectors(rows: DataFrame) -> DataFrame:
    """``id`` and ``sparse``: struct of parallel arrays ``indices`` (ascending) and ``values``, of rows of ``id`` and
    ``pairs``. Texts without a token have no row."""
    # An outer generator, and no filter on the pairs, which would be pushed down and have them computed once more.
    some = rows.select("id", F.explode_outer(F.filter(F.array("pairs"), lambda p: F.size(p) > 0)).alias("pairs")).where("pairs is not null")
    return some.select("id", F.struct(F.transform("pairs", lambda x: x["idx"]).alias("indices"), F.transform("pairs", lambda x: x["w"]).alias("values")).alias("sparse"))


#: What counts as a whole and as a real number in a map of weights.
_WHOLE, _REAL = r"^\s*[+-]?\d+\s*$", r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$"


def clean_weights(weights: Column) -> Column:
    """Sorted ``(idx, w)`` of a string map: keys that are whole numbers (of 64 bits), values that are numbers above 0."""
    idx = lambda k: F.when(F.rlike(k, F.lit(_WHOLE)), F.trim(k).try_cast("long"))
    w = lambda v: F.when(F.rlike(v, F.lit(_REAL)), F.trim(v).try_cast("double"))
    pairs = F.transform(F.map_entries(weights), lambda e: F.struct(idx(e["key"]).alias("idx"), w(e["value"]).alias("w")))
    return F.array_sort(F.filter(pairs, lambda p: p["idx"].isNotNull() & (p["w"] > 0)))


def ellipsize(text: Column, n: int, suffix: str = "...") -> Column:
    """A text of over ``n`` characters cut to ``n``, with a suffix."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(suffix))).otherwise(text)


def content_fingerprint(text: Column, n: int = 16 << 20) -> Column:
    """SHA-256 of the first ``n`` bytes."""
    return F.sha2(F.substring(F.encode(text, "UTF-8"), 1, n), 256)


def chunks(docs: DataFrame, target: int = 500, most: int = 700, overlap: int = 75, id_column: str = "doc_id") -> DataFrame:
    """``id``, ``chunk_no`` (from 0), ``n_tokens``, ``text`` of overlapping chunks of white-space tokens.

    Our own definition: chunks begin every ``target - overlap`` tokens and hold ``target``; a text has one at least;
    a last chunk of under ``most - target`` tokens becomes part of the one before.
    """
    if not overlap < target <= most:
        raise ValueError("overlap < target <= most is needed")
    stride = target - overlap
    rows = docs.select(F.col(id_column).alias("id"), F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "").alias("t"))
    n = F.size("t")
    rows = rows.withColumn("c0", F.greatest(F.lit(1), F.ceil((n - overlap) / stride).cast("int")))
    merge = (F.col("c0") > 1) & (n - (F.col("c0") - 1) * stride < most - target)
    rows = rows.withColumn("c", F.col("c0") - merge.cast("int"))
    cut = rows.select("id", "t", "c", F.explode_outer(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk_no"))
    size = F.when(F.col("chunk_no") == F.col("c") - 1, F.size("t") - F.col("chunk_no") * stride).otherwise(F.lit(target))
    piece = F.slice("t", F.col("chunk_no") * stride + 1, F.greatest(size, F.lit(0)))
    return cut.select("id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size(piece).cast("long").alias("n_tokens"), F.array_join(piece, " ").alias("text"))
