"""How queries are registered, and the stand-in views of ``quern.sources.tables`` in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tokens of a text: runs of letters and digits, each character lower-cased on its own. A capital sigma has one small form
#: there, a dotted capital I becomes two characters.
TOKENS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:4096], lambda t: replace(lower(replace(replace(t, chr(304), chr(57344)), chr(931), chr(963))), chr(57344), 'i' || chr(775)))"

#: White space as the patterns of image links mean it, and the three forms of a link.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINKS = [r"(?i)\[img\](https?://[^\[]+)\[/img\]", rf"(?i)!\[[^\]]*\]\((https?://[^{SPACE})]+)\)", rf"""(?i)(https?://[^{SPACE}"''<>]+\.(?:jpg|jpeg|png|gif|webp|avif)(?:\?[^{SPACE}"''<>]*)?)"""]
_FOUND = [f"regexp_extract_all(body, '{p}', 1)" for p in LINKS]

VIEWS = {
    "runs": """SELECT o_orderkey AS run_id, o_orderdate AS created_at, o_orderdate AS updated_at,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderpriority AS model,
        '[{"role":"user","content":"order ' || o_custkey || '"}]' AS request_messages_json,
        CASE WHEN o_custkey % 7 <> 0 THEN '{"top_k":' || (o_custkey % 50) || '}' END AS settings_json, CAST(NULL AS VARCHAR) AS resources_json,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 10 END AS ttft_ms, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total_time_ms,
        o_custkey AS input_tokens, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS output_tokens,
        CASE WHEN o_orderstatus = 'F' THEN o_custkey / (o_totalprice / 1000) END AS tokens_per_s,
        CASE WHEN o_orderstatus = 'P' THEN 'stream closed' END AS error FROM orders""",
    "tokens": """SELECT l_orderkey AS run_id, l_shipdate AS ts,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS index,
        'w' || l_partkey || ' ' AS token, l_quantity AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""",
    "messages": "SELECT event_id AS id, ts, user_id AS session, event_type AS channel, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "posts": """SELECT conv_id AS thread, turn AS post, role AS author, text || CASE WHEN turn % 3 = 0 THEN ' [img]http://img.example/' || conv_id || '/' || turn || '.png[/img] ![x](https://img.example/' || conv_id || '/a?c=1) https://img.example/' || (turn % 2) || '.JPG?w=2' || chr(12288) || 'https://img.example/wide.png' || chr(160) ELSE '' END AS body FROM conversations""",
    "images": f"""SELECT thread, post, author, body, list_filter(list_transform(list_concat(list_concat({_FOUND[0]}, {_FOUND[1]}), {_FOUND[2]}), lambda u: regexp_replace(u, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda u: u <> '') AS every FROM posts""",
    "image_rows": """SELECT thread, post, url, min(pos) AS pos FROM (SELECT thread, post, unnest(every) AS url, generate_subscripts(every, 1) AS pos FROM images) GROUP BY thread, post, url""",
    "doc_tokens": f"SELECT doc_id, unnest({TOKENS}) AS t FROM documents",
    "doc_postings": "SELECT doc_id AS id, {hash} AS idx, CAST(sum(n) AS DOUBLE) AS w FROM (SELECT doc_id, t, count(*) AS n FROM doc_tokens GROUP BY doc_id, t) GROUP BY 1, 2",
    "query_tokens": f"SELECT item_id, unnest({TOKENS}) AS t FROM benchmark",
    "query_postings": "SELECT item_id AS id, {hash} AS idx, CAST(sum(n) AS DOUBLE) AS w FROM (SELECT item_id, t, count(*) AS n FROM query_tokens GROUP BY item_id, t) GROUP BY 1, 2",
    "chunks": r"""SELECT doc_id AS id, i AS chunk_no, list_slice(t, i * 425 + 1, CASE WHEN i = c - 1 THEN len(t) ELSE i * 425 + 500 END) AS x FROM
        (SELECT doc_id, t, c, unnest(range(0, c)) AS i FROM (SELECT doc_id, t, c0 - CASE WHEN c0 > 1 AND len(t) - (c0 - 1) * 425 < 200 THEN 1 ELSE 0 END AS c FROM
        (SELECT doc_id, t, greatest(1, CAST(ceil((len(t) - 75) / 425.0) AS BIGINT)) AS c0 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents))))""",
    "query_vectors": "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 25 = 0",
    "dense": """SELECT q.query_id, v.vec_id AS id, round(list_dot_product(list_transform(CAST(q.embedding AS DOUBLE[]), lambda x: x / q.n), list_transform(CAST(v.embedding AS DOUBLE[]), lambda x: x / v.n)), 6) AS score
        FROM (SELECT query_id, embedding, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM query_vectors) q,
        (SELECT vec_id, embedding, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings) v""",
    "hybrid_postings": "SELECT p.id AS query_id, d.id, round(sum(p.w * d.w), 6) AS score FROM doc_postings p JOIN doc_postings d USING (idx) WHERE p.id IN (SELECT query_id FROM query_vectors) GROUP BY 1, 2",
    "dense_leg": "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense) WHERE rank <= 30",
    "sparse_leg": "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hybrid_postings) WHERE rank <= 50",
    "rrf": "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM dense_leg UNION ALL SELECT query_id, id, rank FROM sparse_leg) GROUP BY 1, 2)) WHERE rank <= 12",
    "reranked": "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT rrf.query_id, rrf.id, dense.score FROM rrf JOIN dense USING (query_id, id))) WHERE rank <= 6",
    "dense_mode": "SELECT query_id, id, score, rank FROM dense_leg WHERE rank <= 6",
}
HASH = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 250000"
NEEDS = {"images": ["posts"], "image_rows": ["posts", "images"], "doc_postings": ["doc_tokens"], "query_postings": ["query_tokens"], "dense": ["query_vectors"], "hybrid_postings": ["doc_tokens", "doc_postings", "query_vectors"]}
NEEDS["dense_leg"] = [*NEEDS["dense"], "dense"]
NEEDS["dense_mode"] = [*NEEDS["dense_leg"], "dense_leg"]
NEEDS["sparse_leg"] = [*NEEDS["hybrid_postings"], "hybrid_postings"]
NEEDS["rrf"] = [*dict.fromkeys([*NEEDS["dense_leg"], "dense_leg", *NEEDS["sparse_leg"], "sparse_leg"])]
NEEDS["reranked"] = [*NEEDS["rrf"], "rrf"]


def views(*names: str) -> str:
    """A WITH clause of the views named and those they need."""
    order = [*dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n])]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].replace('{hash}', HASH)})" for n in order)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its counterpart in SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def text_time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str | Column, separator: str = "|") -> Column:
    """An array as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def sql_time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
