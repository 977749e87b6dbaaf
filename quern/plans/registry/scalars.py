"""Queries over scalar functions: each is applied to columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import names, payloads, urls, vectors
from quern.functions import text as T
from quern.plans.registry._views import HASH, TOKENS, joined, query, views
from quern.sources import logs, tables


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents")


_TRAPS = "ΟΔΟΣ Σ, İSTANBUL-Iı e\u0301tude ½Ⅷ ǅ ẞ x_y"


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '{_TRAPS} ' || text ELSE text END AS text FROM documents))")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth text begins with what lower-casing of whole texts gets wrong."""
    text = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(f"{_TRAPS} "), "text")).otherwise(F.col("text"))
    t = _docs(spark, d).select("doc_id", T.tokenize(text).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.encode(F.array_join("t", " "), "UTF-8")).alias("tokens_md5"))


@query(f"{views('doc_tokens')} SELECT t AS token, {HASH} AS bucket FROM (SELECT DISTINCT t FROM doc_tokens)")
def fnv1a_bucket(spark: SparkSession, d: str) -> DataFrame:
    tokens = _docs(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", T.fnv_bucket(F.col("token")).alias("bucket"))


@query(f"{views('doc_tokens', 'doc_postings')} SELECT id, string_agg(idx, '|' ORDER BY idx) AS indices, string_agg(CAST(w AS BIGINT), '|' ORDER BY idx) AS counts FROM doc_postings GROUP BY id")
def sparse_vector(spark: SparkSession, d: str) -> DataFrame:
    v = T.sparse_vectors(T.sparse_rows(tables.spread(_docs(spark, d).select("doc_id", "text")), "doc_id"))
    return v.select("id", joined("sparse.indices").alias("indices"), F.array_join(F.transform("sparse.values", lambda x: x.cast("long").cast("string")), "|").alias("counts"))


@query("""SELECT p_partkey, array_to_string(list_filter([-4, p_partkey % 5, p_partkey % 7 + 10, 99, p_partkey + 1000000], lambda i: CASE WHEN i = -4 THEN p_size % 2 > 0 WHEN i = 99 THEN p_size > 0 WHEN i < 10 THEN p_retailprice > 950 WHEN i < 99 THEN p_size % 3 > 0 ELSE true END), '|') AS indices FROM part""")
def sparse_clean(spark: SparkSession, d: str) -> DataFrame:
    """Weights with keys of either sign and any size, keys and values that are no numbers, and values that are not above 0."""
    p = tables.table(spark, d, "part")
    k = F.col("p_partkey")
    keys = [(k % 5).cast("string"), (k % 7 + 10).cast("string"), F.lit("99"), F.lit("x1"), F.lit("7e"), F.concat(F.lit(" +"), (k + 1000000).cast("string")), F.lit("-4"), F.lit("12.7"), F.lit("77"), F.lit("78")]
    values = [(F.col("p_retailprice") - 950).cast("string"), (F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"), F.lit("1.0"), F.lit("bad"), F.lit("1e-3"), (F.col("p_size") % 2).cast("string"), F.lit("1.0"), F.lit("nan"), F.lit("3d")]
    m = F.map_from_arrays(F.array(*keys), F.array(*values))
    return p.select("p_partkey", F.array_join(F.transform(T.clean_weights(m), lambda x: x["idx"].cast("string")), "|").alias("indices"))


@query("SELECT vec_id, len(CASE WHEN vec_id % 9 = 0 THEN embedding[1:63] ELSE embedding END) AS n, vec_id % 9 <> 0 AS ok FROM embeddings")
def check_dim(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    good, bad = vectors.checked(e, "embedding", 64)
    return good.select("vec_id", F.size("embedding").cast("long").alias("n"), F.lit(True).alias("ok")).unionByName(bad.select("vec_id", F.size("embedding").cast("long").alias("n"), F.lit(False).alias("ok")))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
    SELECT vec_id, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last, 1.0::DOUBLE AS norm FROM n""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(vectors.norm(F.col("u")), 6).alias("norm"))


_MODEL = "p_name || CASE p_partkey % 5 WHEN 0 THEN '-7B' WHEN 1 THEN '-0.5b' WHEN 2 THEN '-35B' WHEN 3 THEN '-9b-4b' ELSE '' END"


def _models(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    suffix = F.when(m == 0, "-7B").when(m == 1, "-0.5b").when(m == 2, "-35B").when(m == 3, "-9b-4b").otherwise("")
    return tables.table(spark, d, "part").select("p_partkey", "p_size", F.concat("p_name", suffix).alias("name"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN 4096 WHEN p_partkey % 5 < 4 THEN CAST(8192 AS BIGINT) END AS ctx, {_MODEL} AS name FROM part")
def guess_ctx(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("p_partkey", names.guess_context(F.col("name")).alias("ctx"), "name")


@query(f"SELECT p_partkey, CASE WHEN contains(lower(n), '35b') THEN 'large' WHEN contains(lower(n), '9b') THEN 'medium' WHEN contains(lower(n), '4b') THEN 'small' ELSE 'other' END AS tier FROM (SELECT p_partkey, {_MODEL} AS n FROM part)")
def model_tier(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("p_partkey", names.model_tier(F.col("name")).alias("tier"))


@query("""WITH n AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE event_id * event_id * 37 END AS b, event_id * 97 AS up, event_id / 2.0::DOUBLE AS s FROM events),
    r AS (SELECT *, b / 1024.0::DOUBLE AS kb, b / 1048576.0::DOUBLE AS mb, b / 1073741824.0::DOUBLE AS gb FROM n)
    SELECT event_id, CASE WHEN coalesce(b, 0) = 0 THEN 'N/A' WHEN kb < 1 THEN b || ' B' WHEN mb < 1 THEN printf('%.1f', floor(kb * 10 + 0.5) / 10) || ' KB' WHEN gb < 1 THEN printf('%.1f', floor(mb * 10 + 0.5) / 10) || ' MB' ELSE printf('%.1f', floor(gb * 10 + 0.5) / 10) || ' GB' END AS bytes,
        CASE WHEN coalesce(b, 0) = 0 THEN '0 B/s' WHEN kb < 1024 THEN printf('%.1f', floor(kb * 10 + 0.5) / 10) || ' KB/s' ELSE printf('%.2f', floor(mb * 100 + 0.5) / 100) || ' MB/s' END AS rate,
        CASE WHEN up = 0 THEN 'N/A' WHEN up // 86400 > 0 THEN (up // 86400) || 'd ' || (up % 86400 // 3600) || 'h' WHEN up // 3600 > 0 THEN (up // 3600) || 'h ' || (up % 3600 // 60) || 'm' ELSE (up // 60) || 'm' END AS uptime,
        CASE WHEN s = 0 THEN 'Estimating...' WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's' ELSE CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s % 60) AS BIGINT) || 's' END AS eta FROM r""")
def format_units(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 11
    e = tables.table(spark, d, "events").select("event_id", F.when(m == 0, F.lit(0)).when(m != 1, F.col("event_id") * F.col("event_id") * 37).cast("long").alias("b"))
    return e.select("event_id", names.format_bytes(F.col("b")).alias("bytes"), names.format_rate(F.col("b").cast("double")).alias("rate"), names.format_uptime(F.col("event_id") * 97).alias("uptime"), names.format_eta(F.col("event_id") / 2.0).alias("eta"))


_LOCAL_URL = "CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^(https?)://[^/]*', '\\1://localhost:80' || page_id) WHEN 1 THEN regexp_replace(url, '^(https?)://[^/]*', '\\1://127.0.0.1') WHEN 2 THEN regexp_replace(url, '^(https?)://[^/]*', '\\1://[::1]:9') ELSE url END"


def _local(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 4
    host = F.when(m == 0, F.concat(F.lit("localhost:80"), F.col("page_id").cast("string"))).when(m == 1, "127.0.0.1").when(m == 2, "[::1]:9")
    rest = F.regexp_replace("url", "^https?://[^/]*", "")
    scheme = F.regexp_extract("url", "^(https?)://", 1)
    return tables.table(spark, d, "pages").select("page_id", F.coalesce(F.concat(scheme, F.lit("://"), host, rest), "url").alias("url"))


@query(f"SELECT page_id, regexp_replace(u, '^https?://(?:localhost|127\\.0\\.0\\.1|\\[::1\\])', 'https://docs.example.org') AS url FROM (SELECT page_id, {_LOCAL_URL} AS u FROM pages)")
def rewrite_localhost(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).select("page_id", urls.rewrite_localhost(F.col("url"), "https", "docs.example.org").alias("url"))


@query(r"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'thread_' || page_id || '.json' WHEN 1 THEN 'thread_4.json' WHEN 2 THEN 'a+b c/' || page_id WHEN 3 THEN 'q' || page_id WHEN 4 THEN '' WHEN 5 THEN 'Thread_' || page_id || '.json' WHEN 6 THEN 'forum/' || page_id || '/' ELSE regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/*', ''), '[?#].*$', '') END AS path FROM pages""")
def url_to_doc_path(spark: SparkSession, d: str) -> DataFrame:
    m, i = F.col("page_id") % 8, F.col("page_id").cast("string")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    u = F.when(m == 0, q("/forum/Thread/", i, "#p3")).when(m == 1, q("https://x.example/forum/4/", i, "?p=1")).when(m == 2, q("//a%2Bb%20c/", i)).when(m == 3, q("q", i, "%3Fpage=2")).when(m == 4, F.lit("#top")).when(m == 5, q("/Thread_", i)).when(m == 6, q("forum/", i, "/")).otherwise(F.col("url"))
    return tables.table(spark, d, "pages").select("page_id", urls.document_path(u).alias("path"))


@query(f"{views('images')} SELECT thread, post, array_to_string(list_transform(list_filter(list_transform(every, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(every, s.x) = s.i), lambda s: s.x), '|') AS urls FROM images")
def extract_image_urls(spark: SparkSession, d: str) -> DataFrame:
    return tables.posts(spark, d).select("thread", "post", joined(urls.image_urls(F.col("body"))).alias("urls"))


def _threads(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a forum file; some with another suffix, without posts, or broken."""
    c = tables.table(spark, d, "conversations")
    post = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("postId"), F.col("role").alias("username"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("2024-01-0"), F.col("turn") + 1, F.lit("T10:00:00Z"))).when(F.col("turn") % 3 == 2, "soon").alias("date"), F.when(F.col("turn") % 3 == 0, "yesterday").alias("rawDate"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("contentFull"), F.left(F.col("text"), F.lit(10)).alias("content"))
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(post)), lambda p: p.dropFields("turn")).alias("posts"))
    m = F.col("conv_id") % 5
    whole = F.to_json(F.struct(F.col("conv_id").cast("string").alias("threadId"), "posts"))
    text = F.when(m == 3, F.lit('{"threadId":"x","posts":7}')).when(m == 4, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    return t.select("conv_id", F.concat(F.lit("t_"), F.col("conv_id").cast("string"), F.when(m == 1, ".md").when(m == 2, ".JSON").otherwise(".json")).alias("path"), text.alias("content"))


@query("SELECT conv_id, CASE WHEN conv_id % 5 IN (0, 2) THEN count(*) END AS n_posts FROM conversations GROUP BY conv_id")
def parse_thread(spark: SparkSession, d: str) -> DataFrame:
    t = _threads(spark, d).select("conv_id", payloads.thread(F.col("path"), F.col("content")).alias("thread"))
    return t.select("conv_id", F.when(F.col("thread").isNotNull(), F.size("thread.posts")).cast("long").alias("n_posts"))


_POSTS = "SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE conv_id % 5 IN (0, 2)"


def _post_rows(spark: SparkSession, d: str) -> DataFrame:
    t = _threads(spark, d).select("conv_id", "path", payloads.thread(F.col("path"), F.col("content")).alias("thread"))
    return payloads.post_rows(t).withColumn("conv_id", F.col("thread_id").cast("long"))


@query(f"WITH p AS ({_POSTS}) SELECT conv_id, pos, CASE WHEN turn % 2 = 0 OR text = '' THEN left(text, 10) ELSE text END AS body, CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE '#' || (pos + 1) END AS label FROM p")
def post_fields(spark: SparkSession, d: str) -> DataFrame:
    return _post_rows(spark, d).select("conv_id", "pos", "body", "label")


@query(f"WITH p AS ({_POSTS}) SELECT conv_id, pos, CASE turn % 3 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2024-01-0' || (turn + 1) || 'T10:00:00Z' ELSE 'Unknown date' END AS date FROM p")
def post_date(spark: SparkSession, d: str) -> DataFrame:
    return _post_rows(spark, d).select("conv_id", "pos", "date")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS question, length(CASE WHEN length(text) > 3800 THEN left(text, 3800) || '...' ELSE text END) AS n_answer FROM documents")
def truncate_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.ellipsize(F.col("text"), 80).alias("question"), F.length(T.ellipsize(F.col("text"), 3800)).cast("long").alias("n_answer"))


def _frame(kind, text):
    """A stream frame of one of nine kinds around a text without quotes."""
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    out = q('{"choices":[],"content":"', text, '"}')
    shapes = ['{"choices":[{"delta":{"content":"%"}}]}', '{"choices":[{"delta":{"content":null,"reasoning_content":"%"}}]}', '{"choices":[{"text":"%"}]}', '{"choices":[{"message":{"content":"%"}}]}', '{"choices":[{"message":{"reasoning_content":"%"}}]}', '{"choices":[{}],"content":"%"}', '{"choices":[{}],"reasoning_content":"%"}', '{"choices":[{"delta":{"content":""},"text":"%"}]}']
    for n, shape in enumerate(shapes):
        a, b = shape.split("%")
        out = F.when(kind == n, q(a, text, b)).otherwise(out)
    return out


@query("SELECT event_id, CASE WHEN event_id % 9 = 7 THEN '' WHEN event_id % 9 < 7 THEN event_type END AS token FROM events WHERE event_id % 9 <> 8")
def delta_token(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events").select("event_id", payloads.delta_token(_frame(F.col("event_id") % 9, F.col("event_type"))).alias("token"))
    return e.where("token is not null")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE event_type END AS content, CASE WHEN event_id % 2 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS total_tokens FROM events""")
def completion_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    m, t = F.col("event_id") % 4, F.col("event_type")
    body = F.when(m == 0, F.concat(F.lit('"message":{"content":"'), t, F.lit('"}'))).when(m == 1, F.concat(F.lit('"message":{"content":"","reasoning_content":"'), t, F.lit('"}'))).when(m == 2, F.concat(F.lit('"message":{"content":""},"text":"'), t, F.lit('"'))).otherwise(F.lit('"message":{"content":""}'))
    finish = F.when(F.col("event_id") % 2 == 0, ',"finish_reason":"length"').otherwise(',"finish_reason":""')
    usage = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"usage":{"total_tokens":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise("")
    out = e.select("event_id", payloads.completion(F.concat(F.lit('{"choices":[{'), body, finish, F.lit("}]"), usage, F.lit("}"))).alias("c"))
    return out.select("event_id", "c.content", "c.finish_reason", "c.total_tokens")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 8 = 0 WHEN 1 THEN event_id % 3 = 0 WHEN 2 THEN event_id % 600 < 500 ELSE false END AS healthy,
    CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN event_id % 3 = 0 WHEN 2 THEN event_id % 600 < 500 ELSE false END AS reachable, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN event_id % 3 = 0 ELSE false END AS api_ok, event_id % 4 < 2 AS qdrant_ok,
    CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 ELSE 0 END AS points, CASE event_id % 4 WHEN 0 THEN event_id // 2 ELSE 0 END AS indexed, CASE event_id % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 50.0 ELSE 0.0 END::DOUBLE AS heap_percent FROM events""")
def health_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    i = F.col("event_id")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    old = q('{"status":"', F.when(i % 8 == 0, "healthy").otherwise("down"), '","services":{"api":"ok","qdrant":"ok"},"collection":{"pointsCount":', i, ',"indexedVectorsCount":', F.floor(i / 2), '},"memory":{"heapUsed":1,"heapTotal":4}}')
    new = q('{"reachable":', F.when(i % 3 == 0, "true").otherwise("false"), ',"details":{"qdrant":{"status":"ok","details":{"collections":{"documents":{"points_count":', i + 1, '}}}},"memory":{"heapUsed":2,"heapTotal":4}}}')
    code = q('{"status_code":', i % 600, "}")
    body = F.when(i % 4 == 0, old).when(i % 4 == 1, new).when(i % 4 == 2, code).otherwise("{}")
    return e.select("event_id", payloads.health(body).alias("h")).select("event_id", "h.*")


@query("SELECT p_partkey, floor((CAST(p_size AS BIGINT) * 512 / 8192.0::DOUBLE * CASE WHEN p_partkey % 6 = 0 THEN 4.0::DOUBLE ELSE p_partkey * 10000000 / 1073741824.0::DOUBLE END * 0.35::DOUBLE) * 100 + 0.5) / 100 AS gb FROM part")
def kv_estimate(spark: SparkSession, d: str) -> DataFrame:
    p = tables.table(spark, d, "part")
    return p.select("p_partkey", names.kv_gb(F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") * 10000000), F.col("p_size").cast("long") * 512).alias("gb"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS answer, event_id % 3 AS n_images, CASE WHEN event_id % 4 = 1 THEN event_id ELSE event_id % 3 END AS total_images, CASE event_id % 3 WHEN 0 THEN 'c' || event_id WHEN 1 THEN 'd' || event_id END AS conversation_id FROM events""")
def normalize_chat(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    answer = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('"answer":"'), F.col("event_type"), F.lit('",')))
    images = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('"images":['), F.array_join(F.array_repeat(F.lit('{"url":"u"}'), (i % 3).cast("int")), ","), F.lit("],")))
    total = F.when(i % 4 == 1, F.concat(F.lit('"totalImages":'), s)).otherwise('"totalImages":0')
    ids = F.when(i % 3 == 0, F.concat(F.lit(',"conversationId":"c'), s, F.lit('"'))).when(i % 3 == 1, F.concat(F.lit(',"conversationId":"","conversation_id":"d'), s, F.lit('"'))).otherwise("")
    out = e.select("event_id", payloads.chat(F.concat(F.lit("{"), answer, images, total, ids, F.lit("}"))).alias("c"))
    return out.select("event_id", "c.answer", F.size("c.images").cast("long").alias("n_images"), "c.total_images", "c.conversation_id")


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as captured bytes: a comment, a frame in two data lines for each turn, one that is no JSON,
    ``[DONE]`` in every third, and an unterminated end."""
    c = tables.table(spark, d, "conversations")
    usage = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"usage":{"prompt_tokens":'), F.col("turn"), F.lit(',"completion_tokens":7}'))).when(F.col("turn") % 3 == 1, ',"usage":{"prompt_tokens":null}').otherwise("")
    frame = F.concat(F.lit('data: {"turn":'), F.col("turn"), F.lit(',\r\ndata: "n":'), F.length("text"), usage, F.lit("}"))
    rows = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "\r\n\r\n").alias("body"))
    done = F.when(F.col("run_id") % 3 == 0, 'data: [DONE]\n\ndata: {"turn":99}\n\n').otherwise("")
    return rows.select("run_id", F.concat(F.lit(": hi\n\ndata: {bad\n\n"), "body", F.lit("\n\n"), done, F.lit('data: {"turn":100}')).alias("raw"))


@query("""SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS pos, turn, length(text) AS n, true AS ok FROM conversations UNION ALL SELECT DISTINCT conv_id, 1, NULL, NULL, false FROM conversations""")
def sse_decode(spark: SparkSession, d: str) -> DataFrame:
    good, bad = logs.sse_frames(captures(spark, d))
    a = good.select("run_id", "pos", F.get_json_object("json", "$.turn").cast("long").alias("turn"), F.get_json_object("json", "$.n").cast("long").alias("n"), F.lit(True).alias("ok"))
    return a.unionByName(bad.select("run_id", "pos", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("n"), F.lit(False).alias("ok")))


@query("""SELECT conv_id AS run_id, arg_max_null(CASE WHEN turn % 3 = 0 THEN turn END, turn) FILTER (turn % 3 < 2) AS prompt_tokens, CASE WHEN count(*) FILTER (turn % 3 = 0) > 0 THEN CAST(7 AS BIGINT) END AS completion_tokens
    FROM (SELECT * FROM conversations) GROUP BY conv_id""", name="usage_last")
def usage_last(spark: SparkSession, d: str) -> DataFrame:
    good, _ = logs.sse_frames(captures(spark, d))
    return payloads.last_usage(good)
