"""Queries over the corpus, its chunks and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import documents as ops
from quern.plans import ingest as plans
from quern.plans.registry._views import query, views
from quern.sources import tables
from quern.sources.files import file_catalog, ingest_files
from quern.sources.staging import new_path

_PATH = "source || '//' || (doc_id % 7) || '/' || doc_id || '.md'"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("//"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return tables.table(spark, d, "documents").select("doc_id", "text", path.alias("path"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two thirds of the documents."""
    return T.chunks(_docs(spark, d).where("doc_id % 3 <> 0"))


#: Ids whose documents of one source are one file.
FILE_IDS = 500

_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _files(spark: SparkSession, d: str) -> str:
    """A folder with text files of documents by source, of the documents of ``FILE_IDS`` ids each, and JSON files beside them
    that nobody wants. A file is read as one row, so its size must have a bound that does not grow with the source.

    There are very many files, so each task moves its own where they belong; else the driver would move all, one by one.
    The folder is new and read only after both writes, so nobody sees it half done."""
    docs = tables.table(spark, d, "documents").select("source", "text", F.floor(F.col("doc_id") / FILE_IDS).alias("part"))
    path = new_path(spark, "files")
    docs.repartition("source", "part").write.options(**_BY_TASKS).partitionBy("source", "part").text(path)
    docs.where("length(text) < 100").write.mode("append").options(**_BY_TASKS).partitionBy("source", "part").json(path)
    return path


@query(f"""{views('chunks')}, c AS (SELECT id, count(*) AS n FROM chunks WHERE id % 3 <> 0 GROUP BY id)
    SELECT {_PATH} AS path, doc_id || '.md' AS name, strlen(text) AS size, coalesce(n, 0) AS chunk_count, n IS NOT NULL AS indexed FROM documents LEFT JOIN c ON id = doc_id""")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return ops.list_documents(_docs(spark, d), _chunks(spark, d).withColumnRenamed("id", "doc_id"))


@query(f"SELECT doc_id, {_PATH} AS path, length(text) AS n FROM documents WHERE source = 'src1' AND doc_id = 21")
def get_document(spark: SparkSession, d: str) -> DataFrame:
    return ops.document_content(_docs(spark, d), "/src1/0/21.md").select("doc_id", "path", F.length("text").cast("long").alias("n"))


@query(f"""{views('chunks')}, c AS (SELECT id, count(*) AS n FROM chunks WHERE id % 3 <> 0 GROUP BY id) SELECT doc_id, coalesce(n, 0) AS chunk_count, n IS NOT NULL AS indexed FROM documents LEFT JOIN c ON id = doc_id""")
def doc_index_status(spark: SparkSession, d: str) -> DataFrame:
    return ops.index_status(_docs(spark, d).select("doc_id"), _chunks(spark, d).withColumnRenamed("id", "doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def missing_docs(spark: SparkSession, d: str) -> DataFrame:
    return ops.missing(_docs(spark, d), _chunks(spark, d).withColumnRenamed("id", "doc_id")).select("doc_id")


@query(f"""{views('chunks')} SELECT 'document' AS kind, doc_id AS id, -1 AS chunk_no FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'chunk', id, chunk_no FROM chunks WHERE id % 3 <> 0 AND id % 5 <> 0""")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    a, b = ops.delete_documents(docs, _chunks(spark, d).withColumnRenamed("id", "doc_id"), docs.where("doc_id % 5 = 0"))
    return a.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("chunk_no")).unionByName(b.select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), "chunk_no"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_only(spark: SparkSession, d: str) -> DataFrame:
    ids = tables.table(spark, d, "labels").where("quality = 1")
    return ops.selected(_docs(spark, d), ids).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, sha256(text || CASE WHEN doc_id % 4 = 0 THEN ' new' ELSE '' END) AS hash FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 0")
def new_or_changed(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    now = docs.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 4 == 0, " new").otherwise("")))
    return ops.delta(now, ops.manifest(docs.where("doc_id % 9 <> 0")))


@query("SELECT doc_id, sha256(CASE WHEN strlen(text) <= 16777216 THEN encode(text) ELSE unhex(left(hex(encode(text)), 33554432)) END) AS fingerprint FROM documents")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.content_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"{views('chunks')} SELECT p AS points, i AS indexed, greatest(0, p - i) AS gap, CAST(64 AS BIGINT) AS dimension FROM (SELECT count(*) AS p FROM chunks) a, (SELECT count(*) AS i FROM embeddings WHERE len(embedding) = 64) b")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.collection_stats(T.chunks(_docs(spark, d)), tables.table(spark, d, "embeddings"), 64)


_HISTORY = """SELECT o_orderkey AS id, o_orderpriority AS mode, CASE WHEN o_orderstatus = 'F' THEN o_custkey WHEN o_orderstatus = 'O' THEN o_custkey * 2 ELSE 0 END AS chunks, o_custkey % 11 AS files_updated, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS errors FROM orders"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    f, s = F.col("o_custkey"), F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("collection"), F.col("o_orderdate").alias("completed_at"), F.col("o_orderpriority").alias("mode"), F.when(s == "F", f).alias("chunks_upserted"), F.when(s == "O", f * 2).alias("processed_chunks"), (f % 11).alias("files_updated"), F.col("o_totalprice").alias("duration_s"), F.when(s == "P", 1).otherwise(0).cast("long").alias("errors"))


@query(f"WITH h AS ({_HISTORY}) SELECT mode, count(*) AS runs, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(files_updated) AS BIGINT) AS files, CAST(sum(errors) AS BIGINT) AS errors FROM h GROUP BY mode")
def ingest_history(spark: SparkSession, d: str) -> DataFrame:
    return ops.ingest_totals(_history(spark, d))


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS private, 's' || (c_custkey % 5) AS owner, CASE WHEN c_custkey % 10 = 0 THEN false WHEN c_custkey % 10 < 5 THEN true END AS can FROM customer)
    SELECT id, owner FROM p WHERE (NOT coalesce(private, false) OR owner = 's2') AND coalesce(can, true)""")
def visible_profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    p = tables.table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("private_to_session"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("owner_session"), F.when(k % 10 == 0, False).when(k % 10 < 5, True).alias("can_access"))
    return ops.visible_profiles(p, F.lit("s2")).select("id", F.col("owner_session").alias("owner"))


@query(f"{views('chunks')} SELECT id, chunk_no, len(x) AS n_tokens, array_to_string(x, ' ') AS text FROM chunks")
def chunk(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(_docs(spark, d))


@query(f"""{views('chunks')} SELECT id, count(*) AS n_chunks, CAST(sum(len(x)) AS BIGINT) AS n_tokens, CASE WHEN id % 9 = 0 THEN 'new' WHEN id % 4 = 0 THEN 'changed' END AS change FROM chunks WHERE id % 4 = 0 OR id % 9 = 0 GROUP BY id""")
def ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which a ninth is new and a quarter changed: the chunks made, and what kind of change it was."""
    docs = _docs(spark, d)
    old = docs.withColumn("text", F.concat(F.when(F.col("doc_id") % 4 == 0, "old ").otherwise(""), "text")).where("doc_id % 9 <> 0")
    out = plans.ingest(docs, ops.manifest(old), T.chunks(old))
    made = out.chunks.join(out.changes.withColumnRenamed("doc_id", "id"), "id")
    return made.groupBy("id", "change").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")).select("id", "n_chunks", "n_tokens", "change")


@query(r"""WITH t AS (SELECT conv_id AS id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (n <= 10) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE conv_id % 4 <> 0 GROUP BY conv_id),
    w AS (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM t), c0 AS (SELECT id, t, greatest(1, CAST(ceil((len(t) - 75) / 725.0) AS BIGINT)) AS c0 FROM w),
    c AS (SELECT id, t, c0 - CASE WHEN c0 > 1 AND len(t) - (c0 - 1) * 725 < 200 THEN 1 ELSE 0 END AS c FROM c0), x AS (SELECT id, t, c, unnest(range(0, c)) AS i FROM c),
    s AS (SELECT id, i AS chunk_no, list_slice(t, i * 725 + 1, CASE WHEN i = c - 1 THEN len(t) ELSE i * 725 + 800 END) AS s FROM x)
    SELECT id, chunk_no, len(s) AS n_tokens, array_to_string(s, ' ') AS text FROM s""")
def forum_ingest(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("post"), F.col("role").alias("author"), F.col("text").alias("body"))
    line = F.concat("author", F.lit(": "), "body")
    from pyspark.sql import Window

    first = c.withColumn("n", F.row_number().over(Window.partitionBy("thread").orderBy("post"))).where("n <= 10")
    known = first.where("thread % 4 = 0").groupBy(F.col("thread").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))
    return plans.forum_ingest(c, ops.manifest(known), 10, 800, 1000, 75)


@query("""SELECT conv_id, CAST(len(list_filter(ms, lambda m: true)) AS BIGINT) AS n_messages, ms[1] AS first_role, 'top_k,temperature' AS parameters, n_chars FROM
    (SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') = 0 THEN list_prepend('system', list(role ORDER BY turn)) ELSE list(role ORDER BY turn) END AS ms, CAST(sum(length(text)) + CASE WHEN count(*) FILTER (role = 'system') = 0 THEN 9 ELSE 0 END AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id)""")
def build_messages(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("top_k"), F.lit("40"), F.lit("stop"), F.lit(None).cast("string"), F.lit("temperature"), F.lit("0.7"))
    out = plans.build_payload(tables.table(spark, d, "conversations"), params, "Be brief.")
    back = out.select("conv_id", F.from_json("payload", "messages array<struct<role:string,content:string>>, parameters map<string,string>").alias("p"))
    chars = F.aggregate("p.messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return back.select("conv_id", F.size("p.messages").cast("long").alias("n_messages"), F.col("p.messages")[0]["role"].alias("first_role"), F.array_join(F.map_keys("p.parameters"), ",").alias("parameters"), chars.alias("n_chars"))


@query(f"SELECT source, count(DISTINCT doc_id // {FILE_IDS}) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY source")
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Files of one suffix below a folder, which holds documents by source: their number and size in each subfolder."""
    found = file_catalog(spark, _files(spark, d), "*.txt")
    return found.groupBy(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query("SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def upload_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files written to the shared folder, and those with an allowed extension read back whole."""
    found = ingest_files(spark, _files(spark, d), ["TXT", ".md"])
    return found.select(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"), F.length("text").alias("n")).groupBy("source").agg(F.sum("n").alias("n_chars"))
