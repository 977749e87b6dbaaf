"""Queries that run the streaming operators to their end over the given tables, and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry._views import ORACLE_SQL, query, sql_time, text_time, views
from quern.plans.registry.messages import _COOLDOWN
from quern.plans.registry.scalars import captures
from quern.plans.registry.telemetry import _COUNTERS
from quern.session import configured
from quern.sources import tables
from quern.sources.staging import new_path, staged
from quern.streaming import streams as ops

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream; the reader takes the table's file or folder."""
    schema = tables.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = _source(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("channel"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


#: Days of event time in a file of ``_arriving``, how far its watermark lags, and rows of a file.
SLOT_DAYS, LAG_DAYS, FILE_ROWS = 6, 13, 1_000_000
#: Seconds that are released at once.
RELEASED_S = 86400.0


def _arriving(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows (with a timestamp ``ts``) as a stream that takes one stretch of time after the other, as files that were
    written in that order, with one late: a tenth of the second stretch comes after the third. One trigger a stretch.
    Two last triggers bring an event of no key, so far ahead that the watermark passes all others, and then what was
    set up as it passed them."""
    path = new_path(spark, "arriving")
    slot = F.floor(F.unix_seconds("ts") / (86400 * SLOT_DAYS))
    cut = staged(rows.withColumn("_slot", slot), "slots")
    order = sorted(r[0] for r in cut.where("_slot is not null").select("_slot").distinct().collect())
    late = F.pmod(F.xxhash64("id"), F.lit(10)) == 7
    parts = [F.col("_slot") == k if n != 1 else (F.col("_slot") == k) & ~late for n, k in enumerate(order)]
    if len(order) > 2:
        parts.insert(3, (F.col("_slot") == order[1]) & late)
    files = max(1, -(-cut.count() // FILE_ROWS))
    for part in parts:
        cut.where(part).drop("_slot").repartition(files).write.mode("append").parquet(path)
    for ahead in (LAG_DAYS + 4, LAG_DAYS + 8):
        last = rows.agg(F.max("ts").alias("ts")).select(F.explode(F.sequence(F.lit(1), F.lit(files))), *[(F.col("ts") + F.expr(f"interval {ahead} days") if f.name == "ts" else F.lit(-1 if f.name == "id" else None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        last.drop("col").repartition(files).write.mode("append").parquet(path)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path).withWatermark("ts", f"{LAG_DAYS} days")


def _ran(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads its sink. Updates are kept with their batch's number."""
    spark = configured(out.sparkSession)
    path = new_path(spark, "stream")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        done = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        done = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    done.awaitTermination()
    schema = out.schema if mode == "append" else out.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{path}/out")


@query("SELECT event_id AS id, event_type AS channel, value FROM events WHERE event_type IN ('view', 'error')")
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.stream_events(spark, f"{d}/events.parquet*", tables.table(spark, d, "events").schema, channels=["view", "error"])
    return _ran(rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), "value"))


@query(f"""{views('tokens')}, c AS (SELECT run_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM tokens GROUP BY run_id)
    SELECT run_id, CAST((epoch_us(a) - epoch_us(o_orderdate)) / 1000 AS DOUBLE) AS ttft_ms, CAST((epoch_us(b) - epoch_us(o_orderdate)) / 1000 AS DOUBLE) AS total_time_ms, n AS output_tokens, CASE WHEN epoch_us(b) > epoch_us(o_orderdate) THEN n / ((epoch_us(b) - epoch_us(o_orderdate)) / 1000000.0::DOUBLE) END AS tokens_per_s FROM c JOIN orders ON o_orderkey = run_id""")
def stream_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    t = _source(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    out = _ran(ops.stream_run_metrics(t.join(o, "run_id").where("ts >= created_at")), "update")
    last = out.groupBy("run_id").agg(F.max_by(F.struct("ttft_ms", "total_time_ms", "output_tokens", "tokens_per_s"), "batch").alias("m"))
    return last.select("run_id", "m.*")


@query(f"{views('messages')} SELECT session AS key, string_agg(id, '|' ORDER BY ts, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS n FROM messages) WHERE n <= 50 GROUP BY session")
def stream_last_n(spark: SparkSession, d: str) -> DataFrame:
    out = _ran(ops.stream_last_n(_events(spark, d), 50), "update")
    last = out.groupBy("key").agg(F.max_by("ids", "batch").alias("ids"))
    return last.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"))


@query(_COOLDOWN.replace("SELECT session, id, accepted, CAST(ceil(wait_us / 1e6) AS BIGINT) AS wait_s FROM r", "SELECT session AS key, id, accepted FROM r"))
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Over several files, one of them late; state expires after eight hours of event time."""
    rows = tables.messages(spark, d).select("id", "ts", "session")
    return _ran(ops.stream_cooldown(_arriving(spark, rows), 14400, ordered=True, slot_s=RELEASED_S))


@query(f"""{views('messages')}, m AS (SELECT session AS key, id, ts, CASE WHEN k % 2 = 0 THEN channel || k END AS conversation FROM messages), r AS (SELECT key, id, ts, last_value(conversation IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM m)
    SELECT key, id, context FROM r""")
def stream_context(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as channels, over several files, one of them late."""
    conversation = F.when(F.col("k") % 2 == 0, F.concat("channel", F.col("k").cast("string")))
    rows = tables.messages(spark, d).select("id", "ts", "session", conversation.alias("conversation"))
    return _ran(ops.stream_context(_arriving(spark, rows), "session", ordered=True, slot_s=RELEASED_S))


@query(f"""{views('messages')}, r AS (SELECT session AS key, ts, lead(ts) OVER (PARTITION BY session ORDER BY ts, id) - ts AS gap FROM messages)
    SELECT key, {sql_time('ts')} AS last_seen, count(*) AS n FROM r WHERE coalesce(gap > INTERVAL 12 HOUR, true) GROUP BY 1, 2""")
def stream_stale(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are silent for over twelve hours, over several files, one of them late."""
    rows = tables.messages(spark, d).select("id", "ts", "session")
    out = _ran(ops.stream_stale(_arriving(spark, rows), 12 * 3600, "session", RELEASED_S))
    return out.groupBy("key", text_time("last_seen").alias("last_seen")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, event_type AS channel FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice in the stream, once in the result."""
    e = _events(spark, d).withWatermark("ts", "1 hour").select("id", "ts", "channel", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _ran(ops.stream_dedupe(e).select("id", "channel"))


@query(ORACLE_SQL["sse_decode"])
def stream_sse(spark: SparkSession, d: str) -> DataFrame:
    """Captures cut into chunks of 7 to 36 bytes that come in three parts, frames and line ends cut through."""
    size = F.lit(7) + F.pmod(F.col("run_id"), F.lit(30)).cast("int")
    raw = F.encode("raw", "UTF-8")
    cut = captures(spark, d).select("run_id", raw.alias("raw"), size.alias("size")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor(F.length("raw") / F.col("size")).cast("int"))))
    chunks = staged(cut.select("run_id", "seq", F.col("raw").substr(F.col("seq") * F.col("size") + 1, F.col("size")).alias("chunk")), "chunks")
    path = new_path(spark, "arriving")
    files = max(1, -(-chunks.count() // FILE_ROWS))
    # A run has one file of each part, so its chunks arrive in order wherever triggers end.
    for part in ("seq < 3", "seq between 3 and 9", "seq > 9"):
        chunks.where(part).repartition(files, "run_id").write.mode("append").parquet(path)
    out = _ran(ops.stream_sse(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", files).parquet(path)))
    number = lambda name: F.when(F.col("ok"), F.get_json_object("json", f"$.{name}").cast("long")).alias(name)
    return out.select(F.col("key").alias("run_id"), "pos", number("turn"), number("n"), "ok")


@query(f"""{views('messages')}, w AS (SELECT channel AS job, epoch_us(ts) AS t, id, unnest(range(epoch_us(ts) // 600000000 * 600000000 - 3000000000, epoch_us(ts) // 600000000 * 600000000 + 1, 600000000)) AS a FROM messages),
    g AS (SELECT job, a, count(*) AS samples, min_by(id, t) AS x, max_by(id, t) AS y, min(t) AS t0, max(t) AS t1 FROM w WHERE t < a + 3600000000 GROUP BY 1, 2)
    SELECT job, {sql_time('make_timestamp(a)')} AS window_start, samples, round(greatest(0.0::DOUBLE, (y - x)::DOUBLE) / greatest(1.0::DOUBLE, (t1 - t0) / 1e6::DOUBLE), 6) AS rate FROM g""")
def stream_throughput(spark: SparkSession, d: str) -> DataFrame:
    p = _events(spark, d).select(F.col("channel").alias("job"), "ts", F.col("id").alias("processed"))
    out = _ran(ops.stream_throughput(p, "60 minutes", "10 minutes"), "complete")
    newest = out.groupBy("job", "window_start").agg(F.max_by(F.struct("samples", "rate"), "batch").alias("m"))
    return newest.select("job", text_time("window_start").alias("window_start"), "m.samples", F.round("m.rate", 6).alias("rate"))


@query(f"{views('chunks')} SELECT id, chunk_no, len(x) AS n_tokens FROM chunks")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "ingest")
    docs = _source(spark, d, "documents").select("doc_id", "text")
    ops.stream_ingest(docs, f"{path}/chunks", f"{path}/checkpoint").awaitTermination()
    return ops.latest_chunks(spark, f"{path}/chunks").select("id", "chunk_no", "n_tokens")


@query(f"""{views('messages')}, c AS ({_COUNTERS}), r AS (SELECT session AS key, id, ts, rx - lag(rx) OVER w AS d, greatest(0.001::DOUBLE, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE) AS dt FROM c WINDOW w AS (PARTITION BY session ORDER BY ts, id))
    SELECT key, id, CASE WHEN d IS NOT NULL THEN greatest(0, CAST(trunc(d / dt) AS BIGINT)) END AS rate FROM r""")
def stream_telemetry_rate(spark: SparkSession, d: str) -> DataFrame:
    """Over several files, one of them late."""
    rows = tables.messages(spark, d).select("session", "ts", "id", (F.col("id") * 1000 + F.col("k")).alias("rx"))
    return _ran(ops.stream_rate(_arriving(spark, rows), "rx", "session", ordered=True, slot_s=RELEASED_S))
