"""Queries over telemetry and ingestion progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import telemetry as ops
from quern.plans.registry._views import query, sql_time, text_time, views
from quern.sources import tables
from quern.sources.staging import staged


@query(f"""{views('messages')}, s AS (SELECT session AS run_id, count(*) AS samples, round(avg(value), 6) AS cpu_avg, max(value) AS cpu_max, round(avg(k), 6) AS memory_avg, max(k) AS memory_max, max(id) AS rss_max FROM messages GROUP BY 1),
    g AS (SELECT session AS run_id, max(u) AS gpu_memory_max, max(v) AS gpu_util_max FROM (SELECT session, k * 2 AS u, value AS v FROM messages UNION ALL SELECT session, k + 7, value + 1 FROM messages) GROUP BY 1)
    SELECT * FROM s LEFT JOIN g USING (run_id)""")
def resource_summary(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    samples = m.select(F.col("session").alias("run_id"), F.col("value").alias("cpu"), F.col("k").alias("memory"), F.col("id").alias("rss"))
    devices = m.select(F.col("session").alias("run_id"), F.explode(F.array(F.struct((F.col("k") * 2).alias("memory_used"), F.col("value").alias("util")), F.struct((F.col("k") + 7).alias("memory_used"), (F.col("value") + 1).alias("util")))).alias("g")).select("run_id", "g.*")
    out = ops.resource_summary(samples, devices)
    return out.withColumns({c: F.round(c, 6) for c in ("cpu_avg", "memory_avg")})


@query(f"""{views('messages')}, h AS (SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE greatest(0, 100 - k) + greatest(0, 60 - k) END AS gpu_free, greatest(1, k % 4) AS clients, k * 1000 AS available FROM messages)
    SELECT id, gpu_free, gpu_free // clients AS gpu_free_per_client, available // clients AS ram_per_client FROM h""")
def gpu_headroom(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    gpu = F.when(F.col("k") % 5 != 0, F.array(*[F.struct(F.lit(t).cast("long").alias("total"), F.col("k").alias("used")) for t in (100, 60)]))
    return ops.headroom(m.select("id", gpu.alias("gpu"), (F.col("k") * 1000).alias("available"), (F.col("k") % 4).alias("clients"))).select("id", "gpu_free", "gpu_free_per_client", "ram_per_client")


_COUNTERS = "SELECT session, ts, id, id * 1000 + k AS rx, k * 100000 AS tx FROM messages"


@query(f"""{views('messages')}, c AS ({_COUNTERS}), r AS (SELECT id, session, rx - lag(rx) OVER w AS drx, tx - lag(tx) OVER w AS dtx, greatest(0.001::DOUBLE, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE) AS dt, lag(id) OVER w AS before FROM c WINDOW w AS (PARTITION BY session ORDER BY ts, id)),
    q AS (SELECT id, session, CASE WHEN before IS NOT NULL THEN greatest(0, CAST(trunc(drx / dt) AS BIGINT)) END AS rx_rate, CASE WHEN before IS NOT NULL THEN greatest(0, CAST(trunc(dtx / dt) AS BIGINT)) END AS tx_rate FROM r)
    SELECT id, session, rx_rate, tx_rate, rx_rate + tx_rate AS total_rate FROM q""")
def network_rate(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d).select("session", "ts", "id", (F.col("id") * 1000 + F.col("k")).alias("rx"), (F.col("k") * 100000).alias("tx"))
    return ops.counter_rate(m, ["rx", "tx"], "session").select("id", "session", "rx_rate", "tx_rate", "total_rate")


@query(f"""{views('messages')} SELECT session, id, round(value / 1048576.0::DOUBLE, 9) AS mb, k FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS n FROM messages) WHERE n <= 60""")
def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    out = ops.last_n(tables.messages(spark, d), "session", 60, ["ts", "id"])
    return out.select("session", "id", F.round(F.col("value") / 1048576.0, 9).alias("mb"), "k")


@query(f"{views('messages')} SELECT channel, id FROM (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, id DESC) AS n FROM messages) WHERE n <= 300")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return ops.last_n(tables.messages(spark, d), "channel", 300, ["ts", "id"]).select("channel", "id")


@query(f"""{views('messages')}, r AS (SELECT id AS run_id, session, ts AS a, ts + INTERVAL 2 HOUR AS b FROM messages WHERE id % 20 = 0)
    SELECT r.run_id, r.session, m.id, m.value FROM r JOIN messages m ON m.session = r.session AND m.ts BETWEEN r.a AND r.b""")
def telemetry_in_run(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    runs = m.where("id % 20 = 0").select(F.col("id").alias("run_id"), "session", F.col("ts").alias("started_at"), (F.col("ts") + F.expr("interval 2 hours")).alias("ended_at"))
    return ops.samples_in_runs(runs, m.select("session", "ts", "id", "value"), by="session").select("run_id", "session", "id", "value")


@query(f"""{views('messages')}, r AS (SELECT id AS run_id, session, ts + INTERVAL 30 SECOND AS t FROM messages WHERE id % 10 = 3), s AS (SELECT session, ts, arg_max(value, id) AS value FROM messages GROUP BY session, ts)
    SELECT r.run_id, r.session, {sql_time('s.ts')} AS snapshot_at, s.value FROM r ASOF LEFT JOIN s ON r.session = s.session AND r.t >= s.ts""")
def snapshot_asof(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    runs = m.where("id % 10 = 3").select(F.col("id").alias("run_id"), "session", (F.col("ts") + F.expr("interval 30 seconds")).alias("started_at"))
    return ops.snapshot_asof(runs, m, "value", "session").select("run_id", "session", text_time("snapshot_at").alias("snapshot_at"), "value")


@query(f"""{views('messages')}, c AS (SELECT channel AS series, ts, id, 1 AS change FROM messages UNION ALL SELECT channel, ts + to_microseconds(k * 60000000), id + 100000000, -1 FROM messages)
    SELECT series, id, CAST(sum(change) OVER (PARTITION BY series ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM c""")
def active_counts(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    end = F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 60_000_000)
    c = m.select(F.col("channel").alias("series"), "ts", "id", F.lit(1).alias("change")).unionByName(m.select(F.col("channel").alias("series"), end.alias("ts"), (F.col("id") + 100_000_000).alias("id"), F.lit(-1).alias("change")))
    return ops.active_over_time(c).select("series", "id", "active")


# Time runs 600 times faster here, so that a window of a minute has several samples.
_PROGRESS = """SELECT channel AS job, epoch_us(ts) // 600 AS t, id, (epoch_us(ts) // 600 - t0) // 100000 + k - CASE WHEN id % 50 = 0 THEN 30 ELSE 0 END AS processed, t0
    FROM messages JOIN (SELECT channel, min(epoch_us(ts) // 600) AS t0 FROM messages GROUP BY channel) USING (channel)"""


def _progress(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d).select(F.col("channel").alias("job"), F.expr("unix_micros(ts) div 600").alias("t"), "id", "k")
    m = m.join(m.groupBy("job").agg(F.min("t").alias("t0")), "job")
    processed = F.expr("(t - t0) div 100000") + F.col("k") - F.when(F.col("id") % 50 == 0, 30).otherwise(0)
    return m.select("job", F.timestamp_micros("t").alias("ts"), "id", processed.alias("processed"), F.timestamp_micros("t0").alias("started_at"))


_RATE = f"""p AS ({_PROGRESS}), o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, id) AS n FROM p),
    f AS (SELECT *, greatest(min(n) OVER (PARTITION BY job ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), n - 119) AS a FROM o),
    r AS (SELECT f.job, f.id, CAST(f.processed AS BIGINT) AS processed, CASE WHEN f.a = f.n THEN f.processed::DOUBLE / greatest(1.0::DOUBLE, (f.t - f.t0) / 1e6::DOUBLE) ELSE greatest(0.0::DOUBLE, (f.processed - b.processed)::DOUBLE) / greatest(1.0::DOUBLE, (f.t - b.t) / 1e6::DOUBLE) END AS rate FROM f JOIN o b ON b.job = f.job AND b.n = f.a)"""


@query(f"{views('messages')}, {_RATE} SELECT job, id, round(rate, 6) AS rate FROM r")
def trailing_throughput(spark: SparkSession, d: str) -> DataFrame:
    return ops.throughput(_progress(spark, d)).select("job", "id", F.round("rate", 6).alias("rate"))


@query(f"""{views('messages')}, {_RATE}, g AS (SELECT job, id, greatest(0, 90000 - processed) AS remaining, rate, round(least(100.0::DOUBLE, 100.0::DOUBLE * processed / 90000), 4) AS percent FROM r),
    e AS (SELECT *, CASE WHEN rate > 0 THEN remaining / rate ELSE 0.0::DOUBLE END AS s FROM g)
    SELECT job, id, remaining, CAST(floor(s) AS BIGINT) AS eta_s, percent, CASE WHEN s = 0 THEN 'Estimating...' WHEN floor(s / 60) <= 0 THEN CAST(floor(s % 60) AS BIGINT) || 's' ELSE CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s % 60) AS BIGINT) || 's' END AS eta FROM e""")
def ingest_eta(spark: SparkSession, d: str) -> DataFrame:
    p = ops.throughput(_progress(spark, d)).withColumn("total", F.lit(90000).cast("long"))
    return ops.eta(p).select("job", "id", "remaining", F.floor("eta_s").cast("long").alias("eta_s"), "percent", "eta")


@query(f"""{views('messages')}, g AS (SELECT session, id, (epoch_us(lead(ts) OVER (PARTITION BY session ORDER BY ts, id)) - epoch_us(ts)) / 1e6::DOUBLE AS gap_s FROM messages)
    SELECT session, id, round(gap_s, 6) AS gap_s, coalesce(gap_s > 3600, false) AS stale FROM g""")
def stale_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = ops.stale(tables.messages(spark, d), 3600, "session")
    return out.select("session", "id", F.round("gap_s", 6).alias("gap_s"), "stale")


@query(f"""{views('messages')} SELECT round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, count(*) AS samples, count(*) FILTER (channel = 'view') AS n_view, count(*) FILTER (channel = 'click') AS n_click, count(*) FILTER (channel = 'purchase') AS n_purchase FROM messages""")
def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    log = tables.messages(spark, d).select("ts", F.col("value").alias("ms"), F.col("channel").alias("mode"))
    out = ops.retrieval_stats(log, ["view", "click", "purchase"], staged(ops.latency_sketches(log), "latency"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_ms", "p95_ms")})
