"""Queries over bus messages and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import messages as ops
from quern.plans.registry._views import joined, query, sql_time, text_time, views
from quern.sources import tables


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "conversations")


@query("""SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, -1, 'system', 'Be brief.' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0""")
def inject_system_prompt(spark: SparkSession, d: str) -> DataFrame:
    return ops.inject_system(_conversations(spark, d), "Be brief.")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'temperature=' || c_nationkey END, CASE WHEN c_custkey % 3 = 0 THEN 'top_k=' || c_custkey END, 'seed=1'], lambda x: x IS NOT NULL), ',') AS parameters FROM customer""")
def drop_null_params(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "customer")
    m = F.create_map(F.lit("temperature"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")), F.lit("top_k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")), F.lit("seed"), F.lit("1"))
    return c.select("c_custkey", F.array_join(F.transform(F.map_entries(ops.drop_nulls(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("parameters"))


@query(f"""{views('messages')}, m AS (SELECT id, CASE channel WHEN 'view' THEN 'tokens' WHEN 'click' THEN 'events' WHEN 'error' THEN 'logs' ELSE 'telemetry' END AS channel, CASE WHEN k % 4 = 0 THEN '' ELSE 's' || (session % 10) END AS session FROM messages),
    s AS (SELECT * FROM (VALUES (1, 'tokens', 's1'), (1, 'events', 's1'), (2, 'tokens', NULL), (3, 'logs', 's3'), (3, 'events', 's3')) v(subscriber, channel, own_session))
    SELECT subscriber, id, m.channel FROM m JOIN s ON m.channel = s.channel WHERE NOT (m.channel IN ('tokens', 'events') AND coalesce(session, '') <> '' AND coalesce(own_session, '') <> '' AND session <> own_session)""")
def route_messages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("channel") == "view", "tokens").when(F.col("channel") == "click", "events").when(F.col("channel") == "error", "logs").otherwise("telemetry")
    m = tables.messages(spark, d).select("id", kind.alias("channel"), F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("session") % 10).cast("string"))).alias("session"))
    s = spark.createDataFrame([(1, "tokens", "s1"), (1, "events", "s1"), (2, "tokens", None), (3, "logs", "s3"), (3, "events", "s3")], "subscriber int, channel string, own_session string")
    return ops.route(m, s).select("subscriber", "id", "channel")


@query("""WITH w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' logs, tokens' WHEN 2 THEN 'zeta,logs,' || c_mktsegment ELSE NULL END AS wanted FROM customer),
    n AS (SELECT c_custkey, list_filter(list_transform(string_split(coalesce(wanted, ''), ','), lambda c: trim(c)), lambda c: c <> '') AS n FROM w)
    SELECT c_custkey, array_to_string(list_sort(CASE WHEN len(n) = 0 THEN ['events', 'lounge', 'logs', 'telemetry', 'tokens'] ELSE list_distinct(n) END), '|') AS channels,
        nullif(array_to_string(list_sort(list_distinct(list_filter(n, lambda c: c NOT IN ('events', 'lounge', 'logs', 'telemetry', 'tokens')))), ', '), '') AS unknown FROM n""")
def validate_channels(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    c = tables.table(spark, d, "customer").select("c_custkey", F.when(m == 0, "").when(m == 1, " logs, tokens").when(m == 2, F.concat(F.lit("zeta,logs,"), F.col("c_mktsegment"))).alias("wanted"))
    return ops.channel_errors(c).select("c_custkey", joined(F.array_sort("channels")).alias("channels"), "unknown")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'robot' ELSE role END AS role, CASE WHEN turn % 7 = 3 THEN '   ' ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'role' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 2000 THEN 'too long' ELSE 'ok' END AS result FROM t""")
def validate_request(spark: SparkSession, d: str) -> DataFrame:
    t = _conversations(spark, d).withColumn("role", F.when(F.col("turn") % 5 == 4, "robot").otherwise(F.col("role"))).withColumn("text", F.when(F.col("turn") % 7 == 3, "   ").otherwise(F.col("text")))
    good, bad = ops.validated(t)
    return good.select("conv_id", "turn", F.lit("ok").alias("result")).unionByName(bad.select("conv_id", "turn", F.col("reason").alias("result")))


@query("""WITH m AS (SELECT role AS channel, conv_id * 100 + turn AS seq, CASE WHEN turn % 2 = 0 THEN 'c' || conv_id END AS conversation FROM conversations)
    SELECT channel, seq, last_value(conversation IGNORE NULLS) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM m""")
def channel_context(spark: SparkSession, d: str) -> DataFrame:
    m = _conversations(spark, d).select(F.col("role").alias("channel"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("conversation"))
    return ops.with_context(m).select("channel", "seq", "context")


@query(f"""{views('messages', 'tokens')} SELECT channel, {sql_time('ts')} AS timestamp, id, n FROM (SELECT 'events' AS channel, ts, id, NULL AS n FROM messages UNION ALL SELECT 'tokens', ts, run_id, index FROM tokens)""")
def union_channels(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d).select("ts", "id")
    t = tables.tokens(spark, d).select("ts", F.col("run_id").alias("id"), F.col("index").alias("n"))
    out = ops.multiplex(events=m, tokens=t)
    return out.select("channel", text_time("timestamp").alias("timestamp"), F.get_json_object("payload", "$.id").cast("long").alias("id"), F.get_json_object("payload", "$.n").cast("long").alias("n"))


_COOLDOWN = """WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT session, id, ts, n, ts AS last, true AS accepted, CAST(NULL AS BIGINT) AS wait_us FROM e WHERE n = 1
      UNION ALL SELECT e.session, e.id, e.ts, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(r.last) >= 14400000000 THEN e.ts ELSE r.last END, epoch_us(e.ts) - epoch_us(r.last) >= 14400000000,
        CASE WHEN epoch_us(e.ts) - epoch_us(r.last) < 14400000000 THEN epoch_us(r.last) + 14400000000 - epoch_us(e.ts) END FROM r JOIN e ON e.session = r.session AND e.n = r.n + 1)
    SELECT session, id, accepted, CAST(ceil(wait_us / 1e6) AS BIGINT) AS wait_s FROM r"""


@query(_COOLDOWN)
def cooldown_accept(spark: SparkSession, d: str) -> DataFrame:
    return ops.cooldown(tables.messages(spark, d), 14400).select("session", "id", "accepted", "wait_s")


@query(f"{views('messages')} SELECT session, k, id FROM (SELECT *, row_number() OVER (PARTITION BY session, k ORDER BY ts, id) AS n FROM messages) WHERE n = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedupe_first(tables.messages(spark, d), ["session", "k"], ["ts", "id"]).select("session", "k", "id")


@query(f"{views('messages')} SELECT k, max(id) AS last_used FROM messages GROUP BY k ORDER BY last_used DESC, k LIMIT 30")
def dedupe_move_front(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_distinct(tables.messages(spark, d), "k", "id", 30)


@query("""WITH b AS (SELECT conv_id, 'system: Be brief.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, max(turn) AS t FROM conversations GROUP BY conv_id),
    u AS (SELECT conv_id, length(body) + len(list_filter(string_split(body, ''), lambda c: unicode(c) > 65535)) AS units, t FROM b),
    e AS (SELECT conv_id, greatest(1, CAST(floor(units / 4.0 + 0.5) AS BIGINT)) AS estimated, t * 200 AS known FROM u), f AS (SELECT conv_id, estimated, greatest(estimated, known) AS used FROM e)
    SELECT conv_id, estimated, used, round(used / 2000::DOUBLE * 100, 6) AS percent, CASE WHEN used / 2000::DOUBLE * 100 < 70 THEN 'ok' WHEN used / 2000::DOUBLE * 100 < 90 THEN 'high' ELSE 'full' END AS band FROM f""")
def context_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = _conversations(spark, d)
    known = c.groupBy("conv_id").agg((F.max("turn") * 200).alias("input_tokens"))
    return ops.context_fill(c, 2000, "Be brief.", known)


@query(f"""{views('messages')} SELECT id, coalesce(nullif(trim(CASE WHEN k % 3 = 0 THEN '  ' WHEN k % 3 = 1 THEN ' Ann ' END), ''), 'user-' || left('s' || session || 'abcdefgh', 6)) AS alias, trim('  ' || channel || ' ') AS text FROM messages WHERE k % 7 <> 0""")
def default_alias(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    alias = F.when(F.col("k") % 3 == 0, "  ").when(F.col("k") % 3 == 1, " Ann ")
    rows = m.select("id", alias.alias("alias"), F.concat(F.lit("s"), F.col("session").cast("string"), F.lit("abcdefgh")).alias("session"), F.when(F.col("k") % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("channel"), F.lit(" "))).alias("text"))
    return ops.lounge_normalized(rows).select("id", "alias", "text")
