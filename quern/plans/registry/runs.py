"""Queries over the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import runs as ops
from quern.plans.registry._views import ORACLE_SQL, query, sql_time, text_time, views
from quern.sources import logs, snapshots, tables
from quern.sources.staging import new_path
from quern.sources.tables import RUN, SUMMARY

_TIMES = ("created_at", "updated_at")


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[text_time(c).alias(c) if c in _TIMES else F.col(c) for c in columns])


def _sql_shown(columns: list[str]) -> str:
    return ", ".join(f"{sql_time(c)} AS {c}" if c in _TIMES else c for c in columns)


@query(f"{views('runs')} SELECT {_sql_shown(RUN.names)} FROM runs")
def scan_runs(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "runs")
    tables.runs(spark, d).write.parquet(path)
    return _shown(tables.scan_runs(spark, path), RUN.names)


_FULL = """'{"run_id":"u' || user_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","type":"' || event_type || '","payload":' || props || '}'"""


@query(f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT run_id, type, k, ts, n_chars, count(*) AS n FROM (
      SELECT 'u' || user_id AS run_id, event_type AS type, k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, length({_FULL}) AS n_chars FROM e WHERE event_id % 8 >= 6
      UNION ALL SELECT NULL, NULL, NULL, NULL, 1 FROM e WHERE event_id % 8 = 2 UNION ALL SELECT NULL, NULL, NULL, NULL, 5 FROM e WHERE event_id % 8 = 3
      UNION ALL SELECT 'u' || user_id, 'last', NULL, NULL, length('{{"run_id":"u' || user_id || '","type":"first","type":"last"}}') FROM e WHERE event_id % 8 = 4
      UNION ALL SELECT 'u' || user_id, 'nan', k, NULL, length('{{"run_id":"u' || user_id || '","type":"nan","payload":{{"k":' || k || ',"v":NaN}}}}') FROM e WHERE event_id % 8 = 5) GROUP BY ALL""")
def scan_event_log(spark: SparkSession, d: str) -> DataFrame:
    """A log on files: blank and broken lines, values that are no objects, a repeated key, a number that is none, and events."""
    e = tables.table(spark, d, "events")
    m, user, k = F.col("event_id") % 8, F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    own = lambda *parts: F.concat(F.lit('{"run_id":"u'), user, *[F.lit(x) if isinstance(x, str) else x for x in parts])
    full = own('","timestamp":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 'Z","type":"', F.col("event_type"), '","payload":', F.col("props"), "}  ")
    line = F.when(m == 0, " \u00a0 ").when(m == 1, "{bad").when(m == 2, "\u30003").when(m == 3, "[1,2]").when(m == 4, own('","type":"first","type":"last"}')).when(m == 5, own('","type":"nan","payload":{"k":', k, ',"v":NaN}}')).otherwise(full)
    path = new_path(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    out = logs.event_log(spark, path)
    # A line without a run's id has that of its file.
    run = F.when(F.col("type").isNotNull(), F.col("run_id"))
    number = F.regexp_extract("payload", r'"k":\s*(-?\d+)', 1).try_cast("long")
    out = out.select(run.alias("run_id"), "type", number.alias("k"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.length("value").cast("long").alias("n_chars"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS run_id, {sql_time('ts')} AS ts, event_type AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'é漢' || event_type AS note, count(*) AS n FROM events GROUP BY ALL")
def append_events(spark: SparkSession, d: str) -> DataFrame:
    """Appends the log in two goes and reads it back: every event with its run."""
    path = new_path(spark, "log")
    m = tables.messages(spark, d).select(F.col("session").alias("run_id"), F.col("ts").alias("timestamp"), F.col("channel").alias("type"), F.to_json(F.struct("k", F.concat(F.lit("é漢"), "channel").alias("note"))).alias("payload"))
    logs.append_events(m.where("type <> 'error'"), path)
    logs.append_events(m.where("type = 'error'"), path)
    out = logs.event_log(spark, path).select("run_id", text_time("timestamp").alias("ts"), "type", F.get_json_object("payload", "$.k").cast("long").alias("k"), F.get_json_object("payload", "$.note").alias("note"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(f"""{views('runs')}, req AS (SELECT run_id FROM runs WHERE run_id % 3 = 0), ex AS (SELECT run_id FROM runs WHERE run_id % 6 = 0)
    SELECT run_id, 'run' AS kind, 'running' AS status, {sql_time('created_at')} AS at, model, input_tokens IS NULL AND ttft_ms IS NULL AS blank FROM (SELECT run_id, created_at, model, NULL AS input_tokens, NULL AS ttft_ms FROM runs WHERE run_id % 3 = 0 AND run_id % 6 <> 0)
    UNION ALL SELECT run_id, 'event', 'run_started', {sql_time('created_at')}, NULL, true FROM runs WHERE run_id % 3 = 0 AND run_id % 6 <> 0
    UNION ALL SELECT run_id, 'taken', NULL, {sql_time('created_at')}, model, true FROM runs WHERE run_id % 6 = 0""")
def create_run(spark: SparkSession, d: str) -> DataFrame:
    r = tables.runs(spark, d)
    asked = r.where("run_id % 3 = 0").select("run_id", "created_at", "model", "request_messages_json", "settings_json", "resources_json")
    made, events, taken = ops.create_runs(asked, r.where("run_id % 6 = 0"))
    none = F.lit(None).cast("string")
    a = made.select("run_id", F.lit("run").alias("kind"), "status", text_time("created_at").alias("at"), "model", (F.col("input_tokens").isNull() & F.col("ttft_ms").isNull()).alias("blank"))
    b = events.select("run_id", F.lit("event").alias("kind"), F.col("type").alias("status"), text_time("timestamp").alias("at"), none.alias("model"), F.lit(True).alias("blank"))
    c = taken.select("run_id", F.lit("taken").alias("kind"), none.alias("status"), text_time("created_at").alias("at"), "model", F.lit(True).alias("blank"))
    return a.unionByName(b).unionByName(c)


@query(f"""{views('runs')}, f AS (SELECT * FROM (SELECT l_orderkey AS run_id, l_shipdate AS finished_at, l_returnflag AS status, sum(l_quantity) AS total_time_ms, count(*) AS output_tokens,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_returnflag) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 3) WHERE n = 1)
    SELECT r.run_id, CASE WHEN f.run_id IS NULL THEN r.status ELSE f.status END AS status, CASE WHEN f.run_id IS NULL THEN r.ttft_ms END AS ttft_ms,
        CASE WHEN f.run_id IS NULL THEN r.total_time_ms ELSE f.total_time_ms END AS total_time_ms, CASE WHEN f.run_id IS NULL THEN r.input_tokens END AS input_tokens,
        CASE WHEN f.run_id IS NULL THEN r.output_tokens ELSE f.output_tokens END AS output_tokens, CASE WHEN f.run_id IS NULL THEN r.error END AS error,
        {sql_time('CASE WHEN f.run_id IS NULL THEN r.updated_at ELSE f.finished_at END')} AS updated_at FROM runs r LEFT JOIN f USING (run_id)""")
def finalize_run(spark: SparkSession, d: str) -> DataFrame:
    return _finalized(ops.apply_finalize(tables.runs(spark, d), _finals(spark, d)))


@query(ORACLE_SQL["finalize_run"])
def finalize_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The same on a snapshot in buckets, of which only those with a run that has finished are rewritten."""
    path = new_path(spark, "snapshot")
    snapshots.write_snapshot(tables.runs(spark, d), path, "run_id", 16)
    snapshots.update_snapshot(spark, path, "run_id", _finals(spark, d), ops.apply_finalize)
    return _finalized(snapshots.read_snapshot(spark, path))


def _finals(spark: SparkSession, d: str) -> DataFrame:
    li = tables.table(spark, d, "lineitem").where("l_orderkey % 2 = 0")
    finals = li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("finished_at"), F.col("l_returnflag").alias("status")).agg(F.sum("l_quantity").alias("total_time_ms"), F.count("*").alias("output_tokens"))
    return finals.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("ttft_ms", "double"), ("input_tokens", "long"), ("tokens_per_s", "double"), ("resources_json", "string"), ("error", "string"))])


def _finalized(out: DataFrame) -> DataFrame:
    return out.select("run_id", "status", "ttft_ms", "total_time_ms", "input_tokens", "output_tokens", "error", text_time("updated_at").alias("updated_at"))


#: Runs that one task exports at most, about.
RUNS_A_TASK = 100_000


@query(f"""{views('runs', 'tokens')}, e AS (SELECT run_id, count(*) AS n, string_agg(index || ':' || token, ';' ORDER BY ts, index) AS log FROM tokens GROUP BY run_id)
    SELECT run_id, model, status, coalesce(n, 0) AS n_events, coalesce(log, '') AS log FROM runs LEFT JOIN e USING (run_id) WHERE run_id % 5 = 0""")
def export_run(spark: SparkSession, d: str) -> DataFrame:
    r = tables.runs(spark, d)
    ids = r.where("run_id % 5 = 0").select("run_id")
    # A task sorts and gathers its runs' events in memory, so tasks grow in number and not in size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // RUNS_A_TASK))
    out = ops.export_runs(r, tables.tokens(spark, d, tasks), ids)
    log = F.array_join(F.transform("events", lambda e: F.concat(e["index"].cast("string"), F.lit(":"), e["token"])), ";")
    return out.select("run_id", "model", "status", F.size("events").cast("long").alias("n_events"), log.alias("log"))


@query(f"{views('runs')} SELECT {_sql_shown(SUMMARY)} FROM runs")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ops.run_summary(tables.runs(spark, d)), SUMMARY)


@query(f"""{views('runs')} SELECT run_id, {sql_time('created_at')} AS created_at, status, 'user' AS role, 'order ' || input_tokens AS content, CASE WHEN settings_json IS NULL THEN 0 ELSE 1 END AS n_settings,
    json_extract_string(settings_json, '$.top_k') AS top_k, 0 AS n_resources FROM runs WHERE run_id = 100""")
def run_detail(spark: SparkSession, d: str) -> DataFrame:
    out = ops.run_detail(tables.runs(spark, d), 100)
    m = F.col("request_messages")[0]
    return out.select("run_id", text_time("created_at").alias("created_at"), "status", m["role"].alias("role"), m["content"].alias("content"), F.size("settings").alias("n_settings"), F.col("settings")["top_k"].alias("top_k"), F.size("resources").alias("n_resources"))


@query(f"{views('runs', 'tokens')} SELECT run_id, status, index, token, {sql_time('ts')} AS ts FROM runs LEFT JOIN tokens USING (run_id)")
def run_events_join(spark: SparkSession, d: str) -> DataFrame:
    out = ops.runs_with_events(tables.runs(spark, d).select("run_id", "status"), tables.tokens(spark, d))
    return out.select("run_id", "status", "index", "token", text_time("ts").alias("ts"))


@query(f"{views('runs')} SELECT run_id, model, ttft_ms, total_time_ms, tokens_per_s, 'user: order ' || input_tokens AS prompt, coalesce(settings_json, '{{}}') AS settings, '{{}}' AS resources FROM runs WHERE run_id % 97 = 0")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    r = tables.runs(spark, d)
    return ops.compare_runs(r, r.where("run_id % 97 = 0").select("run_id"))


@query(f"""{views('runs', 'tokens')}, t AS (SELECT run_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM tokens GROUP BY run_id),
    u AS (SELECT run_id, CASE WHEN run_id % 4 = 0 THEN input_tokens END AS used FROM runs),
    m AS (SELECT r.run_id, epoch_us(a) / 1000.0 - epoch_us(r.created_at) / 1000.0 AS ttft_ms, epoch_us(b) / 1000.0 - epoch_us(r.created_at) / 1000.0 AS total_time_ms, CAST(coalesce(used, n, 0) AS BIGINT) AS output_tokens FROM runs r LEFT JOIN t USING (run_id) LEFT JOIN u USING (run_id))
    SELECT run_id, CAST(ttft_ms AS DOUBLE) AS ttft_ms, CAST(total_time_ms AS DOUBLE) AS total_time_ms, output_tokens, CASE WHEN total_time_ms > 0 AND output_tokens > 0 THEN output_tokens / (total_time_ms / 1000) END AS tokens_per_s FROM m""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = tables.runs(spark, d)
    return ops.run_metrics(r, tables.tokens(spark, d), r.select("run_id", F.when(F.col("run_id") % 4 == 0, F.col("input_tokens")).alias("output_tokens")))


@query(f"{views('tokens')} SELECT run_id, string_agg(token, '' ORDER BY index) AS text FROM tokens GROUP BY run_id")
def concat_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ops.assemble(tables.tokens(spark, d))


@query(f"""{views('runs', 'tokens')}, f AS (SELECT run_id, ts, index, CASE WHEN n % 5 = 0 THEN '' ELSE token END AS token FROM tokens)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, index) AS token_index, token, CAST((epoch_us(ts) - epoch_us(created_at)) / 1000 AS DOUBLE) AS elapsed_ms FROM f JOIN runs USING (run_id) WHERE token <> ''""")
def token_index(spark: SparkSession, d: str) -> DataFrame:
    t = tables.tokens(spark, d).select("run_id", "ts", F.col("index").alias("seq"), F.when(F.col("n") % 5 == 0, "").otherwise(F.col("token")).alias("token"))
    return ops.index_tokens(t, tables.runs(spark, d))


@query(f"{views('tokens')} SELECT run_id, {sql_time('ts')} AS ts, token, n FROM tokens WHERE index = 1")
def first_token(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_token(tables.tokens(spark, d)).select("run_id", text_time("ts").alias("ts"), "token", "n")


@query("""WITH c AS (SELECT l_orderkey AS run_id, l_shipdate AS ts, CASE l_linenumber % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'started' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'finished' END AS status, l_linenumber % 5 AS place FROM lineitem)
    SELECT run_id, status FROM (SELECT run_id, status, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, place DESC) AS n FROM c) WHERE n = 1""")
def lifecycle_latest(spark: SparkSession, d: str) -> DataFrame:
    li = tables.table(spark, d, "lineitem")
    status = F.element_at(F.array(*[F.lit(s) for s in ops.STATES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return ops.run_status(li.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("ts"), status.alias("status")))


@query(f"{views('runs')} SELECT {_sql_shown(SUMMARY)} FROM runs ORDER BY runs.created_at DESC, run_id DESC LIMIT 100")
def list_runs(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ops.list_runs(tables.runs(spark, d)), SUMMARY)


@query(f"{views('runs')} SELECT run_id, model, tokens_per_s, row_number() OVER (ORDER BY coalesce(tokens_per_s, 0) DESC, run_id) AS rank FROM runs")
def sort_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by tokens a second, with their places among all runs."""
    return ops.ranked_runs(tables.runs(spark, d), "tps").select("run_id", "model", "tokens_per_s", "rank")


@query(f"{views('runs')} SELECT DISTINCT model AS name, CAST(1 AS BIGINT) AS priority FROM runs UNION ALL SELECT 'local-7B', 0")
def distinct_models(spark: SparkSession, d: str) -> DataFrame:
    return ops.model_choices(tables.runs(spark, d).select(F.col("model").alias("name")), "local-7B")


@query(f"""{views('runs', 'tokens')}, x AS (SELECT t.run_id, CASE WHEN t.n % 3 = 0 THEN NULL WHEN t.n % 3 = 1 THEN t.run_id ELSE t.run_id + 1 END AS shown, token, index FROM tokens t)
    SELECT run_id, index, token FROM x WHERE run_id IS NULL OR shown IS NULL OR run_id = shown""")
def drop_foreign_run(spark: SparkSession, d: str) -> DataFrame:
    from quern.operators.messages import active_run_only

    m = F.col("n") % 3
    t = tables.tokens(spark, d).withColumn("shown", F.when(m == 0, F.lit(None)).when(m == 1, F.col("run_id")).otherwise(F.col("run_id") + 1))
    return active_run_only(t, "shown").select("run_id", "index", "token")

