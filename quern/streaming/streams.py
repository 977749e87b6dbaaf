"""Streaming forms of bus, log and telemetry operators.

Each takes a streaming DataFrame and returns one; sinks and triggers are the caller's. Stateful operators sort what a
micro-batch brings by time before they fold it; an operator whose result depends on order holds events back until the
watermark has passed them where ``ordered`` asks for it (``quern.streaming.stateful``). State needs the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.plans.ingest import ingest
from quern.streaming.stateful import Frames, InOrder, Newest, OnArrival, Shapes


def stream_events(spark: SparkSession, folder: str, schema: StructType, delay: str = "10 minutes", channels: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Events from a folder of Parquet files, with event time and a watermark; only of the channels asked for."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events = reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return events.where(F.col("event_type").isin(channels)) if channels else events


def stream_run_metrics(tokens: DataFrame) -> DataFrame:
    """First and last time and number of tokens of each run as they arrive (update mode). tokens: run_id, ts, created_at."""
    seen = tokens.groupBy("run_id", "created_at").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("output_tokens"))
    ms = lambda a: ((F.unix_micros(a) - F.unix_micros("created_at")) / 1000).cast("double")
    out = seen.select("run_id", ms("first").alias("ttft_ms"), ms("last").alias("total_time_ms"), "output_tokens")
    return out.withColumn("tokens_per_s", F.when(F.col("total_time_ms") > 0, F.col("output_tokens") / (F.col("total_time_ms") / 1000)))


def stream_dedupe(events: DataFrame, key: str = "id") -> DataFrame:
    """First arrival of each id within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def stream_throughput(progress: DataFrame, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Chunks per second in sliding windows: what was processed between a window's first and last sample, over a second
    at least. progress: job, ts, processed."""
    w = progress.groupBy("job", F.window("ts", window, slide)).agg(F.min_by("processed", "ts").alias("a"), F.max_by("processed", "ts").alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("samples"))
    span = F.greatest(F.lit(1.0), (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6)
    return w.select("job", F.col("window.start").alias("window_start"), "samples", (F.greatest(F.lit(0.0), (F.col("b") - F.col("a")).cast("double")) / span).alias("rate"))


#: Seconds of event time that are released at once where order matters.
SLOT_S = 60.0
#: Groups that keys are dealt to by hash where order matters. Part of a stream's state, so the same for a checkpoint's whole
#: life; more of them spread a larger cluster's work and keep what a slot's release writes small.
GROUPS = 256
#: The same where a group's state is read whole by each micro-batch that has events of it.
READ_GROUPS = 4096


def _keyed(events: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows that processors take; those without a time are no events."""
    return events.select(F.col(key).alias("key"), "ts", F.col("id").cast("long").alias("id"), value.cast("string").alias("value")).where("ts is not null").groupBy("key")


def _grouped(events: DataFrame, key: str, value: Column, groups: int) -> DataFrame:
    """The same, many keys to a group of state. A key goes as text, which its type has back after."""
    rows = events.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group"), F.col(key).cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), value.cast("string").alias("value"))
    return rows.where("ts is not null").groupBy("group")


def _in_order(events: DataFrame, key: str, value: Column, worker: InOrder, columns: str, groups: int) -> DataFrame:
    out = _grouped(events, key, value, groups).transformWithStateInPandas(worker, f"key string, {columns}", "append", "EventTime")
    return out.withColumn("key", F.col("key").cast(dict(events.dtypes)[key]))


def _stateful(events: DataFrame, key: str, value: Column, fold: Callable, shapes: Shapes, kept: str, columns: str, ordered: bool, slot_s: float, groups: int, expire_s: float | None = None) -> DataFrame:
    """Ordered: by slots of event time, which need a watermark on ``ts``; state expires by event time. Else on arrival;
    state expires by the clock."""
    if ordered:
        return _in_order(events, key, value, InOrder(fold, shapes, kept, _ms(slot_s), None if expire_s is None else _ms(expire_s)), columns, groups)
    worker, mode = OnArrival(fold, shapes, kept, None if expire_s is None else _ms(expire_s)), "None" if expire_s is None else "ProcessingTime"
    return _keyed(events, key, value).transformWithStateInPandas(worker, f"key {dict(events.dtypes)[key]}, {columns}", "append", mode)


def _ms(seconds: float) -> int:
    return max(1, int(1000 * seconds))


def stream_cooldown(events: DataFrame, seconds: float, by: str = "session", ordered: bool = False, expire: bool | None = None, slot_s: float = SLOT_S, groups: int = GROUPS) -> DataFrame:
    """``key``, ``id``, ``accepted``: greedy limit by last accepted event. A key's state goes after twice the cooldown
    without an event, when any event would be accepted: of event time if ``ordered`` (unless ``expire`` is False); else, with
    ``expire``, by the clock, which keeps a query running, so not under ``availableNow``."""
    limit = int(seconds * 1_000_000)

    def fold(kept, times, ids, _):
        last, accepted = kept[0] if kept else None, []
        for t in times:
            ok = last is None or t - last >= limit
            last = t if ok else last
            accepted.append(ok)
        return (last,), {"id": ids, "accepted": accepted}

    return _stateful(events, by, F.lit(None), fold, {}, "accepted_at long", "id long, accepted boolean", ordered, slot_s, groups, 2 * seconds if (ordered if expire is None else expire) else None)


def stream_context(messages: DataFrame, by: str = "channel", conversation: str = "conversation", ordered: bool = False, slot_s: float = SLOT_S, groups: int = GROUPS) -> DataFrame:
    """``key``, ``id``, ``context``: the conversation id last seen before in the channel."""

    def fold(kept, _, ids, values):
        last, seen = kept[0] if kept else None, []
        for value in values:
            seen.append(last)
            last = value if value is not None else last
        return (last,), {"id": ids, "context": seen}

    return _stateful(messages, by, F.col(conversation), fold, {"context": lambda x: pd.Series(x, dtype=object)}, "conversation string", "id long, context string", ordered, slot_s, groups)


def stream_rate(telemetry: DataFrame, counter: str, by: str = "host", ordered: bool = False, slot_s: float = SLOT_S, groups: int = GROUPS) -> DataFrame:
    """``key``, ``id``, ``rate`` per second of a counter since the host's sample before; null where one of them has none."""

    def fold(kept, times, ids, values):
        before, rates = kept, []
        for t, value in zip(times, values, strict=True):
            v = None if value is None else int(value)
            known = before is not None and before[1] is not None and v is not None
            rates.append(max(0, int((v - before[1]) / max(0.001, (t - before[0]) / 1e6))) if known else None)
            before = (t, v)
        return before, {"id": ids, "rate": rates}

    return _stateful(telemetry, by, F.col(counter).cast("long"), fold, {"rate": lambda x: pd.array(x, dtype="Int64")}, "t long, v long", "id long, rate long", ordered, slot_s, groups)


def stream_last_n(events: DataFrame, n: int, by: str = "session", groups: int = READ_GROUPS) -> DataFrame:
    """``key``, ``ids``: the newest ``n`` event ids of each key, oldest first, whenever they change (update mode); older
    ones are dropped, producers never wait."""
    out = _grouped(events, by, F.lit(None), groups).transformWithStateInPandas(Newest(n), "key string, ids array<long>", "update", "None")
    return out.withColumn("key", F.col("key").cast(dict(events.dtypes)[by]))


def stream_stale(events: DataFrame, seconds: float = 45, by: str = "job", slot_s: float = SLOT_S, groups: int = GROUPS) -> DataFrame:
    """``key``, ``last_seen`` of series without an event for over ``seconds`` of event time, once each silence. events
    need a watermark on ``ts``; they are held back until it has passed them, so late files change nothing. A series that
    is silent is forgotten, so state is bounded by the series that are not."""
    after = int(seconds * 1_000_000)

    def fold(kept, times, _, __):
        every = [*(kept or ()), *times]
        return (times[-1],), {"last_seen": [a for a, b in zip(every, every[1:], strict=False) if b - a > after]}

    shapes = {"last_seen": lambda times: pd.to_datetime(times, unit="us", utc=True)}
    worker = InOrder(fold, shapes, "last long", _ms(slot_s), _ms(seconds), lambda kept: {"last_seen": [kept[0]]})
    # Ids are not needed.
    return _in_order(events.withColumn("id", F.lit(0)), by, F.lit(None), worker, "last_seen timestamp", groups)


def stream_sse(chunks: DataFrame, by: str = "run_id", groups: int = GROUPS) -> DataFrame:
    """``key``, ``pos``, ``json``, ``ok`` (whether it is JSON) of each frame as it is finished, as ``logs.sse_frames`` gives them
    of whole captures. chunks: run_id, seq (their order in a run, which they arrive in), chunk (binary)."""
    group = F.pmod(F.xxhash64(by), F.lit(groups)).cast("int").alias("group")
    rows = chunks.select(group, F.col(by).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    out = rows.groupBy("group").transformWithStateInPandas(Frames(), "key string, pos long, json string, ok boolean", "append", "None")
    return out.withColumn("key", F.col("key").cast(dict(chunks.dtypes)[by]))


def stream_ingest(docs: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, target: int = 500, most: int = 700, overlap: int = 75):
    """Chunks new documents as files arrive and stops when all are done; the same checkpoint resumes, a new one starts
    afresh. Each micro-batch writes its own folder, so one that is repeated overwrites itself and nothing else.

    docs: a streaming DataFrame of doc_id and text. Of rows with one id in a micro-batch, the last by text counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        none = batch.sparkSession.createDataFrame([], "id long, chunk_no long, n_tokens long, text string")
        known = batch.sparkSession.createDataFrame([], "doc_id long, hash string")
        rows = batch.groupBy("doc_id").agg(F.max("text").alias("text"))
        ingest(rows, known, none, "full", None, target, most, overlap).chunks.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(sink or write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What ``stream_ingest`` has written: of a document that came in several batches, the chunks of the last."""
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["id", "batch"]).drop("batch")
