"""Bus messages and chat transcripts: routing, checks, limits on rate and number, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quern.sources.staging import staged

#: The five channels, and the roles of a chat message.
CHANNELS = ["events", "lounge", "logs", "telemetry", "tokens"]
ROLES = ["system", "user", "assistant", "tool"]
#: Channels whose messages belong to one session.
OF_SESSION = ["tokens", "events"]


def route(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages for each subscriber. messages: id, channel, session; subscriptions: subscriber, channel, own_session.

    On session channels a message is dropped only if both sessions are known (not null, not '') and differ.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    foreign = F.col("channel").isin(OF_SESSION) & known("session") & known("own_session") & (F.col("session") != F.col("own_session"))
    return messages.join(subscriptions, "channel").where(~foreign)


def channel_errors(subscriptions: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """Adds ``channels`` (the named ones, trimmed, or all if none is named) and ``unknown`` (sorted names, null if none)."""
    named = F.filter(F.transform(F.split(F.coalesce("wanted", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    every = F.array(*[F.lit(c) for c in channels])
    out = subscriptions.withColumn("_n", named)
    bad = F.array_sort(F.array_except("_n", every))
    return out.withColumns({"channels": F.when(F.size("_n") == 0, every).otherwise(F.array_distinct("_n")), "unknown": F.when(F.size(bad) > 0, F.array_join(bad, ", "))}).drop("_n")


def multiplex(**streams: DataFrame) -> DataFrame:
    """Typed streams in one envelope: ``channel``, ``timestamp``, ``payload`` (JSON). Each has a column ``ts``."""
    out = None
    for channel, df in sorted(streams.items()):
        rest = [c for c in df.columns if c != "ts"]
        one = df.select(F.lit(channel).alias("channel"), F.col("ts").alias("timestamp"), F.to_json(F.struct(*rest)).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def active_run_only(tokens: DataFrame, run: str) -> DataFrame:
    """Tokens without those of another run where both ids are known. tokens: run_id, active (the run that is shown)."""
    return tokens.where(F.col("run_id").isNull() | F.col(run).isNull() | (F.col("run_id") == F.col(run)))


def inject_system(turns: DataFrame, prompt: str) -> DataFrame:
    """Turns with a system turn -1 before each conversation that has none; unchanged for an empty prompt.

    turns: conv_id, turn, role, text.
    """
    if not prompt:
        return turns
    bare = turns.groupBy("conv_id").agg(F.max((F.col("role") == "system").cast("int")).alias("has")).where("has = 0")
    return turns.unionByName(bare.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("text")))


def inject_system_array(messages: Column, prompt: str) -> Column:
    """The same on an array of role and content."""
    if not prompt:
        return messages
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages).otherwise(F.concat(first, messages))


def drop_nulls(parameters: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(parameters, lambda _, v: v.isNotNull())


def validated(turns: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Accepted turns, and refused ones with a ``reason``: unknown role, empty text, text longer than ``most``."""
    text = F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), "role").when(text == "", "empty").when(F.length(text) > most, "too long")
    marked = turns.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def with_context(messages: DataFrame, width: int = 10_000) -> DataFrame:
    """Adds ``context``: the last conversation id seen before in the message's channel. messages: channel, seq, conversation.

    A channel is cut into stretches of ``width`` of ``seq`` (a number). The last id of each stretch is carried over to the
    next ones, and a window looks back inside its stretch only: few channels do not mean few tasks.
    """
    cut = messages.withColumn("_b", F.floor(F.col("seq") / width))
    stretches = cut.groupBy("channel", "_b").agg(F.max_by("conversation", F.when(F.col("conversation").isNotNull(), F.col("seq"))).alias("_last"))
    earlier = Window.partitionBy("channel").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select("channel", "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    before = Window.partitionBy("channel", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumnsRenamed({"channel": "_channel", "_b": "_stretch"})
    # A null channel is a channel of its own.
    out = cut.join(carried, F.col("channel").eqNullSafe(F.col("_channel")) & F.col("_b").eqNullSafe(F.col("_stretch")), "left")
    return out.withColumn("context", F.coalesce(F.last("conversation", ignorenulls=True).over(before), "_carried")).drop("_b", "_channel", "_stretch", "_carried")


#: Events of a session beyond which it is cut into stretches, and how many cooldowns long a stretch is.
HOT_EVENTS, STRETCH = 1_000_000, 64


def cooldown(events: DataFrame, seconds: float, by: str = "session", hot: int = HOT_EVENTS, stretch: int = STRETCH) -> DataFrame:
    """Adds ``accepted`` and ``wait_s`` (whole seconds left, rounded up; null if accepted). events: session, ts, id.

    An event is accepted if ``seconds`` have passed since the last accepted one of its session: a fold over time. Events
    are dealt by session and sorted by time once; each task folds its stream of rows with nothing held but the last
    accepted time. Sessions of more than ``hot`` events are dealt by stretches of time instead (:func:`_stretched`), so one
    of them has many tasks. Events without a time are accepted and change nothing.
    """
    limit = int(seconds * 1_000_000)
    cut = events.groupBy(F.col(by).alias("_of")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("_of")
    if not limit or cut.isEmpty():
        return _folded(events, limit, [by])
    same = F.col(by).eqNullSafe(F.col("_of"))
    cut = staged(cut, "hot")
    return _folded(events.join(cut, same, "left_anti"), limit, [by]).unionByName(_stretched(events.join(cut, same, "left_semi"), limit, by, stretch))


def _folded(events: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """The fold over rows by key and time. Rows with ``_kind`` 0 are no events: they give the time that was accepted last
    before (``_last``), and go."""
    given = "_last" in events.columns
    names = [c for c in events.columns if c not in ("_b", "_kind", "_last")]
    schema = StructType([*(events.schema[c] for c in names), StructField("accepted", BooleanType()), StructField("wait_s", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, begun = None, None, False
        for batch in batches:
            times = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            before = batch.column("_last").to_pylist() if given else [None] * len(times)
            events = [k != 0 for k in batch.column("_kind").to_pylist()] if given else None
            accepted, wait = [], []
            for *key, t, carried in zip(*[batch.column(k).to_pylist() for k in keys], times, before, strict=True):
                if not begun or key != now:
                    now, begun, last = key, True, carried
                left = None if last is None or t is None else last + limit - t
                ok = left is None or left <= 0
                accepted.append(ok)
                wait.append(None if ok else -(-left // 1_000_000))
                last = t if ok and t is not None else last
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(accepted, pa.bool_()), pa.array(wait, pa.int64())], [*names, "accepted", "wait_s"])
            yield out.filter(pa.array(events)) if given else out

    return events.repartition(*keys).sortWithinPartitions(*keys, *(["_kind"] if given else []), "ts", "id").mapInArrow(run, schema)


def exits(times: np.ndarray, limit: int) -> np.ndarray:
    """For each of sorted times, the last one that is accepted if it is: successors are followed by doubling pointers."""
    after = np.append(np.searchsorted(times, times + limit), times.size)
    last = np.arange(times.size + 1)
    while (after[:-1] < times.size).any():
        more = after < times.size
        last[more], after = last[after[more]], after[after]
    return times[last[:-1]]


def _stretched(events: DataFrame, limit: int, by: str, stretch: int) -> DataFrame:
    """The fold with time cut into stretches of ``stretch`` cooldowns. (1) A task follows, in its stretch, from each event
    that may be the first accepted one (those of the first cooldown and the one after) to the last accepted; events
    that come to the same one are told by the latest of them. (2) These few rows of a session are gone through in order:
    what each stretch begins with. (3) Stretches are folded on their own from there.
    """
    width = limit * stretch
    rows = events.withColumn("_b", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / width))
    kind = dict(events.dtypes)[by]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            times = np.unique(np.concatenate(held))
            border = key[1] * width + limit
            last = exits(times, limit)
            entry = times[: int(np.searchsorted(times, border)) + 1]
            last = last[: entry.size]
            keep = np.append(last[1:] != last[:-1], True)
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, batch.schema.field("_by").type), pa.array([key[1]] * n, pa.int64()), pa.array(entry[keep]), pa.array(last[keep])], ["_by", "_b", "entry", "exit"])

        for batch in batches:
            times = batch.column("t").to_numpy()
            keys = list(zip(batch.column("_by").to_pylist(), batch.column("_b").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if held and keys[at] != key:
                    yield from told()
                    held = []
                key = keys[at]
                held.append(times[at:to])
                at = to
        if held:
            yield from told()

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, stretch, last, found = None, None, None, True
        for batch in batches:
            out = []
            for own, b, entry, end in zip(*[batch.column(c).to_pylist() for c in ("_by", "_b", "entry", "exit")], strict=True):
                if stretch is None or own != session or b != stretch:
                    last = last if stretch is not None and own == session else None
                    session, stretch, found = own, b, False
                    out.append((own, b, last))
                if not found and (last is None or entry >= last + limit):
                    last, found = end, True
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("_by").type, pa.int64(), pa.int64()), strict=True)], ["_by", "_b", "_last"])

    timed = rows.where("ts is not null").select(F.col(by).alias("_by"), "_b", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    found = timed.repartition("_by", "_b").sortWithinPartitions("_by", "_b", "t").mapInArrow(ends, f"_by {kind}, _b long, entry long, exit long")
    begin = found.repartition("_by").sortWithinPartitions("_by", "_b", "entry").mapInArrow(carried, f"_by {kind}, _b long, _last long")
    marks = begin.select(*[(F.col("_by") if f.name == by else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema], "_b", F.lit(0).alias("_kind"), "_last")
    return _folded(rows.withColumns({"_kind": F.lit(1), "_last": F.lit(None).cast("long")}).unionByName(marks), limit, [by, "_b"])


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def recent_distinct(df: DataFrame, key: str, order: str, n: int = 30) -> DataFrame:
    """The ``n`` most recently used values, newest first."""
    return df.groupBy(key).agg(F.max(order).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(n)


def context_fill(turns: DataFrame, context: int, prompt: str = "", known: DataFrame | None = None) -> DataFrame:
    """Estimated tokens of each conversation and how full a context of ``context`` tokens is.

    The text is the system prompt's line and ``role: content`` lines; a token is four UTF-16 units, rounded half up,
    one at least. known: conv_id, input_tokens (the last counted ones, which win if larger).
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    out = turns.groupBy("conv_id").agg(lines.alias("body"))
    body = F.concat(F.lit(f"system: {prompt}\n"), F.col("body")) if prompt else F.col("body")
    units = F.length(F.encode(body, "UTF-16BE")) / 2
    out = out.select("conv_id", F.greatest(F.lit(1), F.floor(units / 4 + 0.5)).cast("long").alias("estimated"))
    used = F.col("estimated")
    if known is not None:
        out = out.join(known.select("conv_id", "input_tokens"), "conv_id", "left")
        used = F.greatest(F.coalesce("input_tokens", F.lit(0)), "estimated")
    share = F.col("used") / context * 100
    band = F.when(F.col("percent") < 70, "ok").when(F.col("percent") < 90, "high").otherwise("full")
    return out.withColumn("used", used).withColumn("percent", F.round(share, 6)).withColumn("band", band).select("conv_id", "estimated", "used", "percent", "band")


def lounge_normalized(messages: DataFrame) -> DataFrame:
    """Alias trimmed, or ``user-`` and six characters of the session; text trimmed; blank texts refused."""
    alias = F.coalesce(F.nullif(F.trim("alias"), F.lit("")), F.concat(F.lit("user-"), F.left(F.col("session"), F.lit(6))))
    return messages.withColumn("alias", alias).withColumn("text", F.trim("text")).where("text <> ''")
