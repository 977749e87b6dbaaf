"""Streams over one file, several files in order, and one file late, against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import messages, telemetry
from quern.streaming import streams

T0 = datetime(2024, 1, 1)
ROWS = [(i, T0 + timedelta(seconds=i * 7 % 300 + i // 43 * 300), f"s{i % 3}", i * 50) for i in range(200)]
SCHEMA = "id long, ts timestamp, session string, rx long"


def files(spark, tmp_path, layout):
    """ROWS as files; a file stream takes them by their names' times, so they are written one after another."""
    import os
    import time

    rows = sorted(ROWS, key=lambda r: (r[1], r[0]))
    parts = [rows] if layout == "one" else [rows[k : k + 40] for k in range(0, 200, 40)]
    if layout == "late":
        parts.append(parts.pop(2))
    for n, part in enumerate(parts):
        path = tmp_path / f"part{n}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{path}")
        os.utime(path, (time.time() + n, time.time() + n))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 10,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/part*")


def sink(out, tmp_path, mode="append"):
    spark, path = out.sparkSession, f"file://{tmp_path}/out"
    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(path)


@pytest.mark.parametrize("layout", ["one", "ordered"])
def test_cooldown(spark, tmp_path, layout):
    out = sink(streams.stream_cooldown(files(spark, tmp_path, layout), 20), tmp_path)
    want = messages.cooldown(spark.createDataFrame(ROWS, SCHEMA), 20)
    assert {(x.key, x.id, x.accepted) for x in out.collect()} == {(x.session, x.id, x.accepted) for x in want.collect()}


def test_cooldown_waits_for_the_watermark_when_ordered(spark, tmp_path):
    stream = files(spark, tmp_path, "late").withWatermark("ts", "1 hour")
    out = sink(streams.stream_cooldown(stream, 20, ordered=True), tmp_path)
    # Nothing is an hour old yet, so nothing may be decided.
    assert out.count() == 0


def watched(out, tmp_path, mode="append"):
    """Runs a stream to its end; its results, and the state operator's progress of each micro-batch that had rows and of the
    last one."""
    path = f"file://{tmp_path}/out"
    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    assert q.awaitTermination(300)
    with_rows = [p.stateOperators[0] for p in q.recentProgress if p.numInputRows]
    return out.sparkSession.read.parquet(path), [*with_rows, q.recentProgress[-1].stateOperators[0]]


def one_after_the_other(spark, tmp_path, parts):
    import os

    for n, part in enumerate(parts):
        path = tmp_path / "in" / f"part{n}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{path}")
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 10,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/part*")


FAR = datetime(2030, 1, 1)
CLOSING = [[(-1, FAR, None, 0)], [(-2, FAR + timedelta(seconds=1), None, 0)]]


@pytest.fixture(scope="module")
def ordered_cooldown(spark, tmp_path_factory):
    """Ten triggers of ten new sessions each, a file late, and a session that comes back."""
    tmp_path = tmp_path_factory.mktemp("cooldown")
    rows = [[(k * 100 + i, T0 + timedelta(seconds=600 * k + 7 * i), f"s{k}-{i % 10}", 0) for i in range(40)] + [(k * 100 + 99, T0 + timedelta(seconds=600 * k + 3), "back", 0)] for k in range(10)]
    layout = [*rows[:3], rows[4], rows[3], *rows[5:]]
    stream = one_after_the_other(spark, tmp_path, [*layout, *CLOSING]).withWatermark("ts", "15 minutes")
    out, progress = watched(streams.stream_cooldown(stream, 60, ordered=True), tmp_path)
    return [r for part in rows for r in part], out.collect(), progress


def test_ordered_cooldown_gives_every_event_as_the_batch_twin(spark, ordered_cooldown):
    rows, out, _ = ordered_cooldown
    want = messages.cooldown(spark.createDataFrame(rows, SCHEMA), 60)
    assert len(out) == len(rows)
    assert {(x.key, x.id, x.accepted) for x in out} == {(x.session, x.id, x.accepted) for x in want.collect()}


def test_cooldown_state_expires(ordered_cooldown):
    _, _, progress = ordered_cooldown
    # Each trigger brings 41 events of 11 keys. What waits is at most three triggers' (the lateness) and their keys; what is kept
    # goes two minutes after a session's last event. Without expiry the last triggers would hold over a hundred keys.
    rows = [p.numRowsTotal for p in progress]
    assert max(rows[5:10]) <= max(rows[:5]) + 40
    assert rows[-1] <= 2


def test_state_written_follows_the_new_events(spark, tmp_path):
    """One key, twenty triggers, nothing released before the end: a trigger writes its own events only."""
    parts = [[(k * 50 + i, T0 + timedelta(seconds=50 * k + i), "only", k * i) for i in range(50)] for k in range(20)]
    stream = one_after_the_other(spark, tmp_path, parts + CLOSING).withWatermark("ts", "1 hour")
    out, progress = watched(streams.stream_rate(stream, "rx", "session", ordered=True), tmp_path)
    assert out.count() == 1000
    written = [p.customMetrics["rocksdbTotalBytesWritten"] for p in progress[:20]]
    assert max(written[15:]) < 2 * max(written[1:5])


def test_newest_writes_what_is_new(spark, tmp_path):
    parts = [[(k * 10 + i, T0 + timedelta(seconds=10 * k + i), "only", 0) for i in range(10)] for k in range(30)]
    out, progress = watched(streams.stream_last_n(one_after_the_other(spark, tmp_path, parts), 200), tmp_path, "update")
    assert out.groupBy("key").agg(F.max_by("ids", "batch").alias("ids")).first().ids == list(range(100, 300))
    # Ten come and ten go, whatever is held.
    assert max(p.customMetrics["rocksdbPutCount"] for p in progress[20:]) <= max(p.customMetrics["rocksdbPutCount"] for p in progress[:5]) + 20
    assert {p.numRowsTotal for p in progress[20:]} == {200}


def test_context_and_silences_over_a_late_file(spark, tmp_path):
    parts = [[(k * 10 + i, T0 + timedelta(seconds=100 * k + 9 * i), f"s{i % 2}", k) for i in range(10)] for k in range(4)]
    late = [parts[0], parts[2], parts[1], parts[3], *CLOSING]
    rows = spark.createDataFrame([r for p in parts for r in p], SCHEMA).select(F.col("session").alias("channel"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("conversation"))
    stream = one_after_the_other(spark, tmp_path / "a", late).withWatermark("ts", "10 minutes").withColumn("conversation", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")))
    out, _ = watched(streams.stream_context(stream, "session", ordered=True), tmp_path / "a")
    assert {(x.key, x.id, x.context) for x in out.collect()} == {(x.channel, x.seq, x.context) for x in messages.with_context(rows).collect()}
    stream = one_after_the_other(spark, tmp_path / "b", late).withWatermark("ts", "10 minutes")
    out, progress = watched(streams.stream_stale(stream, 25, "session", 10), tmp_path / "b")
    times = {s: sorted(r[1] for p in parts for r in p if r[2] == s) for s in ("s0", "s1")}
    want = sorted((s, a) for s, t in times.items() for a, b in zip(t, [*t[1:], FAR]) if (b - a).total_seconds() > 25)
    assert sorted((x.key, x.last_seen) for x in out.collect()) == want and len(want) >= 2
    assert progress[-1].numRowsTotal <= 2


@pytest.mark.parametrize("layout", ["one", "ordered"])
def test_rate(spark, tmp_path, layout):
    out = sink(streams.stream_rate(files(spark, tmp_path, layout), "rx", "session"), tmp_path)
    want = telemetry.counter_rate(spark.createDataFrame(ROWS, SCHEMA), ["rx"], "session")
    assert {(x.id, x.rate) for x in out.collect()} == {(x.id, x.rx_rate) for x in want.collect()}


@pytest.mark.parametrize("layout", ["one", "late"])
def test_last_n_whatever_the_order(spark, tmp_path, layout):
    out = sink(streams.stream_last_n(files(spark, tmp_path, layout), 5), tmp_path, "update")
    last = out.groupBy("key").agg(F.max_by("ids", "batch").alias("ids")).collect()
    want = telemetry.last_n(spark.createDataFrame(ROWS, SCHEMA), "session", 5, ["ts", "id"]).collect()
    assert {(x.key, i) for x in last for i in x.ids} == {(x.session, x.id) for x in want}


def test_dedupe(spark, tmp_path):
    rows = files(spark, tmp_path, "late").withWatermark("ts", "1 hour")
    doubled = rows.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted(x.id for x in sink(streams.stream_dedupe(doubled).select("id"), tmp_path).collect()) == list(range(200))


def test_stale_series_is_told_once(spark, tmp_path):
    rows = [(1, T0, "a", 0), (2, T0 + timedelta(seconds=500), "b", 0), (3, T0 + timedelta(seconds=900), "b", 0)]
    for n, part in enumerate([rows[:1], rows[1:2], rows[2:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/part{n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/part*").withWatermark("ts", "1 second")
    out = sink(streams.stream_stale(stream, 45, "session"), tmp_path)
    assert ("a", T0) in {(x.key, x.last_seen) for x in out.collect()}


def test_ingest_resumes(spark, tmp_path):
    schema = "doc_id long, text string"
    src, dst, ck = f"file://{tmp_path}/src", f"file://{tmp_path}/dst", f"file://{tmp_path}/ck2"
    spark.createDataFrame([(1, "a b"), (2, "c")], schema).coalesce(1).write.parquet(src)
    run = lambda: streams.stream_ingest(spark.readStream.schema(schema).parquet(src), dst, ck).awaitTermination(60)
    run()
    spark.createDataFrame([(2, "d e f")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert {(x.id, x.text) for x in streams.latest_chunks(spark, dst).collect()} == {(1, "a b"), (2, "d e f")}


def test_frames_are_the_same_however_a_capture_is_cut():
    from quern.streaming.stateful import blocks

    raw = ': hi\r\n\r\ndata: {"a":\r\ndata: 1}\r\n\r\ndata: {bad é漢\n\nevent: x\n\ndata:  {"n":NaN}\r\n\ndata: {"b":2}\n\ndata: [DONE]\r\n\r\ndata: {"c":3}\n\n'.encode()
    want = [None, '{"a":\n1}', "{bad é漢", None, '{"n":NaN}', '{"b":2}']
    assert blocks(raw) == (want, b"", True)
    for a in range(len(raw)):
        for b in {a, a + 1, a + 2, a + 5, len(raw)}:
            found, tail, done = [], b"", False
            for piece in (raw[:a], raw[a:b], raw[b:]):
                if not done:
                    more, tail, done = blocks(tail + piece)
                    found += more
            assert (found, done) == (want, True), (a, b)
    assert blocks(b"data: {}\n")[0] == [] and blocks(b"data: 1\n\r") == ([], b"data: 1\n\r", False)


def test_frames_of_a_stream_of_chunks(spark, tmp_path):
    import os

    from quern.sources import logs

    raws = {1: 'data: {"a":1}\r\n\r\ndata: {bad\n\ndata: {"b":NaN}\n\ndata: {"open":1}', 2: ": c\n\ndata: 1\n\ndata: [DONE]\n\ndata: 2\n\n", 3: ""}
    chunks = [(r, k, raw.encode()[k * 4 : k * 4 + 4]) for r, raw in raws.items() for k in range(len(raw) // 4 + 1)]
    for n in range(3):
        path = tmp_path / "in" / f"part{n}"
        spark.createDataFrame([c for c in chunks if min(2, c[1] // 3) == n], "run_id long, seq long, chunk binary").coalesce(1).write.parquet(f"file://{path}")
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 10,) * 2)
    stream = spark.readStream.schema("run_id long, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/part*")
    out = sink(streams.stream_sse(stream), tmp_path)
    good, bad = logs.sse_frames(spark.createDataFrame(list(raws.items()), "run_id long, raw string"))
    want = {(x.run_id, x.pos, x.json, ok) for df, ok in ((good, True), (bad, False)) for x in df.collect()}
    assert {(x.key, x.pos, x.json, x.ok) for x in out.collect()} == want and len(want) == 4
