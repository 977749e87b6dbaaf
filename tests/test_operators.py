"""Edge cases that the given tables do not have, and properties of plans."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import names, payloads, text, urls
from quern.operators import documents, inverted, messages, pivots, retrieval, runs, telemetry
from quern.plans import ingest, search
from quern.session import bounded
from quern.sources import logs
from quern.sources.tables import RUN

T0 = datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def run_rows(spark, rows):
    return spark.createDataFrame([[r.get(c) for c in RUN.names] for r in rows], RUN)


def test_finalize_overwrites_with_nulls_and_takes_the_latest(spark):
    r = run_rows(spark, [{"run_id": 1, "created_at": T0, "updated_at": T0, "status": "running", "ttft_ms": 5.0}, {"run_id": 2, "created_at": T0, "updated_at": T0, "status": "running", "ttft_ms": 6.0}])
    schema = "run_id long, finished_at timestamp, status string, ttft_ms double, total_time_ms double, input_tokens long, output_tokens long, tokens_per_s double, resources_json string, error string"
    finals = spark.createDataFrame([(1, T0 + timedelta(1), "failed", 1.0, 1.0, 1, 1, 1.0, "{}", "x"), (1, T0 + timedelta(2), "completed", None, 9.0, None, 3, None, None, None), (7, T0, "failed", None, None, None, None, None, None, None)], schema)
    out = {x.run_id: x for x in runs.apply_finalize(r, finals).collect()}
    assert out[1].status == "completed" and out[1].ttft_ms is None and out[1].total_time_ms == 9.0 and out[1].updated_at == T0 + timedelta(2)
    assert out[2].status == "running" and out[2].ttft_ms == 6.0
    assert len(out) == 2 and runs.final_events(finals).count() == 3


def test_run_metrics_without_tokens_or_time(spark):
    r = run_rows(spark, [{"run_id": i, "created_at": T0} for i in (1, 2, 3)])
    tokens = spark.createDataFrame([(1, T0 + timedelta(seconds=1)), (1, T0 + timedelta(seconds=3)), (2, T0)], "run_id long, ts timestamp")
    usage = spark.createDataFrame([(1, 10), (2, 0)], "run_id long, output_tokens long")
    out = {x.run_id: x for x in runs.run_metrics(r, tokens, usage).collect()}
    assert (out[1].ttft_ms, out[1].total_time_ms, out[1].output_tokens) == (1000.0, 3000.0, 10)
    assert out[1].tokens_per_s == pytest.approx(10 / 3)
    assert out[2].tokens_per_s is None and out[3].ttft_ms is None and out[3].output_tokens == 0


def test_compare_needs_two(spark):
    r = run_rows(spark, [{"run_id": 1, "request_messages_json": '[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]'}, {"run_id": 2}])
    one = spark.createDataFrame([(1,)], "run_id long")
    both = spark.createDataFrame([(1,), (2,), (2,)], "run_id long")
    assert runs.compare_runs(r, one).count() == 0
    assert {x.run_id: x.prompt for x in runs.compare_runs(r, both).collect()}[1] == "user: a\nassistant: b"


def test_log_lines_keep_json_that_is_no_object(spark):
    lines = spark.createDataFrame([("",), ("   ",), ("{bad",), ("3",), ("[1,2]",), ('{"type":"t","payload":{"a":1}}  ',)], "value string")
    assert sorted(x.value for x in logs.parse_log(lines).collect()) == ["3", "[1,2]", '{"type":"t","payload":{"a":1}}']


def test_event_log_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    spark.createDataFrame([('{"timestamp":"2024-01-01T00:00:00Z","type":"token","payload":{"t":"é"}}',), ("",)], "value string").coalesce(1).write.text(path)
    row = logs.event_log(spark, path).collect()[0]
    assert row.type == "token" and row.payload == '{"t":"é"}' and row.timestamp == T0


def test_log_lines_are_read_as_they_were_written(spark):
    lines = ['\u00a0{"type":"a","type":"b"}\u3000', '{"type":"t","payload":{"v":NaN,"w":[1,-Infinity]},"timestamp":"2024-01-01T00:00:00Z"}', '{"type":"t",}', "NaN", '{"run_id":"r/1","run_id":"r/2","payload":"x"}', "{'type':'t'}", '{"a":1} {}', "3,4", '3,"y":4', "3],[4", "3}"]
    out = {x.value: (x.run, x.type, x.payload, x.timestamp) for x in logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert out == {lines[0].strip(): (None, "b", None, None), lines[1]: (None, "t", '{"v":NaN,"w":[1,-Infinity]}', T0), "NaN": (None, None, None, None), lines[4]: ("r/2", None, "x", None)}


def test_appended_events_keep_their_run(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [("r1", T0, "token", '{"t": "é漢🙂",\n "n": [1]}'), ("r\u00e92", T0, "end", None), (None, None, "x", "no json é"), ("r1", T0, None, "NaN")]
    events = spark.createDataFrame(rows, "run_id string, timestamp timestamp, type string, payload string")
    logs.append_events(events.where("run_id = 'r1'"), path)
    logs.append_events(events.where("run_id is null or run_id <> 'r1'"), path)
    raw = [x.value for x in spark.read.option("recursiveFileLookup", "true").text(path).collect()]
    assert all(x.isascii() for x in raw) and any("\\u00e9\\u6f22\\ud83d\\ude42" in x for x in raw)
    back = logs.event_log(spark, path).collect()
    told = {(x.run_id, x.timestamp, x.type, x.payload and json.dumps(json.loads(x.payload), ensure_ascii=False)) for x in back if x.type != "x"}
    assert told == {("r1", T0, "token", '{"t": "é漢🙂", "n": [1]}'), ("ré2", T0, "end", None), ("r1", T0, None, "NaN")}
    assert [x.payload for x in back if x.type == "x"] == ["no json é"]


@pytest.mark.parametrize("stretch_s", [1, 40, 10**9])
def test_neighbours_over_stretches(spark, stretch_s):
    """Rates, gaps and as-of values are the same however a series is cut; null series and times take part."""
    rows = [(f"h{k % 2}" if k % 11 else None, T0 + timedelta(seconds=(k * k) % 997 - (400 if k % 5 else 0)) if k % 50 else None, k, k * 13 % 700) for k in range(300)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, id long, rx long")
    first = lambda r: (r[1] is not None, r[1] or T0, r[2])
    want_rate, want_gap, asof = {}, {}, {}
    for host in ("h0", "h1", None):
        own = sorted((r for r in rows if r[0] == host), key=first)
        for a, b in zip([None, *own], [*own, None]):
            if b:
                seconds = None if a is None or a[1] is None or b[1] is None else max(0.001, (b[1] - a[1]).total_seconds())
                want_rate[b[2]] = None if a is None else max(0, int((b[3] - a[3]) / (seconds or 0.001)))
            if a:
                want_gap[a[2]] = (b[1] - a[1]).total_seconds() if b and a[1] and b[1] else None
        for k in range(0, 300, 7):
            t = T0 + timedelta(seconds=k * 2 - 100)
            asof[(host, k)] = next((r[3] for r in reversed(own) if r[1] is not None and r[1] <= t), None)
    assert {r.id: r.rx_rate for r in telemetry.counter_rate(df, ["rx"], stretch_s=stretch_s).collect()} == want_rate
    assert {r.id: r.gap_s for r in telemetry.stale(df, 10, "host", stretch_s).collect()} == want_gap
    asked = spark.createDataFrame([(h, k, T0 + timedelta(seconds=k * 2 - 100)) for h, k in asof], "host string, run_id long, started_at timestamp")
    out = telemetry.snapshot_asof(asked, df.where("ts is not null"), "rx", stretch_s=stretch_s)
    assert {(r.host, r.run_id): r.rx for r in out.collect()} == asof


def test_ranks_are_global(spark):
    rows = [(k, float(k * 7919 % 101) if k % 9 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "run_id long, tokens_per_s double")
    out = {x.run_id: x.place for x in runs.ranked(df, [F.coalesce("tokens_per_s", F.lit(0.0)).desc(), F.col("run_id").asc()], "place").collect()}
    assert [i for i, _ in sorted(out.items(), key=lambda x: x[1])] == [i for i, _ in sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))]
    assert sorted(out.values()) == list(range(1, 3001))
    assert runs.ranked(df.limit(0), [F.col("run_id").asc()]).count() == 0


def test_long_runs_make_few_rows(spark):
    day = timedelta(days=1)
    spans = [(f"h{k % 3}", k, T0 + timedelta(hours=k), T0 + timedelta(hours=k) + (365 * day if k % 2 else timedelta(seconds=k % 90))) for k in range(1000)]
    samples = [(f"h{k % 3}", T0 + timedelta(hours=40 * k, seconds=k), k) for k in range(400)]
    r = spark.createDataFrame(spans, "host string, run_id long, started_at timestamp, ended_at timestamp")
    s = spark.createDataFrame(samples, "host string, ts timestamp, id long")
    out = telemetry.samples_in_runs(r, s)
    want = {(i, j) for h, i, a, b in spans for g, t, j in samples if g == h and a <= t <= b}
    assert {(x.run_id, x.id) for x in out.collect()} == want and len(want) > 30_000
    # A stretch is at least a quarter as long as the run.
    width = 60 * 2 ** max(0, math.ceil(math.log2(365 * 86400 / 240)))
    assert all((b - a).total_seconds() / width <= 4 for _, _, a, b in spans)
    assert telemetry.samples_in_runs(r.limit(0), s).count() == 0


def test_sse_frames(spark):
    raw = ': note\r\n\r\ndata: {"a":\r\ndata: 1}\r\n\r\ndata: {bad\n\nevent: x\n\ndata: [DONE]\n\ndata: {"a":2}\n\ndata: {"a":3}'
    good, bad = logs.sse_frames(spark.createDataFrame([(1, raw), (2, 'data: {"b":1}')], "run_id long, raw string"))
    assert [(x.run_id, x.json) for x in good.collect()] == [(1, '{"a":\n1}')]
    assert [x.json for x in bad.collect()] == ["{bad"]


def test_usage_present_null_resets_and_absent_keeps(spark):
    rows = [(1, 0, '{"usage":{"prompt_tokens":5,"completion_tokens":6}}'), (1, 1, '{"usage":{"prompt_tokens":null}}'), (1, 2, "{}"), (2, 0, "{}")]
    out = {x.run_id: x for x in payloads.last_usage(spark.createDataFrame(rows, "run_id long, pos long, json string")).collect()}
    assert out[1].prompt_tokens is None and out[1].completion_tokens == 6 and out[2].prompt_tokens is None


def test_delta_token_falls_through_on_null_only(spark):
    rows = ['{"choices":[{"delta":{"content":""},"text":"x"}]}', '{"choices":[{"delta":{"content":null},"text":"x"}]}', '{"choices":[],"content":"x"}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    assert [x.t for x in df.select(payloads.delta_token(F.col("j")).alias("t")).collect()] == ["", "x", None, None]


def test_counter_rate_first_sample_reset_and_equal_times(spark):
    rows = [("h", 1, T0, 100), ("h", 2, T0 + timedelta(seconds=2), 500), ("h", 3, T0 + timedelta(seconds=3), 10), ("h", 4, T0 + timedelta(seconds=3), 11)]
    df = telemetry.counter_rate(spark.createDataFrame(rows, "host string, id long, ts timestamp, rx long"), ["rx"])
    assert [x.rx_rate for x in df.orderBy("id").collect()] == [None, 200, 0, 1000]


def test_resource_summary_counts_no_sample_twice(spark):
    s = spark.createDataFrame([(1, 10.0, 5.0, 7), (1, None, 9.0, 3)], "run_id long, cpu double, memory double, rss long")
    g = spark.createDataFrame([(1, 3, 50.0), (1, 9, None), (1, 4, 70.0)], "run_id long, memory_used long, util double")
    x = telemetry.resource_summary(s, g).collect()[0]
    assert (x.samples, x.cpu_avg, x.gpu_memory_max, x.gpu_util_max) == (2, 10.0, 9, 70.0)


def test_headroom_without_devices(spark):
    df = spark.createDataFrame([([(10, 12), (10, 3)], 9, 0), (None, 9, 2)], "gpu array<struct<total:long,used:long>>, available long, clients long")
    assert [(x.gpu_free, x.gpu_free_per_client, x.ram_per_client) for x in telemetry.headroom(df).collect()] == [(7, 7, 9), (None, None, 4)]


def test_interval_join_has_no_nested_loop(spark):
    r = spark.createDataFrame([("h", 1, T0, T0 + timedelta(hours=3))], "host string, run_id long, started_at timestamp, ended_at timestamp")
    t = spark.createDataFrame([("h", T0 + timedelta(minutes=m)) for m in (0, 61, 180, 181)] + [("g", T0)], "host string, ts timestamp")
    out = telemetry.samples_in_runs(r, t)
    assert out.count() == 3
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_top_k_limits_groups_early(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("query_id"), "id", (F.col("id") * 7 % 101).cast("double").alias("score"))
    out = retrieval.top_k(df, 3)
    assert out.count() == 15 and "WindowGroupLimit" in plan(out)


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_is_greedy(spark, seed):
    import random

    rnd = random.Random(seed)
    rows, want = [], {}
    for key in ("a", "b"):
        t, last = 0, None
        for i in range(60):
            t += rnd.choice([0, 1, 3, 8, 30])
            rows.append((key, T0 + timedelta(seconds=t), i))
            ok = last is None or t - last >= 10
            want[key, i] = (ok, None if ok else 10 - (t - last))
            last = t if ok else last
    out = messages.cooldown(spark.createDataFrame(rows, "session string, ts timestamp, id long"), 10)
    assert {(x.session, x.id): (x.accepted, x.wait_s) for x in out.collect()} == want


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_a_hot_session_is_cut_into_stretches(spark, stretch):
    import random

    rnd = random.Random(stretch)
    rows = [("hot", T0 + timedelta(seconds=rnd.choice([rnd.randrange(4000), rnd.randrange(60), 3000 + rnd.randrange(5)])), k) for k in range(3000)]
    rows += [(None, T0 + timedelta(seconds=rnd.randrange(9000)), k) for k in range(3000, 4500)] + [(f"s{k % 7}", T0 + timedelta(seconds=k), k) for k in range(4500, 4600)]
    rows += [("hot", None, 9000), (None, None, 9001), ("hot", datetime(1969, 12, 31, 23, 59, 58), 9002)]
    df = spark.createDataFrame(rows, "session string, ts timestamp, id long")
    shown = lambda x: {(r.session, r.id): (r.accepted, r.wait_s) for r in x.collect()}
    want = shown(messages.cooldown(df, 10))
    cut = messages.cooldown(df, 10, hot=500, stretch=stretch)
    assert shown(cut) == want and len(want) == len(rows) and cut.columns == [*df.columns, "accepted", "wait_s"]
    assert 5 < sum(ok for ok, _ in want.values()) < 2000


def test_stretches_of_a_session_are_tasks_of_their_own(spark):
    df = spark.range(200_000).select(F.lit("one").alias("session"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    out = messages.cooldown(df, 10, hot=1000).withColumn("task", F.spark_partition_id())
    spread = out.groupBy("task").agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok")).collect()
    assert len(spread) > 1 and sum(r.n for r in spread) == 200_000 and sum(r.ok for r in spread) == 20_000


def test_block_maxima_give_the_same_best(spark):
    import random

    rnd = random.Random(9)
    pairs = lambda n, reach: [(i, float(rnd.choice([1, 1, 2, rnd.randrange(1, reach)]))) for i in sorted(rnd.sample(range(300), n))]
    kind = "array<struct<idx:bigint,w:double>>"
    rows = spark.createDataFrame([(k, pairs(rnd.randrange(0, 40), 2 + 600 // (k + 1))) for k in range(2000)] + [(None, pairs(5, 9)), (5000, None), (5001, [])], f"id long, pairs {kind}").repartition(3)
    q = spark.createDataFrame([(k, pairs(rnd.randrange(1, 12), 4)) for k in range(40)] + [(99, []), (98, [(900, 1.0)])], f"query_id long, pairs {kind}")
    for k in (1, 7, 3000):
        best, share = inverted.inverted_search(q, inverted.inverted_blocks(rows, 32), k)
        want = retrieval.top_k(retrieval.sparse_scores(q, rows, k), k)
        assert sorted(map(tuple, best.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))
        share = share.first()
        assert (share.skipped > share.blocks / 4) if k < 10 else (share.skipped == 0)
    assert inverted.inverted_search(q, inverted.inverted_blocks(rows.limit(0)), 3)[0].count() == 0
    assert inverted.inverted_search(q.limit(0), inverted.inverted_blocks(rows, 32), 3)[0].count() == 0


def test_pivots_give_the_same_nearest(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 16))
    points = centres[rnd.integers(0, 20, 3000)] + rnd.normal(size=(3000, 16)) * 0.05
    rows = [(k, p.tolist()) for k, p in enumerate(points)] + [(3000 + k, points[k].tolist()) for k in range(5)] + [(None, points[0].tolist()), (4000, None), (4001, [1.0]), (4002, [0.0] * 16), (4003, (-points[0]).tolist())]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, points[k * 7].tolist()) for k in range(60)] + [(90, rnd.normal(size=16).tolist()), (91, [0.0] * 16), (92, [1.0, 2.0])], "query_id long, embedding array<double>")
    index, chosen = pivots.vector_blocks(v, 64)
    for k in (1, 5, 4000):
        best, share = pivots.pivot_search(q, index, chosen, k)
        want = retrieval.top_k(retrieval.dense_scores(q, v, k), k)
        shown = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
        assert shown(best) == shown(want)
        share = share.first()
        assert share.skipped > share.blocks / 2 if k < 6 else share.skipped == 0
    none, few = pivots.vector_blocks(v.limit(0))
    assert pivots.pivot_search(q, none, few, 3)[0].count() == 0
    assert pivots.pivot_search(q.limit(0), index, chosen, 3)[0].count() == 0


def test_tokens_are_lower_cased_by_character(spark):
    texts = ["ΟΔΟΣ", "ΟΔΟΣ İstanbul", "İSTANBUL-Iı", "e\u0301tude", "i\u0307x", "ǅ ẞ ½Ⅷ x_y", "Σ " * 5000, "", "?!", "straße ÀÉ 漢字 ١٢"]

    def by_rule(t):
        return "".join(c.lower() if c.isalnum() else " " for c in t).split()[:4096]

    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "t string, k int")
    out = {x.k: x.u for x in df.select("k", text.tokenize(F.col("t")).alias("u")).collect()}
    # İ is cut off from the rest by nothing: what it turns into stays in its token.
    assert [out[k] for k in range(len(texts))] == [by_rule(t) for t in texts]


def test_tokens_hash_and_lengths(spark):
    df = spark.createDataFrame([("", 0), ("?!", 0), ("Ab-c9 é", 3), ("a " * 5000, 4096)], "t string, n int")
    assert all(x.n == x.m for x in df.select("n", F.size(text.tokenize(F.col("t"))).alias("m")).collect())

    def fnv(token):
        h = 2166136261
        for c in token:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h % 250000

    tokens = ["", "a", "wörld", "日本", "😀x"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(text.fnv_bucket(F.col("t")).alias("h")).collect()
    assert [x.h for x in got][1:] == [fnv(t) for t in tokens][1:]


def test_chunks_cover_every_token(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in (0, 1, 7, 50, 51, 92, 93, 112, 113, 400)] + [(-1, None)], "doc_id long, text string")
    out = text.chunks(docs, 50, 70, 8).collect()
    for n in (0, 1, 7, 50, 51, 92, 93, 112, 113, 400):
        own = sorted((x.chunk_no, x.n_tokens, x.text) for x in out if x.id == n)
        assert [c for c, _, _ in own] == list(range(len(own))) and len(own) >= 1
        assert all(size <= 70 for _, size, _ in own)
        assert {w for _, _, t in own for w in t.split()} == {f"w{k}" for k in range(n)}
    with pytest.raises(ValueError):
        text.chunks(docs, 50, 40, 8)


def test_ingest_twice_changes_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, hash string")
    none = text.chunks(docs.limit(0))
    first = ingest.ingest(docs, known, none)
    again = ingest.ingest(docs, first.manifest, first.chunks)
    assert first.changes.count() == 3 and again.changes.count() == 0
    assert sorted(first.chunks.collect()) == sorted(again.chunks.collect())
    changed = ingest.ingest(docs.withColumn("text", F.when(F.col("doc_id") == 2, "z").otherwise(F.col("text"))), first.manifest, first.chunks)
    assert [(x.doc_id, x.change) for x in changed.changes.collect()] == [(2, "changed")]
    assert {x.id: x.text for x in changed.chunks.collect()} == {1: "a b", 2: "z", 3: ""}


def test_urls(spark):
    cases = {"/thread_12": "thread_12.json", "forum/3/4": "thread_3.json", "/FORUM/thread/7": "thread_7.json", "forum/8/": "forum/8/", "Thread_2": "Thread_2.json", "x/thread/9": "thread_9.json", "forum/8": "thread_8.json", "a%2Bb+c": "a+b+c", "a%3Fb": "a", "#": "", "": "", None: "", "https://h/p/q?x#y": "p/q"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    assert [x.got for x in df.select(urls.document_path(F.col("u")).alias("got")).collect()] == list(cases.values())
    local = {"http://[::1]:80/x?y#z": "https://d.org:80/x?y#z", "https://localhost/p": "https://d.org/p", "http://localhost.evil/p": "http://localhost.evil/p", "ftp://localhost/": "ftp://localhost/"}
    df = spark.createDataFrame([(k,) for k in local], "u string")
    assert [x.got for x in df.select(urls.rewrite_localhost(F.col("u"), "https", "d.org").alias("got")).collect()] == list(local.values())


def test_names(spark):
    cases = {"m-7B": 8192, "m-0.5b": 8192, "m-35B": 4096, "m": None, "m-9.5B": 4096}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [x.c for x in df.select(names.guess_context(F.col("n")).alias("c")).collect()] == list(cases.values())


def test_hybrid_lists_lie_in_their_legs(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)], f"w{i % 4} common") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, text string")
    p = text.sparse_rows(df, "id")
    q = search.Queries(df.where("id < 3").select(F.col("id").alias("query_id"), "embedding"), p.where("id < 3").withColumnRenamed("id", "query_id"))
    c = search.Corpus(df.select("id", "embedding"), p)
    s = search.Settings(dense_leg=5, sparse_leg=5, fused=4)
    legs = {(x.query_id, x.id) for leg in (search.dense_search(q, c, 5), search.sparse_search(q, c, 5)) for x in leg.collect()}
    assert {(x.query_id, x.id) for x in search.hybrid_search(q, c, s).collect()} <= legs
    assert search.rerank(search.hybrid_search(q, c, s), q.vectors, c.vectors, 2).count() == 6


def test_model_embedder_falls_back(spark):
    def broken():
        def call(rows):
            raise RuntimeError("no device")

        return call

    e = search.ModelEmbedder(2, broken, lambda: lambda rows: [[float(len(r)), 1.0] for r in rows])
    out = e(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")).collect()
    assert {x.id: list(x.embedding) for x in out} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_documents_by_path_and_deletion(spark):
    docs = spark.createDataFrame([(1, "a//b/1.md", "x"), (2, "a/2.md", None)], "doc_id long, path string, text string")
    chunks = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, chunk_no long")
    assert documents.document_content(docs, "/a/b//1.md").collect()[0].doc_id == 1
    a, b = documents.delete_documents(docs, chunks, docs.where("doc_id = 1"))
    assert [x.doc_id for x in a.collect()] == [2] and [x.doc_id for x in b.collect()] == [2]
    assert [x["size"] for x in documents.list_documents(docs, chunks).orderBy("path").collect()] == [1, 0]


def test_units(spark):
    df = spark.createDataFrame([(0.0, "N/A", "0 B/s", "N/A", "Estimating..."), (None, "N/A", "0 B/s", "N/A", "Estimating..."), (5.9, "6 B", "0.0 KB/s", "0m", "5s"), (59.9, "60 B", "0.1 KB/s", "0m", "59s"), (61.5, "62 B", "0.1 KB/s", "1m", "1m 1s"), (90061.0, "88.0 KB", "88.0 KB/s", "1d 1h", "1501m 1s"), (1572864.0, "1.5 MB", "1.50 MB/s", "18d 4h", "26214m 24s")], "n double, b string, r string, u string, e string")
    for x in df.select("*", names.format_bytes(F.col("n")).alias("b_"), names.format_rate(F.col("n")).alias("r_"), names.format_uptime(F.col("n")).alias("u_"), names.format_eta(F.col("n")).alias("e_")).collect():
        assert (x.b, x.r, x.u, x.e) == (x.b_, x.r_, x.u_, x.e_)


def test_image_links_need_a_scheme_and_a_known_suffix(spark):
    body = "[img]javascript:x[/img] ![a](data:y) ![b](https://h/b?c) [IMG] https://h/x.png [/IMG] https://h/y.avif?z=1 http://h/z.svg [img]http://h/q[/img] http://h/w.bmp"
    found = spark.createDataFrame([(body,)], "t string").select(urls.image_urls(F.col("t")).alias("u")).first().u
    assert found == ["http://h/q", "https://h/b?c", "https://h/x.png", "https://h/y.avif?z=1"]


def test_any_white_space_ends_an_image_link(spark):
    spaces = ["\u3000", "\u00a0", "\u2003", "\ufeff", "\u2028", "\t", "\v"]
    body = "".join(f"https://h/{k}.png{s}" for k, s in enumerate(spaces)) + "![a](https://h/q\u3000r.x) [img]\u00a0http://h/z[/img] [img]http://h/p\u3000[/img]\u0085"
    found = spark.createDataFrame([(body,)], "t string").select(urls.image_urls(F.col("t")).alias("u")).first().u
    assert found == ["http://h/p", *[f"https://h/{k}.png" for k in range(len(spaces))]]


def test_percentile_narrows_to_the_exact_value(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "RANKED", 50)
    values = [float((k * 7919) % 5003) for k in range(5000)] + [17.0] * 3000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    some = sorted(v for v in values if v is not None)
    for p in (0.0, 0.2, 0.95, 0.999, 1.0):
        at = p * (len(some) - 1)
        want = some[int(at)] + (some[min(len(some) - 1, int(at) + (at > int(at)))] - some[int(at)]) * (at - int(at))
        assert abs(telemetry.percentile(df, "v", p).first().value - want) < 1e-9
        for between in ((-9.0, 9e9), (want, want), (want - 3, want + 3), (9e8, 9e9)):
            assert abs(telemetry.percentile(df, "v", p, between).first().value - want) < 1e-9
    assert telemetry.percentile(df.where("v < 0"), "v", 0.5).first().value is None
    assert telemetry.percentile(df.where("v < 0"), "v", 0.5, (0.0, 1.0)).first().value is None


def test_latency_sketches_of_two_halves_merge_to_the_whole(spark):
    rows = [(T0 + timedelta(seconds=7 * k), float((k * 7919) % 30_011) if k % 50 else None, "dense" if k % 3 else "sparse") for k in range(30_000)] + [(None, 5.0, None)]
    log = spark.createDataFrame(rows, "ts timestamp, ms double, mode string")
    halves = telemetry.latency_sketches(log.where("ms is null or ms % 2 = 0")).unionByName(telemetry.latency_sketches(log.where("ms % 2 = 1")))
    plain = telemetry.retrieval_stats(log, ["dense", "sparse", "none"]).first()
    for sketches in (telemetry.latency_sketches(log), halves):
        low, high = telemetry.sketched_bounds(sketches, 0.95)
        some = sorted(ms for _, ms, _ in rows if ms is not None)
        share = lambda v: sum(x <= v for x in some) / len(some)
        assert low <= plain.p95_ms <= high and 0.93 < share(low) < 0.95 < share(high) < 0.97
        got = telemetry.retrieval_stats(log, ["dense", "sparse", "none"], sketches).first()
        assert abs(got.avg_ms - plain.avg_ms) < 1e-6 and got[1:] == plain[1:]
    for odd in (log.limit(0), log.where("ms is null")):
        assert telemetry.retrieval_stats(odd, ["dense"], telemetry.latency_sketches(odd)).first() == telemetry.retrieval_stats(odd, ["dense"]).first()
    nan = spark.createDataFrame([(T0, float("nan"), "a")] * 40 + [(T0, float(k), "a") for k in range(60)], "ts timestamp, ms double, mode string")
    assert telemetry.retrieval_stats(nan, ["a"], telemetry.latency_sketches(nan)).select("p95_ms").first() is not None


def test_sparse_search_moves_no_tokens(spark):
    docs = spark.createDataFrame([(k, f"the w{k % 7} w{k % 3} the") for k in range(200)] + [(900, None), (901, "")], "id long, text string")
    rows = text.sparse_rows(docs, "id")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    q = rows.where("id < 3").withColumnRenamed("id", "query_id")
    want = q.select("query_id", F.inline("pairs")).withColumnRenamed("w", "qw").join(rows.select("id", F.inline("pairs")), "idx").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    every = retrieval.sparse_scores(q, rows)
    assert sorted(every.collect()) == sorted(want.collect())
    best = retrieval.top_k(retrieval.sparse_scores(q, rows, 5), 5).select("query_id", "id", "score", "rank")
    assert sorted(best.collect()) == sorted(retrieval.top_k(want, 5).select("query_id", "id", "score", "rank").collect())


def test_cooldown_folds_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [("a" if k % 3 else None, k, k * 10) for k in range(40)]
    df = spark.createDataFrame(rows, "session string, id long, s long").select("session", "id", F.timestamp_seconds("s").alias("ts"))
    got = {x.id: (x.accepted, x.wait_s) for x in messages.cooldown(df, 25).collect()}
    bounded(spark)
    for key in ("a", None):
        last = None
        for s, k, t in rows:
            if s == key:
                ok = last is None or t - last >= 25
                assert got[k] == (ok, None if ok else last + 25 - t)
                last = t if ok else last


def test_bucketed_tables_join_without_an_exchange(spark):
    from quern.sources import staging

    rows = spark.range(200).select((F.col("id") % 7).cast("string").alias("k"), "id")
    left = staging.bucketed(rows, "rows", "k")
    assert sorted(left.collect()) == sorted(rows.collect())
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(counts.collect()) == sorted(rows.groupBy("k").agg(F.count("*").alias("n")).collect())


def test_active_counts_keep_null_series_and_times(spark):
    times = [None, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 5), datetime(2024, 1, 2)]
    rows = [(s, t, i, 1 if i % 3 else -1) for i, (s, t) in enumerate([(s, t) for s in ("a", None) for t in times])]
    got = telemetry.active_over_time(spark.createDataFrame(rows, "series string, ts timestamp, id long, change int")).collect()
    want, total = {}, {}
    for s, t, i, change in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or times[1], r[2])):
        total[s] = want[i] = total.get(s, 0) + change
    assert {r.id: r.active for r in got} == want
