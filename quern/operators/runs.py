"""Run log: creation, finalisation, listing, comparison, export, metrics from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.staging import staged
from quern.sources.tables import RUN, SUMMARY

MESSAGES = "array<struct<role:string,content:string,name:string>>"
METRICS = ["ttft_ms", "total_time_ms", "input_tokens", "output_tokens", "tokens_per_s"]


def create_runs(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New run rows, their start events, and requests whose id is taken.

    requests: run_id, created_at, model, request_messages_json, settings_json, resources_json. A new run is
    ``running``, updated when created, with all metrics null. Of requests with one id the first by time is taken.
    """
    known = existing.select("run_id")
    ranked = requests.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "request_messages_json")))
    taken = ranked.where("n > 1").drop("n").unionByName(ranked.where("n = 1").drop("n").join(known, "run_id", "left_semi"))
    fresh = ranked.where("n = 1").drop("n").join(known, "run_id", "left_anti").withColumns({"status": F.lit("running"), "updated_at": F.col("created_at")})
    rows = fresh.select(*[(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RUN])
    events = fresh.select("run_id", F.col("created_at").alias("timestamp"), F.lit("run_started").alias("type"), F.to_json(F.struct("model")).alias("payload"))
    return rows, events, taken


def apply_finalize(runs: DataFrame, finals: DataFrame) -> DataFrame:
    """Runs with their latest final record written over status, metrics, resources, error and updated_at, nulls too.

    finals: run_id, finished_at, status, the five metrics, resources_json, error. Finals of unknown runs change no row.
    """
    changed = ["status", *METRICS, "resources_json", "error"]
    last = Window.partitionBy("run_id").orderBy(F.col("finished_at").desc(), "status")
    latest = finals.withColumn("n", F.row_number().over(last)).where("n = 1").select("run_id", F.lit(True).alias("hit"), F.struct("finished_at", *changed).alias("f"))
    both = runs.join(latest, "run_id", "left")
    over = {c: F.when(F.col("hit"), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in changed}
    over["updated_at"] = F.when(F.col("hit"), F.col("f.finished_at")).otherwise(F.col("updated_at")).alias("updated_at")
    return both.select(*[over.get(c, F.col(c)) for c in runs.columns])


def final_events(finals: DataFrame) -> DataFrame:
    """The event of each final record, known run or not."""
    return finals.select("run_id", F.col("finished_at").alias("timestamp"), F.lit("run_finished").alias("type"), F.to_json(F.struct("status", "error")).alias("payload"))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.select(*SUMMARY)


def run_detail(runs: DataFrame, run_id: int) -> DataFrame:
    """One run with its JSON columns decoded; null or empty is an empty list or map."""
    text = lambda c, empty: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty))
    return runs.where(F.col("run_id") == run_id).select(
        *SUMMARY,
        F.from_json(text("request_messages_json", "[]"), MESSAGES).alias("request_messages"),
        F.from_json(text("settings_json", "{}"), "map<string,string>").alias("settings"),
        F.from_json(text("resources_json", "{}"), "map<string,string>").alias("resources"),
    )


def runs_with_events(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Every run with each of its events; a run without any keeps one row with nulls."""
    return runs.join(events, "run_id", "left")


def prompt_text(messages: Column) -> Column:
    """``role: content`` lines of a message array."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def compare_runs(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected runs side by side; none where fewer than two are selected."""
    chosen = runs.join(ids.select("run_id").distinct(), "run_id", "left_semi")
    enough = chosen.agg(F.count("*").alias("n")).where("n >= 2").select(F.lit(True).alias("ok"))
    out = chosen.select("run_id", "model", "ttft_ms", "total_time_ms", "tokens_per_s", prompt_text(F.from_json("request_messages_json", MESSAGES)).alias("prompt"), F.coalesce("settings_json", F.lit("{}")).alias("settings"), F.coalesce("resources_json", F.lit("{}")).alias("resources"))
    # A one-row aggregate decides whether there is anything to compare.
    return out.join(F.broadcast(enough), F.lit(True), "left_semi")


def export_runs(runs: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """One record per selected run: its detail and its events in order of time and index."""
    chosen = runs.join(ids.select("run_id").distinct(), "run_id", "left_semi")
    own = events.join(ids.select("run_id").distinct(), "run_id", "left_semi")
    logs = own.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ts", "index", "token"))).alias("events"))
    return chosen.join(logs, "run_id", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<ts:timestamp,index:bigint,token:string>>")))


def run_metrics(runs: DataFrame, tokens: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Time to first token, total time, output tokens and rate of each run, from its token times.

    usage: run_id, output_tokens; it wins over the count where not null. A run without tokens has null times.
    """
    seen = tokens.groupBy("run_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("counted"))
    out = runs.select("run_id", "created_at").join(seen, "run_id", "left")
    out = out.join(usage.select("run_id", F.col("output_tokens").alias("used")), "run_id", "left") if usage is not None else out.withColumn("used", F.lit(None).cast("long"))
    ms = lambda a, b: ((F.unix_micros(a) - F.unix_micros(b)) / 1000).cast("double")
    out = out.select("run_id", ms(F.col("first"), F.col("created_at")).alias("ttft_ms"), ms(F.col("last"), F.col("created_at")).alias("total_time_ms"), F.coalesce("used", "counted", F.lit(0)).cast("long").alias("output_tokens"))
    rate = F.when((F.col("total_time_ms") > 0) & (F.col("output_tokens") > 0), F.col("output_tokens") / (F.col("total_time_ms") / 1000))
    return out.withColumn("tokens_per_s", rate)


def assemble(tokens: DataFrame) -> DataFrame:
    """Each run's text: its tokens joined by index."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "token")))
    return tokens.groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("text"))


def index_tokens(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Index from 1 and elapsed milliseconds of each non-empty token. frames: run_id, ts, seq, token."""
    order = Window.partitionBy("run_id").orderBy("ts", "seq")
    kept = frames.where("token <> ''").withColumn("token_index", F.row_number().over(order).cast("long"))
    return kept.join(runs.select("run_id", "created_at"), "run_id").select("run_id", "token_index", "token", ((F.unix_micros("ts") - F.unix_micros("created_at")) / 1000).cast("double").alias("elapsed_ms"))


def first_token(tokens: DataFrame) -> DataFrame:
    """The first token of each run."""
    return tokens.groupBy("run_id").agg(F.min_by(F.struct("ts", "token", "n"), "index").alias("t")).select("run_id", "t.ts", "t.token", "t.n")


#: The order in which a run's states follow each other.
STATES = ["queued", "started", "completed", "failed", "finished"]


def run_status(changes: DataFrame) -> DataFrame:
    """Latest state of each run; among changes of one time, the later state. changes: run_id, ts, status."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    return changes.groupBy("run_id").agg(F.max_by("status", F.struct("ts", place)).alias("status"))


def list_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """Newest summaries first, by id where times are equal."""
    return run_summary(runs).orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)


def sort_key(key: str) -> Column:
    """What runs are ordered by: a null number is 0, a null model ''; models by locale-aware collation."""
    return {"created": F.col("created_at"), "model": F.collate(F.coalesce("model", F.lit("")), "UNICODE"), "ttft": F.coalesce("ttft_ms", F.lit(0.0)), "tps": F.coalesce("tokens_per_s", F.lit(0.0))}[key]


def sort_runs(runs: DataFrame, key: str = "created", ascending: bool = False) -> DataFrame:
    by = sort_key(key)
    return run_summary(runs).orderBy(by.asc() if ascending else by.desc(), "run_id")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their places (from 1) in an order, which must be total: no task sorts all of them.

    Rows are dealt by ranges of the order, whose borders Spark finds by sampling, sorted in their range and staged with
    their range and place in it. The sizes of the ranges, as many as the session shuffles to at most, are added up and
    broadcast.
    """
    parts = min(65_536, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The number is the range in its upper 31 bits, and the place in the range below.
    dealt = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, place).drop("_range", "_at", "_before")


def ranked_runs(runs: DataFrame, key: str = "created", ascending: bool = False) -> DataFrame:
    """Summaries with their places in the order of :func:`sort_runs`."""
    by = sort_key(key)
    return ranked(run_summary(runs), [by.asc() if ascending else by.desc(), F.col("run_id").asc()])


def model_choices(catalog: DataFrame, current: str) -> DataFrame:
    """Distinct model names; the current one first if the catalogue lacks it. catalog: name."""
    spark = catalog.sparkSession
    own = spark.range(1).select(F.lit(current).alias("name"), F.lit(0).alias("priority"))
    return own.unionByName(catalog.select(F.col("name"), F.lit(1).alias("priority"))).groupBy("name").agg(F.min("priority").alias("priority"), F.max("priority").alias("listed")).select("name", F.when((F.col("priority") == 0) & (F.col("listed") == 0), 0).otherwise(1).cast("long").alias("priority"))
