"""Telemetry: summaries by run, rates of counters, interval and as-of joins, bounded histories, ingestion progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import format_eta


def resource_summary(samples: DataFrame, devices: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """Per run the sample count, mean and peak of cpu and memory, and peak rss; and from ``devices`` (one row for each
    GPU and sample: by, memory_used, util) the peaks over all of them. Devices are summed up on their own, so they
    count no sample twice. Values that are not numbers are nulls and ignored; a run without samples has no row."""
    out = samples.groupBy(by).agg(F.count("*").alias("samples"), F.avg("cpu").alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.avg("memory").alias("memory_avg"), F.max("memory").alias("memory_max"), F.max("rss").alias("rss_max"))
    if devices is None:
        return out
    return out.join(devices.groupBy(by).agg(F.max("memory_used").alias("gpu_memory_max"), F.max("util").alias("gpu_util_max")), by, "left")


def headroom(telemetry: DataFrame) -> DataFrame:
    """Free GPU memory over all devices, and its and RAM's share for each client (truncated; one client at least).

    telemetry: gpu (array of struct of used and total), available, clients. Null without devices.
    """
    free = F.aggregate("gpu", F.lit(0).cast("long"), lambda a, g: a + F.greatest(F.lit(0).cast("long"), g["total"] - g["used"]))
    free = F.when(F.size(F.coalesce("gpu", F.array())) > 0, free)
    clients = F.greatest(F.lit(1).cast("long"), F.coalesce("clients", F.lit(0).cast("long")))
    return telemetry.withColumn("gpu_free", free).withColumns({"gpu_free_per_client": (F.col("gpu_free") / clients).cast("long"), "ram_per_client": (F.col("available") / clients).cast("long")})


#: Seconds of a stretch of time, by which long series are cut into tasks.
STRETCH_S = 86_400


def _neighbour(rows: DataFrame, by: str, values: list[str], forward: bool = False, stretch_s: int = STRETCH_S) -> DataFrame:
    """Adds ``_near``, a struct of ``values`` of the row before (or after) in the series, by time and id; null if there is none.

    A series is cut into stretches of time. The last (first) row of each is handed on to the next, and a window looks
    inside its stretch only, so one series of very many rows has many tasks.
    """
    order, there = F.struct("ts", "id"), F.struct(*values)
    cut = rows.withColumn("_b", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / stretch_s))
    ends = cut.groupBy(by, "_b").agg((F.min_by if forward else F.max_by)(there, order).alias("_end"))
    series = Window.partitionBy(by).orderBy("_b")
    ends = ends.select(F.col(by).alias("_series"), F.col("_b").alias("_slot"), (F.lead if forward else F.lag)("_end").over(series).alias("_handed"))
    # A null series is one of its own, and rows without a time come before all others.
    out = cut.join(ends, F.col(by).eqNullSafe(F.col("_series")) & F.col("_b").eqNullSafe(F.col("_slot")))
    own = Window.partitionBy(by, "_b").orderBy("ts", "id")
    near = (F.lead if forward else F.lag)(there).over(own)
    return out.withColumn("_near", F.coalesce(near, "_handed")).drop("_b", "_series", "_slot", "_handed")


def counter_rate(telemetry: DataFrame, counters: list[str], by: str = "host", stretch_s: int = STRETCH_S) -> DataFrame:
    """Per second rate of each counter since the sample before: whole, never negative, over at least 1 ms; null in the
    first sample. Adds ``<counter>_rate`` and ``total_rate``."""
    near = _neighbour(telemetry, by, ["ts", "id", *counters], stretch_s=stretch_s)
    span = F.greatest(F.lit(0.001), (F.unix_micros("ts") - F.unix_micros("_near.ts")) / 1e6)
    rates = {f"{c}_rate": F.when(F.col("_near.id").isNotNull(), F.greatest(F.lit(0).cast("long"), ((F.col(c) - F.col(f"_near.{c}")) / span).cast("long"))) for c in counters}
    return near.withColumns(rates).drop("_near").withColumn("total_rate", reduce(Column.__add__, [F.col(c) for c in rates]))


def last_n(df: DataFrame, by: list[str] | str, n: int, newest: list[str]) -> DataFrame:
    """Newest ``n`` rows of each series, by the columns ``newest`` (the last ones break ties): bounded retention."""
    order = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in newest])
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def samples_in_runs(runs: DataFrame, telemetry: DataFrame, bucket_s: int = 60, by: str = "host") -> DataFrame:
    """Samples whose time lies in a run's lifetime, both ends included.

    An interval join as an equi-join on dyadic stretches of time. A run is put on the level whose stretches (``bucket_s``
    seconds times a power of two) are at least a quarter as long as the run, so it touches at most six of them, whether it
    lasts a minute or a year. A sample is in one stretch of each level that runs are on (which are few: a level for each
    doubling of the runs' lengths), and exact bounds are checked after. runs: host, run_id, started_at, ended_at; telemetry: host, ts, ...
    """
    runs = runs.where("ended_at >= started_at")
    length = (F.unix_seconds("ended_at") - F.unix_seconds("started_at")) / (4 * bucket_s)
    level = F.when(length > 1, F.ceil(F.log2(length))).otherwise(F.lit(0)).cast("int")
    slot = lambda c, level: F.floor(F.unix_seconds(c) / (bucket_s * F.pow(F.lit(2.0), level))).cast("long")
    leveled = runs.withColumn("_level", level)
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect()) or [0]
    spread = leveled.withColumn("_b", F.explode(F.sequence(slot("started_at", F.col("_level")), slot("ended_at", F.col("_level")))))
    every = F.array(*[F.struct(F.lit(n).alias("_level"), slot("ts", F.lit(n)).alias("_b")) for n in levels])
    samples = telemetry.withColumn("_s", F.explode(every)).select(*telemetry.columns, "_s._level", "_s._b")
    return spread.join(samples, [by, "_level", "_b"]).where("ts between started_at and ended_at").drop("_level", "_b")


def snapshot_asof(runs: DataFrame, telemetry: DataFrame, value: str, by: str = "host", stretch_s: int = STRETCH_S) -> DataFrame:
    """Each run with the latest sample at or before its start (null if none): a union of both, in ordered windows over
    stretches of time, to which the last sample before is handed on.

    runs: host, run_id, started_at; telemetry: host, ts, id and ``value``. Among samples of one time the highest id wins.
    """
    left = runs.select(by, F.col("started_at").alias("ts"), F.lit(1).alias("_run"), "run_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("struct<ts:timestamp,v:double>").alias("_s"))
    right = telemetry.select(by, "ts", F.lit(0).alias("_run"), F.lit(None).cast("long").alias("run_id"), "id", F.struct("ts", F.col(value).cast("double").alias("v")).alias("_s"))
    both = left.unionByName(right).withColumn("_b", F.floor(F.unix_seconds("ts") / stretch_s))
    ends = both.groupBy(by, "_b").agg(F.max_by("_s", F.when(F.col("_run") == 0, F.struct("ts", "id"))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("_series"), F.col("_b").alias("_slot"), F.last("_end", ignorenulls=True).over(before).alias("_handed"))
    both = both.join(ends, F.col(by).eqNullSafe(F.col("_series")) & F.col("_b").eqNullSafe(F.col("_slot")))
    order = Window.partitionBy(by, "_b").orderBy("ts", "_run", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(order), "_handed"))
    return seen.where("_run = 1").select(by, "run_id", F.col("ts").alias("started_at"), F.col("_s.ts").alias("snapshot_at"), F.col("_s.v").alias(value))


def active_over_time(changes: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Number of active runs after each start (+1) or finish (-1), per series. changes: series, ts, id, change.

    Changes are summed by time bucket, the sums added up over the buckets of a series, and only then counted on inside
    each bucket: few series do not mean few tasks.
    """
    slots = changes.withColumn("_b", F.floor(F.unix_seconds("ts") / bucket_s))
    sums = slots.groupBy("series", "_b").agg(F.sum("change").alias("_n"))
    before = Window.partitionBy("series").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("series", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("series", "_b").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    carried = carried.withColumnsRenamed({"series": "_series", "_b": "_slot"})
    # A null series is a series of its own, and rows without a time come before all others.
    out = slots.join(carried, F.col("series").eqNullSafe(F.col("_series")) & F.col("_b").eqNullSafe(F.col("_slot")))
    return out.withColumn("active", (F.col("_before") + F.sum("change").over(order)).cast("long")).drop("_b", "_before", "_series", "_slot")


def throughput(progress: DataFrame, window_s: int = 60, newest: int = 120, by: str = "job") -> DataFrame:
    """Chunks per second over the trailing window, of at most the newest samples in it; with one sample, over the time
    since the job began. Spans count as at least a second, falling counts as none.

    progress: job, ts, started_at, processed, id. Adds ``rate``. Samples of one time go by id. A job is cut into stretches
    of ten windows; the last window of a stretch goes to the next one too, so that long jobs have many tasks.
    """
    width = window_s * 10_000_000
    timed = progress.withColumn("_t", F.unix_micros("ts")).withColumn("_b", F.floor(F.col("_t") / width))
    near_end = F.pmod(F.col("_t"), F.lit(width)) >= width - window_s * 1_000_000
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    timed = timed.withColumn("_copy", F.explode(copies)).withColumn("_b", F.col("_b") + F.col("_copy"))
    order = Window.partitionBy(by, "_b").orderBy("_t", "id").rowsBetween(-(newest - 1), 0)
    timed = timed.withColumn("_seen", F.collect_list(F.struct("_t", "processed")).over(order)).where("_copy = 0")
    timed = timed.withColumn("_seen", F.filter("_seen", lambda x: x["_t"] >= F.col("_t") - window_s * 1_000_000))
    first = F.get(F.col("_seen"), F.lit(0))
    moved = F.greatest(F.lit(0.0), (F.col("processed") - first["processed"]).cast("double")) / F.greatest(F.lit(1.0), (F.col("_t") - first["_t"]) / 1e6)
    alone = F.col("processed").cast("double") / F.greatest(F.lit(1.0), (F.col("_t") - F.unix_micros("started_at")) / 1e6)
    return timed.withColumn("rate", F.when(F.size("_seen") < 2, alone).otherwise(moved)).drop("_t", "_b", "_copy", "_seen")


def eta(progress: DataFrame) -> DataFrame:
    """Adds ``remaining``, ``eta_s`` (seconds, 0 without a rate), ``percent`` and ``eta``, its text. progress: processed, total, rate."""
    remaining = F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("processed"))
    seconds = F.when(F.col("rate") > 0, F.col("remaining") / F.col("rate")).otherwise(F.lit(0.0))
    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * F.col("processed") / F.col("total"))).otherwise(F.lit(0.0))
    out = progress.withColumn("remaining", remaining).withColumn("eta_s", seconds).withColumn("percent", F.round(percent, 4))
    return out.withColumn("eta", format_eta(F.col("eta_s")))


def stale(progress: DataFrame, after_s: int = 45, by: str = "job", stretch_s: int = STRETCH_S) -> DataFrame:
    """Whether more than ``after_s`` seconds pass after each sample before the next; the last one has none to wait for."""
    gap = (F.unix_micros("_near.ts") - F.unix_micros("ts")) / 1e6
    out = _neighbour(progress, by, ["ts"], True, stretch_s).withColumn("gap_s", gap)
    return out.withColumn("stale", F.coalesce(F.col("gap_s") > after_s, F.lit(False))).drop("_near")


#: Values that are ranked exactly at once.
RANKED = 1_000_000


def percentile(df: DataFrame, column: str, p: float, between: tuple[float, float] | None = None) -> DataFrame:
    """One row, ``value``: the exact percentile with linear interpolation, null without values.

    No task sees all distinct values: while more than ``RANKED`` rows are left, the range that holds the rank is
    narrowed to about a thousandth by approximate quantiles, and what lies below is counted. The few values left are
    counted by value and ranked. ``between``, where it is known, is a range that is thought to hold the rank: if a count
    confirms that it does, narrowing begins there, else with all rows.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    spark, below = df.sparkSession, 0
    if between:
        inside = F.col("v").between(*between)
        n, under, within = rows.agg(F.count("*"), F.count_if(F.col("v") < between[0]), F.count_if(inside)).first()
    else:
        n, under, within = rows.count(), 0, 0
    rank, left = p * (n - 1), n
    if within and under <= int(rank) and rank <= under + within - 1:
        rows, below, left = rows.where(inside), under, within
    while left > RANKED:
        inner = (rank - below) / left
        low, high = rows.agg(F.percentile_approx("v", [max(0.0, inner - 5e-4), min(1.0, inner + 5e-4)], 20_000)).first()[0]
        under, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not (below + under <= int(rank) and rank <= below + under + within - 1) or within == left:
            break
        rows, below, left = rows.where(F.col("v").between(low, high)), below + under, within
        if low == high:
            return spark.range(1).select(F.lit(low).alias("value"))
    # Counts by value combine before they are shuffled.
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    upto = counts.select("v", (F.sum("n").over(Window.orderBy("v")) + below - 1).alias("last"))
    floor, ceil = int(rank), int(rank) + (rank > int(rank))
    ends = upto.agg(F.min(F.when(F.col("last") >= floor, F.col("v"))).alias("a"), F.min(F.when(F.col("last") >= ceil, F.col("v"))).alias("b"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.lit(rank - floor)).alias("value"))


#: Size of a quantile sketch, and how far from the percentile its bounds are taken: over twice its rank error (0.0045).
SKETCH_K, SKETCH_MARGIN = 1_000, 0.01


def latency_sketches(log: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """``slot``, ``mode``, ``samples``, ``known``, ``total_ms`` and ``sketch`` (KLL) by stretch of time and mode: log: ts, ms, mode.

    Rows can be kept and added to: those of more samples, of the same stretches too, are appended, and whatever is
    asked of a span of time is merged from its rows. A sketch holds some thousand values at most, however many samples.
    """
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_s).alias("slot")
    ms = F.col("ms").cast("double")
    return log.groupBy(slot, "mode").agg(F.count("*").alias("samples"), F.count(ms).alias("known"), F.sum(ms).alias("total_ms"), F.kll_sketch_agg_double(ms, SKETCH_K).alias("sketch"))


def sketched_bounds(sketches: DataFrame, p: float) -> tuple[float, float] | None:
    """A range of values that holds the percentile but for a small chance, from merged sketches; None without values."""
    ends = F.array(F.lit(max(0.0, p - SKETCH_MARGIN)), F.lit(min(1.0, p + SKETCH_MARGIN)))
    merged = sketches.where("known > 0").agg(F.count("*").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    found = merged.where("n > 0").select(F.kll_sketch_get_quantile_double("s", ends).alias("q")).first()
    return (found.q[0], found.q[1]) if found else None


def retrieval_stats(log: DataFrame, modes: list[str], sketches: DataFrame | None = None) -> DataFrame:
    """Mean and 95th percentile of latency, samples, and samples of each mode. log: ms, mode.

    With the log's ``sketches``, mean and counts come from them alone, and the exact percentile takes from the log what
    lies within their bounds.
    """
    if sketches is None:
        sums = log.agg(F.avg("ms").alias("avg_ms"), F.count("*").alias("samples"), *[F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in modes])
    else:
        zero = F.lit(0).cast("long")
        of = [F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("samples"))), zero).alias(f"n_{m}") for m in modes]
        sums = sketches.agg((F.sum("total_ms") / F.nullif(F.sum("known"), zero)).alias("avg_ms"), F.coalesce(F.sum("samples"), zero).alias("samples"), *of)
    p95 = percentile(log, "ms", 0.95, sketched_bounds(sketches, 0.95) if sketches is not None else None).select(F.col("value").alias("p95_ms"))
    return sums.withColumn("p95_ms", p95.scalar()).select("avg_ms", "p95_ms", "samples", *[f"n_{m}" for m in modes])
