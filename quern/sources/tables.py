"""Tables of the engine, and how the given tables stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("request_messages_json", T.StringType()),
        T.StructField("settings_json", T.StringType()),
        T.StructField("resources_json", T.StringType()),
        T.StructField("ttft_ms", T.DoubleType()),
        T.StructField("total_time_ms", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("tokens_per_s", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)
SUMMARY = ["run_id", "created_at", "updated_at", "status", "model", "ttft_ms", "total_time_ms", "input_tokens", "output_tokens", "tokens_per_s", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan for costly work on each row: one with fewer splits than there are cores is dealt to all of them; a
    large table stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from Parquet with the fixed 14-column schema."""
    return spark.read.schema(RUN).parquet(path)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs. F is a completed run with metrics, P a failed one with an error, O a running one without."""
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    when = F.col("o_orderdate").cast("timestamp")
    made = {
        "run_id": F.col("o_orderkey"),
        "created_at": when,
        "updated_at": when,
        "status": F.when(done, "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed"),
        "model": F.col("o_orderpriority"),
        "request_messages_json": F.concat(F.lit('[{"role":"user","content":"order '), F.col("o_custkey").cast("string"), F.lit('"}]')),
        "settings_json": F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit('{"top_k":'), (F.col("o_custkey") % 50).cast("string"), F.lit("}"))),
        "resources_json": F.lit(None),
        "ttft_ms": F.when(done, F.col("o_totalprice") / 10),
        "total_time_ms": F.when(done, F.col("o_totalprice")),
        "input_tokens": F.col("o_custkey"),
        "output_tokens": F.when(done, F.col("o_custkey")),
        "tokens_per_s": F.when(done, F.col("o_custkey") / (F.col("o_totalprice") / 1000)),
        "error": F.when(F.col("o_orderstatus") == "P", F.lit("stream closed")),
    }
    return o.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in RUN])


def tokens(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Line items shipped on or after their order's date as a run's tokens: ``run_id``, ``ts``, ``index``, ``token``, ``n``.
    ``tasks``: how many runs are dealt to, where it is not the session's number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    # The window goes by the column that callers select runs by, so that Spark selects them before it sorts.
    order = Window.partitionBy("run_id").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = rows.select(F.col("l_orderkey").alias("run_id"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = (rows.repartition(tasks, "run_id") if tasks else rows).withColumn("index", F.row_number().over(order).cast("long"))
    return rows.select("run_id", F.col("l_shipdate").cast("timestamp").alias("ts"), "index", F.concat(F.lit("w"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("token"), F.col("l_quantity").alias("n"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bus messages and telemetry: ``id``, ``ts``, ``session``, ``channel``, ``value``, ``props``, ``k``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("channel"), "value", "props", F.get_json_object("props", "$.k").cast("long").alias("k"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as forum posts with image markup on every third: ``thread``, ``post``, ``author``, ``body``."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    markup = F.concat(F.lit(" [img]http://img.example/"), conv, F.lit("/"), turn, F.lit(".png[/img] ![x](https://img.example/"), conv, F.lit("/a?c=1) https://img.example/"), (F.col("turn") % 2).cast("string"), F.lit(".JPG?w=2\u3000https://img.example/wide.png\u00a0"))
    return c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("post"), F.col("role").alias("author"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, markup).otherwise(F.lit(""))).alias("body"))


def half_up(x: Column) -> Column:
    """Rounding of the reference's clients: half goes up."""
    return F.floor(x + 0.5)
