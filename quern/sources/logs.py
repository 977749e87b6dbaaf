"""Event logs as JSON lines, and captured server-sent events."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: White space that is stripped off a line.
STRIPPED = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_FIELDS = ["run_id", "timestamp", "type", "payload"]
_ODD = StructType([StructField("ok", BooleanType()), *(StructField(c, StringType()) for c in _FIELDS)])


@F.arrow_udf(_ODD)
def _odd_line(lines: pa.Array) -> pa.Array:
    """Lines that Spark's parser refuses, read as the log's writer would: of repeated keys the last counts, NaN and infinite
    numbers are values. Null for null."""

    def one(line: str | None) -> dict | None:
        if line is None:
            return None
        try:
            value = json.loads(line)
        except (ValueError, RecursionError):
            return {"ok": False}
        if not isinstance(value, dict):
            return {"ok": True}
        text = {k: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k, v in value.items() if k in _FIELDS}
        return {"ok": True} | text

    kind = pa.struct([("ok", pa.bool_()), *((c, pa.string()) for c in _FIELDS)])
    return pa.array([one(x) for x in lines.to_pylist()], kind)


def _plain_json(c: str) -> Column:
    """Whether a text is one JSON value by Spark's parser, which ignores what follows a value: only a single value is valid
    both inside an array and inside an object."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))).isNotNull()


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines (``value``, stripped of white space) that are JSON: blank and unparsable ones are dropped, values that are no
    object are kept.

    Adds ``run``, ``timestamp``, ``type``, ``payload`` (JSON text), null where the value has no such field. Plain lines
    are parsed in the JVM; Python sees only those refused there, of which it keeps repeated keys, NaN and infinities.
    """
    plain = _plain_json("value")
    rows = lines.withColumn("value", F.trim("value", F.lit(STRIPPED))).where("value <> ''")
    rows = rows.withColumn("_odd", _odd_line(F.when(~plain, F.col("value")))).where("_odd is null or _odd.ok")
    field = lambda name: F.when(F.col("_odd").isNull(), F.get_json_object("value", f"$.{name}")).otherwise(F.col(f"_odd.{name}"))
    return rows.withColumns({"run": field("run_id"), "timestamp": F.try_to_timestamp(field("timestamp")), "type": field("type"), "payload": field("payload")}).drop("_odd")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event logs under ``path``: ``run_id`` as the line says (as :func:`append_events` writes it), else from the name of its
    file (one file a run), and the fields of each line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_log(lines).select(F.coalesce("run", F.regexp_replace("file", r"\.[^.]*$", "")).alias("run_id"), "timestamp", "type", "payload", "value")


def _line(events: DataFrame) -> Column:
    """An event as JSON in ASCII: run_id, timestamp, type, payload (an object where it is JSON text, else a string)."""
    head = F.to_json(F.struct(F.col("run_id").cast("string").alias("run_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "type"))
    payload = F.when(F.try_parse_json("payload").isNotNull(), F.regexp_replace("payload", r"[\r\n]+", " ")).when(F.col("payload").isNotNull(), F.to_json(F.array("payload")).substr(F.lit(2), F.length(F.to_json(F.array("payload"))) - 2))
    line = F.concat(F.left(head, F.length(head) - 1), F.when(payload.isNotNull(), F.concat(F.when(head == "{}", "").otherwise(","), F.lit('"payload":'), payload)).otherwise(F.lit("")), F.lit("}"))
    # Beyond ASCII, each UTF-16 unit is written by its number.
    units = lambda run: F.concat(F.lit("\\u"), F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), r"(.{4})(?!$)", r"$1\\u"))
    pieces = F.regexp_extract_all(line, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    return F.when(F.rlike(line, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(r"^[\x00-\x7F]")), p).otherwise(units(p))), "")).otherwise(line)


def append_events(events: DataFrame, path: str) -> None:
    """Appends events (run_id, timestamp, type, payload as JSON text) as lines of ASCII JSON, in folders by date, so a day
    has few files and not one for each run; a line says whose it is. Times are written in the session's zone, which is UTC."""
    rows = events.select(_line(events).alias("value"), F.coalesce(F.to_date("timestamp").cast("string"), F.lit("none")).alias("date"))
    rows.write.mode("append").partitionBy("date").text(path)


def sse_frames(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON frames of captured streams, and blocks that are no JSON. captures: run_id, raw.

    CRLF is LF; a blank line ends a frame, so an unterminated last one is left out; comment lines are ignored and
    data lines, without the white space before them, joined by LF; nothing counts from ``[DONE]`` on.
    """
    body = F.replace("raw", F.lit("\r\n"), F.lit("\n"))
    blocks = captures.select("run_id", F.split(body, "\n\n").alias("b"))
    blocks = blocks.select("run_id", F.posexplode(F.slice("b", F.lit(1), F.size("b") - 1)).alias("pos", "block"))
    data = F.filter(F.split("block", "\n"), lambda line: F.startswith(line, F.lit("data:")))
    joined = F.array_join(F.transform(data, lambda line: F.regexp_replace(line, r"^data:\s*", "")), "\n")
    joined = F.regexp_replace(joined, r"^\s+|\s+$", "")
    rows = blocks.select("run_id", F.col("pos").cast("long").alias("pos"), F.when(F.size(data) > 0, joined).alias("json")).where("json is not null")
    end = F.min(F.when(F.col("json") == "[DONE]", F.col("pos"))).over(Window.partitionBy("run_id"))
    rows = rows.withColumn("_end", end).where("_end is null or pos < _end").drop("_end")
    plain = _plain_json("json")
    rows = rows.withColumn("_good", plain | F.coalesce(_odd_line(F.when(~plain, F.col("json")))["ok"], F.lit(False)))
    return rows.where("_good").drop("_good"), rows.where("not _good").drop("_good")
