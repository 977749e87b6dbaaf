"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, joined to read.

Two tables make an archive. ``records`` has the header bytes of every record as they stand in a WARC/1.1 file, and
the digest of its payload. ``payloads`` has each stored payload once. A record whose payload another record has (and
which is at least ``revisit_from`` bytes long) is a revisit of the one with the largest id.

A url with a carriage return or line feed is percent-encoded in its header (with its own percent signs), and a further
header says so; others stand as they are, so that every url is read back as it was.

Nulls: a null html is an empty payload; a null url has no header line; rows with a null id are
written with an empty id and read back as null, and are the response of their payload only where no row has an id.
Rows that repeat an id and a payload get equal records. An empty table gives an empty archive. A payload of any length
is one cell of the payload table. Of records with equal payloads the largest id is the response; rows that tie in it all
are. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.staging import staged

REVISIT_FROM = 1000
#: Header of records whose url is percent-encoded.
ESCAPED = "X-Target-URI-Escaped"
_NO_ID = -(1 << 63)


def _header(kind: Column, refers_to: Column) -> Column:
    """Header bytes, as text: named fields, CRLF, and the empty line."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = kind == "revisit"
    broken = F.rlike("url", F.lit(r"[\r\n]"))
    escaped = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.when(broken, escaped).otherwise(F.col("url"))),
        F.when(broken, F.lit(f"{ESCAPED}: yes")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.col("sha256")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(refers_to))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws("\r\n", *lines)


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Writes ``path/records`` and ``path/payloads`` (Parquet). Which row keeps a payload is found on digests alone.

    Pages and their digests are staged. Digests that several rows share combine before their shuffle. The payloads are shuffled once, to meet the keeper
    of their digest; both sides of that join are plain scans, so AQE can split a digest that very many rows have.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Digests are computed once, where the pages are read; what follows reads them.
    rows = staged(rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256")), "digests")
    shared = rows.where(F.col("payload_bytes") >= revisit_from).groupBy("sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"), F.min("payload_bytes").alias("least"), F.max("payload_bytes").alias("most"), F.min("sha1").alias("one"), F.max("sha1").alias("other"))
    # A strong digest is verified by length and a second digest: unequal payloads under one SHA-256 stop the job.
    ok = F.assert_true((F.col("least") == F.col("most")) & (F.col("one") == F.col("other")), F.lit("payloads differ under one digest"))
    shared.where("n > 1").select("sha256", "keeper", ok.alias("ok")).where("ok is null").drop("ok").write.parquet(f"{path}/shared")
    shared = spark.read.schema("sha256 string, keeper long").parquet(f"{path}/shared")
    # A shared payload has no keeper where no row has an id; it is stored once all the same.
    marked = rows.join(shared.withColumn("shared", F.lit(True)), "sha256", "left")
    revisit = F.col("keeper").isNotNull() & (F.coalesce("page_id", F.lit(_NO_ID)) != F.col("keeper"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    slim = rows.drop("payload").join(shared, "sha256", "left")
    slim.select(_header(kind, F.col("keeper")).alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/records")
    first = marked.where(~revisit)
    # Payloads that no other row has stay where they are; short or repeated keepers may still be equal, and meet.
    first.where(F.col("shared").isNotNull() | (F.col("payload_bytes") < revisit_from)).select("sha256", "payload").dropDuplicates(["sha256"]).unionByName(first.where(F.col("shared").isNull() & (F.col("payload_bytes") >= revisit_from)).select("sha256", "payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record, put together again: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``header``, ``payload``
    (a revisit's too), ``payload_bytes`` and ``payload_digest`` as recomputed from the stored bytes, ``verified``.

    Fields are parsed from the header bytes. Sizes and digests are computed where payloads are stored, so a reader
    who asks only for them moves no payload.
    """
    records = spark.read.schema("header string, sha256 string").parquet(f"{path}/records")
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    stored = stored.select("sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("sha256")).alias("whole"))
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    given = F.rlike("header", F.lit(r"\r\nWARC-Target-URI: "))
    plain = F.replace(F.replace(F.replace(field("WARC-Target-URI"), F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    url = F.when(given, F.when(field(ESCAPED) == "yes", plain).otherwise(field("WARC-Target-URI")))
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    return records.join(stored, "sha256").select(
        number(field("WARC-Record-ID")).alias("page_id"),
        url.alias("url"),
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
        "header",
        "payload",
        "payload_bytes",
        "payload_digest",
        (F.col("whole") & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == field("WARC-Payload-Digest"))).alias("verified"),
    )


def record(header: Column, kind: Column, payload: Column) -> Column:
    """A whole record as bytes: header, block (none for a revisit), and the two closing CRLF."""
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(F.encode(header, "UTF-8"), block, F.lit(b"\r\n\r\n"))


def record_bytes(archive: DataFrame) -> DataFrame:
    """``page_id`` and ``record`` of every row of :func:`read_archive`."""
    return archive.select("page_id", record(F.col("header"), F.col("record_type"), F.col("payload")).alias("record"))
