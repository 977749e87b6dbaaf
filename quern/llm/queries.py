"""The registered queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, conversation_repair, decontaminate, edit_tokens, fingerprint, hard_negatives, langid, licenses, line_dedup, ngram_lm, sharding, simhash, warc
from quern.sources.staging import new_path, staged

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return str(public_tokenizers.path(VOCABULARY))


def _remainder(m: int):
    """CRC-32 of the id as text, modulo m; a null id has none."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % m


def language_filters(docs: DataFrame) -> langid.Filters:
    return langid.train(docs.where(F.coalesce(_remainder(3) != 1, F.lit(True))).select("text", "lang"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_filters(docs))
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is put together from the archive, verified, and told by the digest of its bytes."""
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    whole = warc.record(F.col("header"), F.col("record_type"), F.col("payload"))
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "verified", F.sha1(whole).alias("record_digest"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one repository per source, in two levels of directories by id. Every tenth is taken for a
    licence file, at one of the three levels, so that licences are passed on."""
    docs = _table(spark, sf_dir, "documents")
    a, b = F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100 % 10).cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    level = F.when(F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 10) % 3).otherwise(F.lit(2))
    path = F.concat_ws("/", "source", F.when(level > 0, a), F.when(level > 1, b), name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.score(docs.select("doc_id", "text", F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out")))


def op6_edit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Trees are built once and stored; the edits read them, and encode nothing but what they reach.
    kept = staged(edit_tokens.trees(docs, vocabulary()), "trees")
    rows = edit_tokens.apply_edits(kept.withColumn("edits", edit_tokens.own_edits(F.col("text"))), vocabulary(), with_trees=False)
    return rows.select("doc_id", "n_tokens", F.length("edited").cast("long").alias("edited_chars"), "edited_tokens", "encoded_chars", F.sha2("edited", 256).alias("edited_sha256"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint.printed(F.col("own")).alias("fingerprint"), fingerprint.printed(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.summary(scanned)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")), "dropped")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives.mine(rows, "id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_edit_tokens": op6_edit_tokens,
    "op7_fingerprint": op7_fingerprint,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        k AS (SELECT body, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY body),
        r AS (SELECT p.page_id, url, p.body, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
               CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to, chr(13) || chr(10) AS nl
        FROM (SELECT p.*, url FROM p JOIN pages USING (page_id)) p LEFT JOIN k ON k.body = p.body)
        SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, url, true AS verified,
               sha1('WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || coalesce('WARC-Target-URI: ' || url || nl, '')
                    || 'WARC-Payload-Digest: sha1:' || payload_digest || nl || 'WARC-Block-Digest: sha256:' || sha256(body) || nl
                    || CASE WHEN record_type = 'revisit' THEN 'WARC-Refers-To: <urn:page:' || refers_to || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl ELSE '' END
                    || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN record_type = 'revisit' THEN 0 ELSE payload_bytes END || nl || nl
                    || CASE WHEN record_type = 'revisit' THEN '' ELSE body END || nl || nl) AS record_digest
        FROM r""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
        hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.x = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        k AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.id <> c.id AND len(a.e) = len(c.e) WHERE a.id % 50 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
        n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
