"""The registered queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, imatch, lines, packing, pii, quality, simhash, substrings, warc

#: The vocabulary of op4 and of the pipeline's last stage.
TOKENIZER = "word_bpe_49k.json"
#: The key of op5's pseudonyms; a deployment has its own.
PII_KEY = b"quarrylog demonstration key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.LineIndex.build(docs).apply(docs, with_kept=False, inside=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("loss_tokens")


def conversations_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations under limits on tokens, segments and loss-bearing tokens, which the assistant's turns are."""
    turns = table(spark, sf_dir, "conversations").withColumn("unlearnt", F.when(F.col("role") == "assistant", 0).otherwise(1 << 31)).withColumn("doc_id", F.col("conv_id"))
    packed = packing.pack(turns, public_tokenizers.path(TOKENIZER), packing.Limits(2048, 12, 1024), loss_from="unlearnt", also=("turn", "role"))
    return packed.withColumnRenamed("doc_id", "conv_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op9_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages' records against a replica in which each 97th page's record has a wrong byte."""
    recs = warc.records(table(spark, sf_dir, "pages"))
    return warc.audit(recs, warc.damaged(recs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_line_dedup, op4_packing, op5_pii, op6_html_extract, op7_substring_dedup, op8_imatch, op9_warc_merkle, op10_quality, conversations_packing)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM sized, LATERAL unnest(range(1, len(w) - n + 2)) AS t(i)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, k.n, i, array_to_string(w[i : i + k.n - 1], ' ') AS gram FROM docs, (SELECT DISTINCT n FROM windows) k, LATERAL unnest(range(1, len(w) - k.n + 2)) AS t(i)),
found AS (SELECT p.doc_id, p.n, p.i, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.gram = v.gram),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, LATERAL unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_KEY = rf"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}')"

OP3_SQL = f"""
WITH split AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, i, line, {_KEY} AS k FROM split),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id
"""


_RECORD = r"""encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10))"""

OP9_SQL = f"""
WITH r AS (SELECT page_id, page_id // 256 AS file, {_RECORD} AS record FROM pages),
m AS (SELECT page_id, file, octet_length(record) AS length, sha256(record) AS digest FROM r)
SELECT CAST(file AS BIGINT) AS file, row_number() OVER w - 1 AS place, page_id, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, digest,
       CASE WHEN page_id % 97 = 0 THEN 'damaged' ELSE 'sound' END AS status
FROM m WINDOW w AS (PARTITION BY file ORDER BY page_id)
"""

OP7_SQL = """
WITH RECURSIVE b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
starts AS (SELECT doc_id, i, hex(raw[i : i + 49]) AS s FROM b, LATERAL unnest(range(1, octet_length(raw) - 48)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
hits AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE doc_id > first),
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run),
ends AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e FROM spans GROUP BY doc_id),
cut AS (SELECT b.doc_id, raw, coalesce(s, []) AS s, coalesce(e, []) AS e FROM b LEFT JOIN ends USING (doc_id))
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(e) - list_sum(s), 0) AS BIGINT) AS n_removed, CAST(len(s) AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(0, len(s) + 1), lambda k: hex(raw[CASE WHEN k = 0 THEN 1 ELSE e[k] END : CASE WHEN k = len(s) THEN octet_length(raw) ELSE s[k + 1] - 1 END])), ''))) AS kept_sha256
FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op9_warc_merkle": OP9_SQL}
