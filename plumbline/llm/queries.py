"""The thin queries ``opN_<name>``: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_text, licenses, lm_score, packing, quality, sharding, simhash, substrings, warc
from plumbline.llm.common import cut
from plumbline.llm.license_sql import scan_sql


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_words_before").alias("n_words"), F.col("n_words_removed").alias("n_removed"), F.col("kept_digest").alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality.measure(_read(spark, sf_dir, "documents")))
    judged = quality.assess_measured(measured, quality.fit_measured(measured, _read(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_score": op1_lm_score, "op2_simhash": op2_simhash, "op3_packing": op3_packing, "op4_decontaminate": op4_decontaminate, "op5_warc": op5_warc, "op6_licenses": op6_licenses, "op7_sharding": op7_sharding, "op8_html": op8_html, "op9_substrings": op9_substrings, "op10_quality": op10_quality}


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: SHA-1 as bare base32: every five hexadecimal digits are four characters of five bits.
_BASE32 = "array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, k * 5 + 1, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '')"

SQL = {
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op6_licenses": scan_sql(),
    "op9_substrings": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM rep)), (SELECT unnest(range(35)) AS k)),
x AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, list(x.x ORDER BY x.p) AS ks FROM x LEFT JOIN cov ON cov.doc_id = x.doc_id AND cov.p = x.p WHERE cov.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(len(ks), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express over whole tables; tests hold the others against brute force."""
    return dict(SQL)
