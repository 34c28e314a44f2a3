"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fim, fingerprints, jaccard, langid, linededup, lmscore, merkle, mixing, pii, sharding, tokencount, tokens
from .common import documents


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), share=1.5, most=2.0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.build(documents(spark, sf_dir), tampered).verified()


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(documents(spark, sf_dir), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_output, op2_sharding, op3_mixing, op4_lm_scoring, op5_fingerprints, op6_decontamination, op7_language_id, op8_jaccard_join, op9_line_dedup, op10_pii, op11_token_counts, op12_merkle, op13_fill_in_middle)
}

_WHITE = r"[\x20\x09-\x0D]"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_ASCII_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_WHITE}+', ''), '{_WHITE}+$', '')")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), drops AS (
  SELECT key, max(doc_id) AS kept FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, d.kept IS NOT NULL AND l.doc_id <> d.kept AS gone
  FROM lines l LEFT JOIN drops d ON l.key = d.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Five lower-cased words in a row; a text of fewer words is one shingle of them all.
_SHINGLES = f"""
  SELECT row, id, words, n, CASE WHEN n >= 5 THEN list_transform(range(1, n - 3), lambda i: list_slice(words, i, i + 4)) ELSE [words] END AS own
  FROM (SELECT row, id, words, len(words) AS n FROM (SELECT row_number() OVER () AS row, {{id}} AS id, list_filter(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WHITE}+'), lambda w: w <> '') AS words FROM {{table}})) WHERE n > 0
"""

_LEAKS = f"""
WITH items AS (SELECT row AS item, id AS item_id, least(n, 5) AS size, unnest(list_distinct(own)) AS shingle, len(list_distinct(own)) AS total FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
docs AS (SELECT DISTINCT row AS doc, id AS doc_id, unnest(list_transform(range(1, n - size + 2), lambda i: list_slice(words, i, i + size - 1))) AS shingle
         FROM (SELECT row, id, words, n, size FROM ({_SHINGLES.format(id="doc_id", table="documents")}) CROSS JOIN (SELECT DISTINCT size FROM items) WHERE n >= size)),
held AS (SELECT doc_id, item_id, count(*) / CAST(any_value(total) AS DOUBLE) AS containment FROM docs JOIN items USING (shingle) GROUP BY doc, item, doc_id, item_id)
SELECT doc_id, item_id, max(containment) AS containment FROM held WHERE containment >= 0.8 GROUP BY doc_id, item_id
"""

ORACLE_SQL: dict[str, str] = {"op6_decontamination": _LEAKS, "op9_line_dedup": _LINES}
