"""op6: count rules and the n-gram likelihood ratio over every whole document.

Trusted are the documents that ``labels`` marks with quality 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.llm.common import WORD, table
from layerkv.llm.quality_rules import BUCKETS, MIXER, THRESHOLD, UNIT, log_ratios, measure
from layerkv.llm.query_sharding import CRC, CRC_TABLE

NAME = "op6_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    rows = measure(docs, log_ratios(docs, trusted))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


SQL = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), tokens AS (
  SELECT r, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM docs
), spelled AS (SELECT DISTINCT word, word AS txt, hex(encode(word)) AS hexed FROM tokens
), hashed AS (SELECT word, {CRC} AS crc FROM spelled, crc_table
), placed AS (SELECT r, k, crc, lead(crc) OVER (PARTITION BY r ORDER BY k) AS next_crc FROM tokens JOIN hashed USING (word)
), grams AS (
  SELECT r, crc % {BUCKETS} AS bucket FROM placed UNION ALL SELECT r, (crc * {MIXER} + next_crc) % {BUCKETS} FROM placed WHERE next_crc IS NOT NULL
), trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
), counted AS (
  SELECT bucket, count(*) AS raw, count(t.doc_id) AS target FROM grams JOIN docs USING (r) LEFT JOIN trusted t USING (doc_id) GROUP BY bucket
), sums AS (SELECT sum(raw) + {BUCKETS} AS raws, sum(target) + {BUCKETS} AS targets FROM counted
), ratios AS (
  SELECT bucket, CASE WHEN targets = {BUCKETS} THEN 0 ELSE floor((ln((target + 1)::DOUBLE / targets) - ln((raw + 1)::DOUBLE / raws)) * {UNIT} + 0.5) END::BIGINT AS ratio
  FROM counted, sums
), scored AS (SELECT r, sum(ratio)::DOUBLE / (count(*) * {UNIT}.0::DOUBLE) AS score FROM grams JOIN ratios USING (bucket) GROUP BY r
), lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY r
), threes AS (
  SELECT r, k, word, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM tokens WINDOW w AS (PARTITION BY r ORDER BY k)
), again AS (SELECT r, k FROM threes WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, w2, w3) > 1
), covered AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT r, k FROM again UNION SELECT r, k + 1 FROM again UNION SELECT r, k + 2 FROM again) GROUP BY r
), sized AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(score, 0.0)::DOUBLE AS score
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN scored USING (r)
)
SELECT *, base_failed = false AND score >= {THRESHOLD} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM sized)
"""
