"""op3: all documents mixed to 150% of their words, sources weighing 3, 1, 2 and falling, flat, rising in turn; in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.llm.common import WORD, table
from layerkv.llm.mixing import CURVES, mixed, segments, word_count

NAME = "op3_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_n_words"))
    return mixed(sized, F.col("_n_words"))


def position_sql(reached: str, curve: str) -> str:
    """The time at which a curve's cumulative demand reaches a part of its whole, piece by piece as in ``mixing.position``."""
    cases = []
    for k, knots in enumerate(CURVES):
        pieces = []
        for t0, length, w0, slope, before, through in segments(knots):
            v = f"greatest({reached} - {before!r}::DOUBLE, 0.0::DOUBLE)"
            root = f"({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {v} * {2 * slope!r}::DOUBLE, 0.0::DOUBLE)))"
            pieces.append(f"WHEN {reached} < {through!r}::DOUBLE THEN {t0!r}::DOUBLE + least(CASE WHEN {root} > 0 THEN 2 * {v} / {root} ELSE 0.0 END, {length!r}::DOUBLE)")
        cases.append(f"WHEN {curve} = {k} THEN CASE {' '.join(pieces)} ELSE 1.0::DOUBLE END")
    return f"CASE {' '.join(cases)} END"


SQL = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS row_no, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, doc_id::VARCHAR AS name
  FROM documents
), sized AS (SELECT *, md5(coalesce(name, '') || ':' || size) AS digest FROM numbered
), totals AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY src) - 1 AS rank, source_size * 2.0::DOUBLE AS most FROM totals
), weighed AS (
  SELECT *, ([3, 1, 2]::DOUBLE[])[(rank % 3 + 1)::INT] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM ranked
), visited AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still
  FROM weighed
), judged AS (SELECT *, (wanted - used) * weight / still >= most AS filled FROM visited
), leveled AS (
  SELECT *, (SELECT arg_min((wanted - used) / still, (most / weight, rank)) FROM judged WHERE NOT filled) AS level FROM judged
), aimed AS (SELECT src, source_size, CASE WHEN filled THEN most ELSE level * weight END AS target, rank % 3 AS curve FROM leveled
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY digest, size ROWS UNBOUNDED PRECEDING) - size AS words_before FROM sized JOIN aimed USING (src)
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(least(ceil((target - words_before::DOUBLE - size::DOUBLE / 2) / source_size), 2), 0) ELSE 0 END::INTEGER AS copies FROM placed
), spread AS (SELECT *, unnest(CASE WHEN copies > 0 THEN range(copies) ELSE [NULL] END) AS copy FROM counted
), timed AS (
  SELECT *, CASE WHEN copy IS NOT NULL THEN {position_sql("((words_before + copy * source_size)::DOUBLE / target)", "curve")} END AS position FROM spread
), met AS (SELECT * REPLACE (CASE WHEN position < 1 THEN position END AS position) FROM timed)
SELECT doc_id, size, source_size, target, (count(position) * size)::BIGINT AS taken, count(position)::INTEGER AS copies, min(position) AS position, max(position) AS last_position
FROM met GROUP BY row_no, doc_id, size, source_size, target
"""
