"""op10: every conversation rendered from the perspective of every participant, a row for each turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerkv.llm.chat import CLOSE, OPEN, perspectives
from layerkv.llm.common import table

NAME = "op10_chat"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = f"""
WITH rows_ AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN '' ELSE '=' || conv_id END AS conv, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
), voices AS (SELECT DISTINCT conv, speaker AS assistant FROM rows_ WHERE speaker <> 'system'
), seen AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = assistant THEN 'assistant' ELSE 'user' END AS role FROM rows_ JOIN voices USING (conv)
), headed AS (
  SELECT *, '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\\r\\n]+', ' ', 'g') ELSE '' END || chr(10) AS head FROM seen
), cut AS (SELECT *, head || content || '{CLOSE}' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS turn_no, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS until
  FROM cut WINDOW w AS (PARTITION BY conv, assistant ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT conv_id, assistant, turn, turn_no, speaker, role, segment, (until - length(segment))::BIGINT AS start,
       (CASE WHEN role = 'assistant' THEN until - length(segment) + length(head) END)::BIGINT AS loss_start, until::BIGINT AS "end"
FROM placed
"""
