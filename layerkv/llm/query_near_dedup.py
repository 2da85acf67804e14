"""op2: the near-duplicate class of every document. Signatures are beyond SQL; the query is tested against all pairs by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerkv.llm.common import table
from layerkv.llm.near_dedup import classes

NAME, SQL = "op2_near_dedup", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
