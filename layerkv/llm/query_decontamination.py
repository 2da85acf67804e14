"""op8: benchmark passages in all documents. Alignment is beyond SQL; the query is tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerkv.llm.common import table
from layerkv.llm.decontamination import findings

NAME, SQL = "op8_decontamination", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
