"""op7: secrets in every whole document.

Tokens can't be counted in SQL, so the query is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerkv.llm.common import table
from layerkv.llm.secrets import scan

NAME, SQL = "op7_secrets", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
