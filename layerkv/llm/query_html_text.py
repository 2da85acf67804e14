"""op4: the main text of every page. SQL can't parse HTML; the query is tested on pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerkv.llm.common import table
from layerkv.llm.html_text import extract

NAME, SQL = "op4_html_text", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
