"""op5: the compression classifier over every whole document. SQL can't compress; accuracy is tested on the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.llm.common import table
from layerkv.llm.quality_model import is_good, score, train
from layerkv.llm.training import fold

NAME, SQL = "op5_quality_classifier", None
THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", is_good(THRESHOLD).alias("predicted"))
