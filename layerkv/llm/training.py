"""Bounded labelled samples, for operators that learn a model on the driver.

A sample holds, of each class, the labelled rows with the least digests of their ids: at most ``rows`` of
them, and those only as long as the texts before them have fewer than ``most_bytes`` together. So it is
the same on every run, fits the driver at any size of the corpus, and takes texts of any length alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def label_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Rows of label 0 and 1 outside the held-out fold."""
    seen = {r["_label"]: r["n"] for r in _learnable(labels, label).groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return seen.get(0, 0), seen.get(1, 0)


def _learnable(labels: DataFrame, label: str) -> DataFrame:
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.min("_label").alias("_label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of the sample, in the order of the digests."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = _learnable(labels, label).withColumn("_digest", digest)
    few = [known.where(F.col("_label") == k).orderBy("_digest", "doc_id").limit(rows) for k in (0, 1)]
    chosen = few[0].unionByName(few[1])  # 2 * rows rows at most
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "_label", "_digest")).alias("r")).select("doc_id", "r.*")
    before = Window.partitionBy("_label").orderBy("_digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # rows rows at most
    found = texts.withColumn("_before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("_before") < most_bytes).collect()
    return [(r["text"], r["_label"]) for r in sorted(found, key=lambda r: (r["_digest"], r["text"]))]
