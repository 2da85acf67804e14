"""Documents to training shards: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last keep the columns of documents; the
last adds size, checksum, shard and slot. The mixing stage's training order is the order of its files and of
their rows, which the last stage cuts. Compression,
signatures and alignment are beyond SQL, so the pipeline is tested against a brute-force version.

Defined results: a null text counts as the empty one, which is one class to near duplicates; null and
repeated ids lose no row whose text differs; an empty table, or one of which nothing is left, gives an
empty result; further columns of ``documents`` go along up to the last stage, which drops them. A text is
read whole however long it is. Without labels every document passes the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.llm import decontamination, mixing, near_dedup, quality_model, sharding
from layerkv.llm.common import checkpoint_dir, dropped, table

QUALITY, SHARDS = 0.3, 40
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")), QUALITY)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, that of the least id; classes without ids keep one too."""
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by training position."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each copy, cut along the training order, with its text.

    The order is that of the mixing stage's files and of the rows in them, so ``docs`` must be read from
    files. Only places and sizes are sorted; each file's runs of slots are sent back to the rows (a row
    for each file and shard).
    """
    file, row = "_file", "_place"
    number = F.lpad(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), 10, "0")  # more digits than Spark pads to
    at = {file: F.concat(number, F.col("_metadata.file_name")), row: F.col("_metadata.row_index")}
    placed = sharding.assign_shards(docs, sharding.text_bytes(), at, SHARDS)
    runs = placed.groupBy(F.col(file).alias("_run"), "shard").agg(F.min(row).alias("_low"), F.max(row).alias("_high"), F.min("slot").alias("_slot"))
    added = at | {"size": sharding.text_bytes(), "text_crc32": sharding.text_crc32()}
    rows = docs.select(*DOCUMENT, *[e.alias(name) for name, e in added.items()])
    out = rows.join(F.broadcast(runs), (F.col(file) == F.col("_run")) & F.col(row).between(F.col("_low"), F.col("_high"))).withColumn("slot", F.col("_slot") + F.col(row) - F.col("_low"))
    return out.select(*DOCUMENT, "size", "text_crc32", "shard", "slot")


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage returns is written below the shared checkpoint folder and
    removed when the next stage's is written; the last stage's input stays there for the result."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
