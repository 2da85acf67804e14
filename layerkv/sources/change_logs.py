"""Change logs made of ordinary tables: pick a key, a sequence, what counts as deleted, and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def change_log(df: DataFrame, key: Column, seq: Column, deleted: Column, value: Column) -> DataFrame:
    """``user_key, seq, vtype, value`` over any table."""
    return df.select(key.alias("user_key"), seq.cast("long").alias("seq"), F.when(deleted, 0).otherwise(1).alias("vtype"), value.alias("value"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """A user's last event value; an error event deletes it."""
    events = read(spark, folder, "events")
    return change_log(events, F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("value"))


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's last order price; a finished order deletes it."""
    orders = read(spark, folder, "orders")
    return change_log(orders, F.col("o_custkey"), F.col("o_orderkey") + 1, F.col("o_orderstatus") == "F", F.col("o_totalprice"))
