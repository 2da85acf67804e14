"""A stream of changes into a store, each micro-batch as one atomic batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layerkv.plans.store import Store


def numbered(changes: DataFrame, order: str, folder: str) -> DataFrame:
    """Adds ``ordinal``: places from 0 by ``order``, ties by key and value.

    Rows are range-partitioned and counted by partition, and only the counts meet in one place. The ranges are
    sampled, so the partitioned rows are written to ``folder`` first, which all executors share: every
    later read, also after a lost executor, sees the same ranges.
    """
    columns = [c for c in changes.columns if c != "ordinal"]
    names = list(dict.fromkeys([order, "user_key", "vtype", "value"]))
    ranged = changes.select(*columns).repartitionByRange(*names).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(folder)
    placed = changes.sparkSession.read.schema(ranged.schema).parquet(folder)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return placed.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("_start") + place - 1).drop("_part", "_n", "_start")


def apply_ordered(store: Store, changes: DataFrame, order: str, stream: str | None = None, batch_id: int = 0) -> int:
    """Apply ``user_key, vtype, value`` by the order column as one batch; returns its rows."""
    folder = store.folder.scratch()
    try:
        return store.write_frame(numbered(changes, order, folder).select("ordinal", "user_key", "vtype", "value"), stream, batch_id, gapless=True)
    finally:
        store.folder.delete(folder.removeprefix(f"{store.folder.path}/"))


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, order: str = "ts", **trigger) -> StreamingQuery:
    """Apply ``user_key, vtype, value`` and the order column of a stream. Replayed micro-batches are left out, so each counts once."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_ordered(store, batch, order, name, batch_id)

    return stream.writeStream.queryName(name).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
