"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are range-partitioned on a total order; each partition is summed on its own, the partition
totals (one row per partition) become offsets, and offset plus running sum is the global prefix
sum of every row. Shard ``s`` of ``n`` is what lies between ``s/n`` and ``(s+1)/n`` of all bytes,
so shards are runs of the order. No group of rows has to meet in one task: a value that fills a
third of the table is spread by the later order columns.

Defined results
- A null size counts as 0; a negative size is an error of the caller and counts as 0 too.
- A row belongs to the shard that holds its middle byte, so shards differ by one row's size at
  most; a row larger than a shard leaves neighbouring shards empty.
- Equal order keys are taken in any order; such rows are interchangeable if the order columns
  determine the size. Any number of them is spread over tasks, by the place where they are read.
- An empty table gives an empty result. Other columns are dropped unless named in ``keep``;
  one named like a column of the result is dropped in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerkv.llm.common import col, free_name, materialize, shuffle_partitions


def assign_shards(
    df: DataFrame, size: Column, order: dict[str, Column], n_shards: int, keep: tuple[str, ...] = (), shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """``keep``, the order columns, ``size``, ``byte_start``, ``shard`` and ``slot`` of each row.

    ``order`` names the columns of the total order. ``slot`` counts a shard's rows from 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    names = [*order]
    own = {n.lower() for n in (*order, "size", "byte_start", shard, slot, "_bytes_before", "_rows_before", "_total", "_row", "_sum", "_at", "_first")}
    part = free_name(df, "_part")
    rows = df.select(
        *[col(c) for c in keep if c.lower() not in own], *[e.alias(n) for n, e in order.items()], F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size")
    )
    parts = shuffle_partitions(df.sparkSession)
    # The order is cut at sampled bounds. Writing it down makes every later read see the same cut.
    tie = free_name(rows, "_tie")
    rows = rows.withColumn(tie, F.monotonically_increasing_id())
    rows = materialize(rows.repartitionByRange(parts, *[col(n) for n in names], tie).withColumn(part, F.spark_partition_id()).drop(tie))

    totals = rows.groupBy(part).agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(
        part, F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy(part).orderBy(*[col(n) for n in names])
    placed = (
        rows.withColumns({"_row": F.row_number().over(inside), "_sum": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        .join(F.broadcast(offsets), part)
        .withColumns({"byte_start": F.col("_bytes_before") + F.col("_sum") - F.col("size"), "_at": F.col("_rows_before") + F.col("_row") - 1})
    )
    middle = F.expr(f"(2 * byte_start + size) * {n_shards} div greatest(2 * _total, 1)")
    placed = placed.withColumn(shard, F.least(middle, F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy(shard).agg(F.min("_at").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), shard).withColumn(slot, F.col("_at") - F.col("_first")).drop(part, "_row", "_sum", "_bytes_before", "_rows_before", "_total", "_at", "_first")


def write_shards(df: DataFrame, size: Column, order: dict[str, Column], n_shards: int, path: str) -> None:
    """Write whole rows to ``path/shard=N``, each shard's rows in slot order."""
    out = assign_shards(df, size, order, n_shards, keep=tuple(df.columns))
    out.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (none if null), plus 16 for the row."""
    return F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + 16


def text_md5(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(col(text), F.lit("")).cast("binary")))


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(col(text), F.lit("")).cast("binary"))
