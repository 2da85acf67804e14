"""Which versions of a key are seen, kept and dropped.

Every operator takes a change log with ``key``, ``seq`` and ``vtype`` columns (any others ride
along) and is one aggregation or one window on the key, so filters on the key reach the scan and partial
aggregation happens before the shuffle. The newest version is a hash aggregation where all columns beside
the key have a fixed width; a string or binary value can't be kept in a hash table's buffer, so there
Spark sorts the rows by key instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from layerkv.schema import DELETION, VALUE

RUN = 4096
FIXED_WIDTH = (BooleanType, DateType, NumericType, TimestampNTZType, TimestampType)


def visible(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """Entries that a reader at ``snapshot`` may see; all of them without one."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None, key: str = "user_key") -> DataFrame:
    """The newest visible entry of each key, deletions included."""
    rest = [c for c in log.columns if c != key]
    if all(isinstance(log.schema[c].dataType, FIXED_WIDTH) for c in rest):
        each = [F.max("seq").alias("seq") if c == "seq" else F.max_by(c, "seq").alias(c) for c in rest]
        return visible(log, snapshot).groupBy(key).agg(*each).select(log.columns)
    best = visible(log, snapshot).groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_newest"))
    return best.select(key, "_newest.*").select(log.columns)


def live(log: DataFrame, snapshot: int | None = None, key: str = "user_key") -> DataFrame:
    """The newest visible entry of each key that isn't deleted.

    Deletions are filtered after the newest entry is chosen; before, they would bring older values back.
    """
    return newest(log, snapshot, key).where(F.col("vtype") == VALUE)


def scan(log: DataFrame, snapshot: int | None = None, key: str = "user_key") -> DataFrame:
    """Live keys and values in key order."""
    return live(log, snapshot, key).select(key, "value").orderBy(key)


def with_newer(log: DataFrame, key: str = "user_key") -> DataFrame:
    """Adds ``newer``: the sequence of the key's next newer version, null for its newest."""
    return log.withColumn("newer", F.lag("seq").over(Window.partitionBy(key).orderBy(F.desc("seq"), F.desc("vtype"))))


def collapse(log: DataFrame, smallest_snapshot: int | Column, key: str = "user_key") -> DataFrame:
    """The versions that some reader can still need: those whose next newer version isn't visible to every snapshot."""
    return with_newer(log, key).where(F.col("newer").isNull() | (F.col("newer") > smallest_snapshot)).drop("newer")


def drop_tombstones(log: DataFrame, smallest_snapshot: int | Column, bottom_most: bool) -> DataFrame:
    """Without the deletions that hide nothing: those at the bottom that every snapshot sees."""
    if not bottom_most:
        return log
    return log.where((F.col("vtype") != DELETION) | (F.col("seq") > smallest_snapshot))


def compact(log: DataFrame, smallest_snapshot: int | Column, bottom_most: bool, key: str = "user_key") -> DataFrame:
    return drop_tombstones(collapse(log, smallest_snapshot, key), smallest_snapshot, bottom_most)


def merge(sources: list[DataFrame], key: str = "user_key") -> DataFrame:
    """All entries of sources given newest first, with ``source_rank``: a bag, exact duplicates stay.

    Order by key, then ``seq`` and ``vtype`` descending, then rank, to read it as one sorted run.
    """
    if not sources:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)])


def in_order(entries: DataFrame, key: str = "user_key") -> DataFrame:
    """Key ascending, newer versions first."""
    return entries.orderBy(F.asc(key), F.desc("seq"), F.desc("vtype"), *(["source_rank"] if "source_rank" in entries.columns else []))


def smallest_snapshot(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: the least of the last sequence and all live snapshots' (column ``seq`` in both)."""
    last = log.agg(F.max("seq").alias("seq"))
    return last.unionByName(snapshots.agg(F.min("seq").alias("seq"))).agg(F.min("seq").alias("smallest_snapshot"))


def _run_of(batches: DataFrame, batch: str) -> Column:
    kind = batches.schema[batch].dataType
    if isinstance(kind, DateType):
        return F.floor(F.unix_date(batch) / RUN)
    return F.floor(F.col(batch) / RUN) if isinstance(kind, NumericType) else F.lit(0)


def batch_sequences(batches: DataFrame, base: int, batch: str = "batch_id", ordinal: str = "ordinal") -> DataFrame:
    """Consecutive sequence numbers from ``base`` on, by batch (a number or a date; other
    types are one run) and by place in it.

    Batches are counted on their own first, so a batch's rows are numbered without the other batches'; the
    counts are summed by runs of ``RUN`` batch numbers, and only the sums of runs meet in one task.
    """
    sizes = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", _run_of(batches, batch))
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_all"))
    runs = runs.select("_run", F.coalesce(F.sum("_all").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_run").orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("_inside", inside).join(runs, "_run").select(batch, (F.col("_earlier") + F.col("_inside")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(batch).orderBy(ordinal)) - 1
    return batches.withColumn("_place", place).join(before, batch).withColumn("seq", F.lit(base) + F.col("_before") + F.col("_place")).drop("_place", "_before")
