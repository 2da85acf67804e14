"""How much a store reads and writes for what it is asked: ratios, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerkv.schema import VALUE

#: Bytes of a log record beside the user's: header and batch header, and for each entry.
RECORD_BYTES, ENTRY_BYTES = 20, 5


def ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def cache_hit_rate(hits: Column, misses: Column) -> Column:
    return ratio(hits, hits + misses)


def log_bytes(user_bytes: Column, entries: Column) -> Column:
    """Bytes counted as written to the log for one batch."""
    return user_bytes + RECORD_BYTES + ENTRY_BYTES * entries


def write_amplification(log: Column, flushed: Column, compacted: Column, user: Column) -> Column:
    return ratio(log + flushed + compacted, user)


def scan_amplification(log: DataFrame, snapshot: int | None = None, key: str = "user_key") -> DataFrame:
    """One row: live rows a full scan returns, stored entries it steps over (each live row among them), and their ratio."""
    seen = F.col("seq") <= snapshot if snapshot is not None else F.lit(True)
    by_key = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max_by("vtype", F.when(seen, F.col("seq"))).alias("_newest"))
    sums = by_key.agg(F.count(F.when(F.col("_newest") == VALUE, 1)).alias("returned"), F.coalesce(F.sum("_n"), F.lit(0)).alias("skipped"))
    return sums.select("returned", "skipped", ratio(F.col("skipped"), F.col("returned")).alias("skipped_per_row"))


def percentiles(samples: DataFrame, value: str, points: dict[str, float], group: str | None = None) -> DataFrame:
    """Nearest-rank percentiles: the sample at place ``floor(p n)`` of the sorted ones, the last at most.

    Values are counted first, so equal samples are one row however many there are, and the window runs over distinct values.
    """
    keys = [group] if group else []
    counted = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    running = by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select(*keys, value, F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(by).alias("_all"))
    at = {name: F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1) for name, p in points.items()}
    picked = [F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in at.items()]
    return (ranked.groupBy(*keys) if keys else ranked.groupBy()).agg(*picked, F.max(value).alias("max"))
