"""Files and levels: budgets, overlaps, choice of compactions. Small tables of files, one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerkv.schema import LEVEL_GROWTH, LEVELS


def max_bytes(level: Column | int, base: int) -> Column:
    """Budget of a level: the base for levels 0 and 1, ten times more for each level below."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.lit(base) * F.pow(F.lit(LEVEL_GROWTH), F.greatest(level - 1, F.lit(0))).cast("long")


def overlapping(files: DataFrame, low: Column, high: Column, smallest: str = "smallest", largest: str = "largest") -> DataFrame:
    """Files whose key range meets ``[low, high]``, both ends inclusive."""
    return files.where((F.col(largest) >= low) & (F.col(smallest) <= high))


def range_join(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of ``(number, smallest, largest)`` files of two levels whose ranges meet. Both sides are rows of a manifest."""
    a = inputs.select(F.col("number").alias("input"), F.col("smallest").alias("_lo"), F.col("largest").alias("_hi"))
    return a.join(files, (F.col("largest") >= F.col("_lo")) & (F.col("smallest") <= F.col("_hi"))).select("input", "number")


def level_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def level_summary(files: DataFrame) -> DataFrame:
    """Files and whole KiB of the levels that have files."""
    totals = level_totals(files)
    return totals.select("level", "files", F.floor(F.col("bytes") / 1024).alias("kib"), F.format_string("L%d: %d files, %d KiB", "level", "files", F.floor(F.col("bytes") / 1024)).alias("summary"))


def compaction_scores(files: DataFrame, l0_trigger: int, base: int) -> DataFrame:
    """``level, score``: files by the trigger for level 0, bytes by budget for the levels below that have one below them."""
    totals = level_totals(files).where(F.col("level") < LEVELS - 1)
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(l0_trigger)).otherwise(F.col("bytes") / max_bytes(F.col("level"), base))
    return totals.select("level", score.alias("score"), F.when(F.col("level") == 0, F.col("files") >= l0_trigger).otherwise(F.col("bytes") > max_bytes(F.col("level"), base)).alias("due"))


def obsolete(listing: DataFrame, live: DataFrame, key: str = "number") -> DataFrame:
    """Listed files that no live version names."""
    return listing.join(live.select(key), key, "left_anti")
