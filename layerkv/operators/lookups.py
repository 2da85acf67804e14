"""Reads by key: point and set lookups, ordered seeks and pages, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerkv.operators.versions import live, newest, visible
from layerkv.schema import VALUE


def get(log: DataFrame, key, snapshot: int | None = None, name: str = "user_key") -> DataFrame:
    """The live row of one key, or none. The equality reaches every scan below the aggregation."""
    return live(log.where(F.col(name) == F.lit(key)), snapshot, name)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None, name: str = "user_key") -> DataFrame:
    """``name, found, value`` for each asked key (repeats answer once).

    The log is cut to the asked keys before its versions are resolved; Spark picks the join from the
    sizes it finds, so few keys are broadcast and many are shuffled.
    """
    asked = keys.select(name).distinct()
    some = live(log.join(asked, name, "left_semi"), snapshot, name).select(name, "value", F.lit(True).alias("_live"))
    return asked.join(some, name, "left").select(name, F.coalesce("_live", F.lit(False)).alias("found"), "value")


def seek(log: DataFrame, target, limit: int | None = None, snapshot: int | None = None, name: str = "user_key") -> DataFrame:
    """Live rows from the first key at or after ``target`` on, in key order."""
    rows = live(log.where(F.col(name) >= F.lit(target)), snapshot, name).orderBy(name)
    return rows if limit is None else rows.limit(limit)


def page_after(log: DataFrame, last, limit: int, snapshot: int | None = None, name: str = "user_key") -> DataFrame:
    """The next page of live rows after key ``last``."""
    return live(log.where(F.col(name) > F.lit(last)), snapshot, name).orderBy(name).limit(limit)


def as_of(probes: DataFrame, log: DataFrame, on: str, probe_seq: str, log_key: str = "user_key") -> DataFrame:
    """Each probe with the value its key had at the probe's sequence, null if absent or deleted.

    Probes and entries are put in one sequence for each key and the newest entry before a probe is
    carried forward, so the work is one sort by key and no entry is paired with every probe.
    """
    probe_columns = [F.col(c) for c in probes.columns]
    entry = F.struct("seq", "vtype", "value")
    a = log.select(F.col(log_key).alias("_k"), F.col("seq").alias("_s"), F.lit(0).alias("_side"), entry.alias("_entry"), F.lit(None).cast(probes.select(F.struct(*probe_columns)).schema[0].dataType).alias("_probe"))
    b = probes.select(F.col(on).alias("_k"), F.col(probe_seq).alias("_s"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_entry"].dataType).alias("_entry"), F.struct(*probe_columns).alias("_probe"))
    carried = F.last("_entry", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = a.unionByName(b).withColumn("_entry", carried).where("_side = 1")
    value = F.when(F.col("_entry.vtype") == VALUE, F.col("_entry.value"))
    return seen.select("_probe.*", F.col("_entry.seq").alias("version"), value.alias("value"))


def layered_get(layers: list[DataFrame], key, snapshot: int | None = None, name: str = "user_key") -> DataFrame:
    """A point read over layers in any order: newer layers hold larger sequences, so one newest choice over all equals
    asking them one by one."""
    found = None
    for layer in layers:
        part = visible(layer.where(F.col(name) == F.lit(key)), snapshot)
        found = part if found is None else found.unionByName(part)
    return newest(found, None, name).where(F.col("vtype") == VALUE)
