"""Load and mixed workloads as tables: an operation log, and its answers as joins.

Operations are rows ``op_no, op, key_no``; a run turns the writing ones into versions and answers the
reading ones, points and scans, by as-of lookups, all in one job each. Keys follow a Zipf law by a closed form of one
random number, or stay near the newest key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerkv.operators.lookups import as_of

#: Fixed values of the workloads.
THETA, SCAN_ROWS = 0.99, 50
RUN = 4096
READ, UPDATE, INSERT, SCAN, READ_MODIFY_WRITE = "read", "update", "insert", "scan", "rmw"


@dataclass(frozen=True)
class Spec:
    name: str
    shares: tuple[tuple[str, float], ...]
    latest: bool = False


SPECS = {
    "A": Spec("A", ((READ, 0.50), (UPDATE, 0.50))),
    "B": Spec("B", ((READ, 0.95), (UPDATE, 0.05))),
    "C": Spec("C", ((READ, 1.00),)),
    "D": Spec("D", ((READ, 0.95), (INSERT, 0.05)), latest=True),
    "E": Spec("E", ((SCAN, 0.95), (INSERT, 0.05))),
    "F": Spec("F", ((READ, 0.50), (READ_MODIFY_WRITE, 0.50))),
}


def bench_key(number: Column) -> Column:
    return F.format_string("user%016d", number)


def bench_value(number: Column, size: int = 100) -> Column:
    return F.rpad(F.format_string("v%d:", number), size, "x")


def test_key(number: Column) -> Column:
    return F.format_string("key%08d", number)


def test_value(number: Column, size: int = 64) -> Column:
    return F.rpad(F.format_string("value%08d:", number), size, ".")


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """Sum of the first n inverse powers, as one aggregation."""
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-theta)))).first()[0]


def zipf(u: Column, n: int, zeta_n: float, theta: float = THETA) -> Column:
    """Rank from 0 of a uniform number, by the usual approximation of the inverse distribution."""
    two = 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - two / zeta_n)
    tail = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - eta + 1, F.lit(1 / (1 - theta))))
    return F.when(u * zeta_n < 1, 0).when(u * zeta_n < two, 1).otherwise(F.least(tail, F.lit(n - 1))).cast("long")


def pick(spec: Spec, u: Column) -> Column:
    """The operation of a uniform number, by cumulative shares; what rounding leaves over is the last one."""
    out = F.lit(spec.shares[-1][0])
    for (name, _), upper in reversed(list(zip(spec.shares[:-1], _sums(spec.shares)[:-1], strict=True))):
        out = F.when(u < upper, name).otherwise(out)
    return out


def _sums(shares) -> list[float]:
    total, out = 0.0, []
    for _, share in shares:
        total += share
        out.append(total)
    return out


def load(spark: SparkSession, n: int) -> DataFrame:
    """``ordinal, user_key, vtype, value`` of ``n`` sequential inserts."""
    ids = spark.range(n)
    return ids.select(F.col("id").alias("ordinal"), bench_key(F.col("id")).alias("user_key"), F.lit(1).alias("vtype"), bench_value(F.col("id")).alias("value"))


def operations(spark: SparkSession, spec: Spec, n_ops: int, n_keys: int, seed: int = 1) -> DataFrame:
    """``op_no, op, key_no, newest``. Inserts take new numbers after the loaded ones, in order."""
    rows = spark.range(n_ops).select(F.col("id").alias("op_no"), F.rand(seed).alias("_u"), F.rand(seed + 1).alias("_z"))
    rank = zipf(F.col("_z"), n_keys, zeta(spark, n_keys))
    return numbered_keys(rows.select("op_no", pick(spec, F.col("_u")).alias("op"), rank.alias("key_no")), n_keys, spec.latest)


def numbered_keys(ops: DataFrame, n_keys: int, latest: bool = False) -> DataFrame:
    """``op_no, op, key_no, newest``: inserts take the next free number, and with ``latest`` the key of
    other operations counts back from the newest one; ``newest`` is that key when the operation begins.

    Inserts are counted by runs of ``RUN`` operations; only the runs' counts meet in one task.
    """
    is_insert = (F.col("op") == INSERT).cast("long")
    rows = ops.withColumn("_run", F.floor(F.col("op_no") / RUN))
    runs = rows.groupBy("_run").agg(F.sum(is_insert).alias("_all"))
    runs = runs.select("_run", F.coalesce(F.sum("_all").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = F.coalesce(F.sum(is_insert).over(Window.partitionBy("_run").orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(runs, "_run").withColumn("newest", F.lit(n_keys - 1) + F.col("_earlier") + F.col("_inside"))
    key = F.greatest(F.col("newest") - F.col("key_no"), F.lit(0)) if latest else F.col("key_no")
    return rows.select("op_no", "op", F.when(F.col("op") == INSERT, F.col("newest") + 1).otherwise(key).alias("key_no"), "newest")


def versions_of(ops: DataFrame, n_keys: int) -> DataFrame:
    """``user_key, seq, vtype, value``: the load at sequences up to ``n_keys``, then each writing operation's."""
    spark = ops.sparkSession
    loaded = spark.range(n_keys).select(bench_key(F.col("id")).alias("user_key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("vtype"), bench_value(F.col("id")).alias("value"))
    written = ops.where(F.col("op").isin(UPDATE, INSERT, READ_MODIFY_WRITE)).select(bench_key(F.col("key_no")), F.col("op_no") + n_keys + 1, F.lit(1), bench_value(F.col("op_no")))
    return loaded.union(written)


def scans(ops: DataFrame, n_keys: int, rows: int = SCAN_ROWS) -> DataFrame:
    """``op_no, key, version, value``: the live rows that each scan returns, up to ``rows`` from its key on.

    Keys are numbered without gaps and never deleted, so a scan's keys follow from its first and from the
    newest one; their versions are found by one as-of join.
    """
    asked = ops.where((F.col("op") == SCAN) & (F.col("key_no") <= F.col("newest")))
    last = F.least(F.col("key_no") + (rows - 1), F.col("newest"))
    reads = asked.select("op_no", F.explode(F.sequence("key_no", last)).alias("_no"), (F.col("op_no") + n_keys).alias("at")).select("op_no", bench_key(F.col("_no")).alias("key"), "at")
    return as_of(reads, versions_of(ops, n_keys), "key", "at").drop("at")


def answers(ops: DataFrame, n_keys: int) -> DataFrame:
    """Each point read (those of read-modify-writes too) with the version and value it sees."""
    reads = ops.where(F.col("op").isin(READ, READ_MODIFY_WRITE)).select("op_no", "op", bench_key(F.col("key_no")).alias("key"), (F.col("op_no") + n_keys).alias("at"))
    return as_of(reads, versions_of(ops, n_keys), "key", "at")
