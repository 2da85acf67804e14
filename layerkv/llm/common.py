"""What several corpus operators share: table access, word patterns, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The white space that separates words, as regular expression classes and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where the session names none and all tasks run in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints")
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, which cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables below the shared checkpoint folder, for as long as an operator works.

    Later reads take only the columns they need, in as many tasks as the bytes ask for, however many
    tasks wrote them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{checkpoint_dir(spark)}/tables-{uuid.uuid4()}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables; no plan may read them any more."""
        dropped(self.spark, self.folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name on ``stem`` that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those named, which an operator reads away or puts its own in place of (names compare without case)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, also with dots; ``run`` sees and gives the real names."""
    names = df.columns
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain.names)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)
