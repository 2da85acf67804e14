"""Binary logs as DataFrames, and DataFrames as binary logs.

A log file is one unit of work: it holds at most what a memory table did, so a task reads whole files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from layerkv.functions.codec import Entry, log_header, log_record, read_log
from layerkv.schema import Corruption

LOG_ENTRIES = "path string, base_seq bigint, ordinal int, user_key binary, seq bigint, vtype int, value binary, torn boolean"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all logs at ``path`` (a file, folder or glob).

    A torn tail ends its log. Damage that isn't at a log's end can't be told from a torn tail here, so
    callers that know the logs' order should accept ``torn`` for the last log only.
    """

    return decode_logs(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode_logs(logs: DataFrame) -> DataFrame:
    """Entries of logs given as ``path, content``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    entries, torn = read_log(bytes(content))
                except Corruption as e:
                    raise Corruption(f"{name}: {e}") from e
                yield pd.DataFrame(
                    [(name, base, k, key, base + k, vtype, value, torn) for base, k, vtype, key, value in entries],
                    columns=["path", "base_seq", "ordinal", "user_key", "seq", "vtype", "value", "torn"],
                )

    return logs.mapInPandas(decode, LOG_ENTRIES)


def encode_logs(entries: DataFrame) -> DataFrame:
    """``path, content`` of binary logs, one for each ``path`` of ``path, base_seq, ordinal, vtype, user_key, value``; a batch is the entries of one ``base_seq``."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["base_seq", "ordinal"])
        batches = [(int(base), [(int(t), bytes(k), bytes(v) if v is not None else b"") for t, k, v in zip(b["vtype"], b["user_key"], b["value"], strict=True)]) for base, b in rows.groupby("base_seq", sort=True)]
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [encode_log(batches)]})

    return entries.groupBy("path").applyInPandas(encode, "path string, content binary")


def encode_log(batches: list[tuple[int, list[Entry]]]) -> bytes:
    """A whole log of (base sequence, entries) batches."""
    return log_header() + b"".join(log_record(seq, entries) for seq, entries in batches)
