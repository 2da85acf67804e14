"""Binary tables as DataFrames, and DataFrames as binary tables.

A table is one unit of work, as large as one file of a level: a task reads or writes whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from layerkv.functions.codec import Table, table
from layerkv.schema import VALUE


def encode_tables(entries: DataFrame, block_bytes: int = 4096, restart_interval: int = 16, bits_per_key: int = 10) -> DataFrame:
    """``path, content`` of binary tables, one for each ``path`` of ``path, user_key, seq, vtype, value``."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted(((bytes(k), int(s), int(t), bytes(v) if v is not None else b"") for k, s, t, v in zip(rows["user_key"], rows["seq"], rows["vtype"], rows["value"], strict=True)), key=lambda e: (e[0], -e[1], -e[2]))
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [table(found, block_bytes, restart_interval, bits_per_key)]})

    return entries.groupBy("path").applyInPandas(encode, "path string, content binary")


def decode_tables(tables: DataFrame) -> DataFrame:
    """All entries of tables given as ``path, content``, every block's checksum verified."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, k, s, t, v if t == VALUE else None) for k, s, t, v in Table(bytes(content)).entries()]
                yield pd.DataFrame(rows, columns=["path", "user_key", "seq", "vtype", "value"])

    return tables.mapInPandas(decode, "path string, user_key binary, seq bigint, vtype int, value binary")


def get_from_tables(tables: DataFrame, asked: DataFrame) -> DataFrame:
    """``path, user_key, at, vtype, value`` of each question ``path, user_key, at``: the newest version up to ``at`` in
    that table, null where it has none. Footer, filter and sparse index are read once for a table's questions."""

    def answer(content: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or content.empty:
            return pd.DataFrame([], columns=["path", "user_key", "at", "vtype", "value"])
        reader, rows = Table(bytes(content["content"].iloc[0])), []
        for name, key, at in zip(questions["path"], questions["user_key"], questions["at"], strict=True):
            found = reader.get(bytes(key), int(at))
            rows.append((name, bytes(key), at, None if found is None else found[0], found[1] if found and found[0] == VALUE else None))
        out = pd.DataFrame(rows, columns=["path", "user_key", "at", "vtype", "value"])
        return out.astype({"vtype": "Int32"})

    return tables.groupBy("path").cogroup(asked.groupBy("path")).applyInPandas(answer, "path string, user_key binary, at bigint, vtype int, value binary")
