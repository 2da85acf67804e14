"""op1: all documents in 40 contiguous shards of nearly equal bytes, equal texts side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerkv.llm.common import table
from layerkv.llm.sharding import assign_shards, text_bytes, text_crc32, text_md5

NAME = "op1_sharding"
SHARDS = 40


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = {"text_crc32": text_crc32(), "text_md5": text_md5(), "doc_id": F.col("doc_id")}
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), text_bytes(), order, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its usual table of 256, which is computed from the polynomial.
CRC_TABLE = """
crc_steps AS (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n)
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps)
"""
CRC = """xor(list_reduce(
  list_prepend(4294967295, list_transform(range(octet_length(encode(txt))), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

SQL = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(text, '') AS txt, hex(encode(coalesce(text, ''))) AS hexed FROM documents
), sized AS (
  SELECT doc_id, digest, (octet_length(encode(txt)) + 16)::BIGINT AS size, {CRC} AS text_crc32 FROM docs, crc_table
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY text_crc32, digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS byte_start, sum(size) OVER () AS total FROM sized
), placed AS (
  SELECT *, least((2 * byte_start + size) * {SHARDS} // greatest(2 * total, 1), {SHARDS - 1})::INTEGER AS shard FROM summed
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY text_crc32, digest, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
