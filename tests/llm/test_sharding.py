import zlib

import duckdb
from helpers import documents, folder, write

from layerkv.llm import query_sharding
from layerkv.llm.sharding import assign_shards, text_bytes, text_crc32, write_shards


def run(spark, path):
    return [tuple(r) for r in query_sharding.query(spark, path).collect()]


def test_query_agrees_with_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder()}/documents.parquet'")
    assert sorted(run(spark, folder())) == sorted(duck.sql(query_sharding.SQL).fetchall())


def test_shards_are_whole_gapless_and_even(spark, tmp_path):
    rows = [(i, None if i % 97 == 0 else "" if i % 89 == 0 else "same text" if i % 3 == 0 else "é" * (i % 50)) for i in range(2000)] + [(5, "x"), (5, "x")]
    got = run(spark, write(spark, tmp_path, documents=documents(spark, rows)))
    texts = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(r[:3] for r in got) == texts
    bytes_, slots = [0] * 40, [[] for _ in range(40)]
    for _, size, _, law, shard, slot, grown in got:
        assert law == "bytes" and grown is None
        bytes_[shard] += size
        slots[shard].append(slot)
    assert max(bytes_) - min(bytes_) <= 2 * max(r[1] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_edges(spark, tmp_path):
    empty = documents(spark, [])
    assert run(spark, write(spark, tmp_path / "a", documents=empty)) == []
    huge = documents(spark, [(1, "a" * 100_000), (2, "b"), (None, "c")])
    got = run(spark, write(spark, tmp_path / "b", documents=huge))
    assert len(got) == 3 and {r[0] for r in got} == {1, 2, None}
    clash = documents(spark, [(1, "a"), (2, "b")]).selectExpr("doc_id", "text", "1 AS _part", "2 AS SIZE_", "3 AS `a.b`")
    out = assign_shards(clash, text_bytes(), {"crc": text_crc32(), "doc_id": clash["doc_id"]}, 2, keep=("_part", "a.b"))
    assert sorted((r["_part"], r["a.b"], r["shard"]) for r in out.collect()) == [(1, 3, 0), (1, 3, 1)]


def test_written_shards_round_trip(spark, tmp_path):
    rows = [(i, "t" * (i % 40)) for i in range(300)]
    docs = documents(spark, rows)
    write_shards(docs, text_bytes(), {"doc_id": docs["doc_id"]}, 5, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).orderBy("shard", "slot").collect()
    assert [(r["doc_id"], r["text"]) for r in back] == rows
