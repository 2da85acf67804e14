import random

import pytest
from model import compact, live
from pyspark.sql import functions as F

from layerkv.operators import amplification, lookups, versions
from layerkv.schema import ENTRY


def rows(df):
    return sorted((bytes(r["user_key"]), r["seq"], r["vtype"], None if r["value"] is None else bytes(r["value"])) for r in df.collect())


def random_log(seed, n=400, keys=25):
    r = random.Random(seed)
    pool = [b"", b"\x00", b"\x00\x01", b"\xff", *(f"k{i}".encode() for i in range(keys))]
    return [(r.choice(pool), seq, t := int(r.random() < 0.7), f"v{seq}".encode() if t else None) for seq in range(1, n + 1)]


@pytest.mark.parametrize("seed", range(4))
def test_live_and_compaction_agree_with_the_model(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, ENTRY)
    for snapshot in (0, 37, 200, 400):
        assert {k: v for k, _, _, v in rows(versions.live(df, snapshot))} == live(log, snapshot)
    for smallest in (0, 150, 400):
        for bottom in (False, True):
            kept = versions.compact(df, smallest, bottom)
            assert rows(kept) == sorted(compact(log, smallest, bottom))
            for snapshot in {smallest, 300, 400} - set(range(smallest)):
                assert {k: v for k, _, _, v in rows(versions.live(kept, snapshot))} == live(log, snapshot)


def test_a_deletion_is_filtered_after_the_newest_is_chosen(spark):
    df = spark.createDataFrame([(b"k", 1, 1, b"old"), (b"k", 2, 0, None), (b"e", 3, 1, b"")], ENTRY)
    assert rows(versions.live(df)) == [(b"e", 3, 1, b"")]
    assert rows(versions.live(df, 1)) == [(b"k", 1, 1, b"old")]


def test_entry_order_is_key_up_and_sequence_down(spark):
    df = spark.createDataFrame([(b"b", 1, 1, b"x"), (b"a", 5, 1, b"x"), (b"b", 3, 1, b"x"), (b"a", 2, 1, b"x"), (b"\x80", 9, 1, b"x"), (b"\x7f", 9, 1, b"x")], ENTRY)
    assert [(bytes(r["user_key"]), r["seq"]) for r in versions.in_order(df).collect()] == [(b"a", 5), (b"a", 2), (b"b", 3), (b"b", 1), (b"\x7f", 9), (b"\x80", 9)]


def test_merge_is_a_bag_and_ranks_sources(spark):
    a, b = spark.createDataFrame([(b"k", 1, 1, b"a")], ENTRY), spark.createDataFrame([(b"k", 1, 1, b"b"), (b"j", 2, 1, b"c")], ENTRY)
    merged = versions.in_order(versions.merge([a, b])).collect()
    assert [(bytes(r["user_key"]), r["source_rank"]) for r in merged] == [(b"j", 1), (b"k", 0), (b"k", 1)]
    with pytest.raises(ValueError, match="nothing"):
        versions.merge([])


def test_seek_pages_and_multi_get(spark):
    df = spark.createDataFrame([(f"{10 * i:06d}".encode(), i + 1, 1, b"v") for i in range(1000)], ENTRY)
    first = lambda d: [bytes(r["user_key"]) for r in d.collect()]
    assert first(lookups.seek(df, b"005000", 1)) == [b"005000"]
    assert first(lookups.seek(df, b"005001", 2)) == [b"005010", b"005020"]
    assert first(lookups.seek(df, b"999999")) == []
    assert first(lookups.page_after(df, b"000010", 2)) == [b"000020", b"000030"]
    asked = spark.createDataFrame([(b"000010",), (b"zzz",), (b"000010",)], "user_key binary")
    assert sorted((bytes(r["user_key"]), r["found"]) for r in lookups.multi_get(df, asked).collect()) == [(b"000010", True), (b"zzz", False)]


def test_as_of_takes_the_newest_version_up_to_the_probe(spark):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 5, 0, None), ("a", 9, 1, "y"), ("b", 4, 1, "z")], "user_key string, seq long, vtype int, value string")
    probes = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 6), (4, "a", 9), (5, "b", 3), (6, "c", 9), (7, "b", 4)], "n int, k string, at long")
    got = {r["n"]: (r["version"], r["value"]) for r in lookups.as_of(probes, log, "k", "at").collect()}
    assert got == {1: (None, None), 2: (1, "x"), 3: (5, None), 4: (9, "y"), 5: (None, None), 6: (None, None), 7: (4, "z")}


def test_key_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(f"{i:06d}".encode(), i + 1, 1, b"v") for i in range(2000)], ENTRY).write.parquet(path)
    plan = lookups.get(spark.read.schema(ENTRY).parquet(path), b"000100")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_key" in plan


def test_amplification_counts(spark):
    df = spark.createDataFrame([(b"k", s, 1, b"v") for s in range(1, 51)] + [(b"d", 60, 0, None)], ENTRY)
    row = amplification.scan_amplification(df).first()
    assert (row["returned"], row["skipped"], row["skipped_per_row"]) == (1, 51, 51.0)
    empty = amplification.scan_amplification(spark.createDataFrame([], ENTRY)).first()
    assert (empty["returned"], empty["skipped"], empty["skipped_per_row"]) == (0, 0, 0.0)


def test_batches_are_numbered_in_order(spark):
    df = spark.createDataFrame([(2, 1, "c"), (1, 7, "b"), (1, 3, "a"), (2, 2, "d")], "batch_id int, ordinal int, name string")
    assert {r["name"]: r["seq"] for r in versions.batch_sequences(df, 10).collect()} == {"a": 10, "b": 11, "c": 12, "d": 13}


def test_newest_of_fixed_width_columns_is_a_hash_aggregation(spark):
    log = spark.createDataFrame([(k % 5, k, k % 2, k * 0.5) for k in range(50)], "user_key int, seq long, vtype int, value double")
    plan = versions.live(log)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = {tuple(r) for r in versions.newest(log, 40).collect()}
    text = versions.newest(log.withColumn("value", F.col("value").cast("string")), 40).collect()
    assert got == {(r["user_key"], r["seq"], r["vtype"], float(r["value"])) for r in text} and len(got) == 5


def test_batches_are_numbered_over_runs(spark):
    rows = spark.range(30_000).selectExpr("id * 3 % 9000 AS batch_id", "id AS ordinal")
    got = versions.batch_sequences(rows, 7).orderBy("batch_id", "ordinal").collect()
    assert [r["seq"] for r in got] == list(range(7, 30_007))
