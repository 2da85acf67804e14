import random
import threading
import time

import pytest
from model import live
from pyspark.sql import functions as F

from layerkv.plans.batch import WriteBatch
from layerkv.plans.manifest import decode, encode
from layerkv.plans.options import EVERY_WRITE, INTERVAL, NEVER, Options, WriteOptions, compaction_level, group_size, level_budget, should_publish
from layerkv.plans.store import Store
from layerkv.schema import Corruption, InvalidArgument, NotFound, StoreError
from layerkv.streaming.ingest import ingest

SMALL = Options(background_compaction=False, l0_compaction_trigger=3, max_bytes_for_level_base=6000, target_file_size=3000)


def content(store, snapshot=None):
    return {bytes(r["user_key"]): bytes(r["value"]) for r in store.df(snapshot).collect()}


def test_reads_never_change_under_flush_and_compaction(spark, tmp_path):
    store, log, r = Store.open(spark, str(tmp_path / "s"), SMALL), [], random.Random(2)
    pinned, seq = [], 0
    for turn in range(6):
        batch = WriteBatch()
        for _ in range(60):
            key, seq = b"key%04d" % r.randrange(80), seq + 1
            if r.random() < 0.3:
                batch.delete(key)
                log.append((key, seq, 0, None))
            else:
                batch.put(key, b"v%d" % seq)
                log.append((key, seq, 1, b"v%d" % seq))
        store.write(batch)
        if turn in (1, 3):
            pinned.append(store.snapshot())
        store.flush()
        store.maintain()
    assert store.counts["compactions"] > 0 and store.counts["flush_versions_dropped"] > 0
    assert content(store) == live(log, seq)
    for taken in pinned:
        assert content(store, taken) == live(log, taken.sequence)
    assert store.smallest_snapshot() == pinned[0].sequence
    for taken in [*pinned, None]:
        store.release(taken)
    store.compact_all()
    for a, b in zip(store.version.level(1), store.version.level(1)[1:]):  # noqa: B905
        assert a.largest < b.smallest
    assert content(store) == live(log, seq) and store.last_sequence == seq
    store.remove_obsolete()
    again = Store.open(spark, str(tmp_path / "s"), SMALL)
    assert content(again) == live(log, seq) and again.last_sequence == seq
    assert [k for k, _ in again.iterate("key0040")] == sorted(k for k in live(log, seq) if k >= b"key0040")


def test_points_batches_and_empty_keys(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        odd = b"\x00\x01\xffmid\x00"
        store.write(WriteBatch().put(odd, b"").put(b"", b"empty").put("k", "1").put("k", "2").put("k", "3").put("x", "1").delete("x"))
        assert store.get(odd) == b"" and store.get(b"") == b"empty" and store.get("k") == b"3" and store.get("x") is None and store.get("y") is None
        before = store.snapshot()
        store.delete("k")
        assert store.get("k") is None and store.get("k", before) == b"3"
        assert store.multi_get(["k", odd, "nope"]) == {odd: b""}
        assert store.flush() and not store.flush()
        assert store.get("k", before) == b"3"


def test_unpublished_writes_are_read_and_kept_by_close(spark, tmp_path):
    options = Options(background_compaction=False, sync_policy=NEVER)
    store = Store.open(spark, str(tmp_path / "s"), options)
    store.put("a", "1")
    store.delete("a")
    store.put("b", "2")
    assert store.counts["publishes"] == 1 and store.get("a") is None and store.get("b") == b"2" and content(store) == {b"b": b"2"}
    store.write(WriteBatch().put("c", "3"), WriteOptions(sync=True, use_default_policy=False))
    assert len(store.version.segments) == 1
    store.put("d", "4")
    store.close()
    assert content(Store.open(spark, str(tmp_path / "s"), options)) == {b"b": b"2", b"c": b"3", b"d": b"4"}


def test_opening(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(NotFound):
        Store.open(spark, path, Options(create_if_missing=False))
    Store.open(spark, path).put("a", "1")
    with pytest.raises(InvalidArgument):
        Store.open(spark, path, Options(error_if_exists=True))
    manifest = sorted((tmp_path / "s" / "manifests").glob("*.json"))[-1]
    data = bytearray(manifest.read_bytes())
    data[33] ^= 1
    manifest.write_bytes(bytes(data))
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Corruption):
        Store.open(spark, path)


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), SMALL)
    store.put("a", "1")

    def fail(_):
        raise OSError("full")

    store.before_publish = fail
    with pytest.raises(OSError, match="full"):
        store.put("a", "2")
    store.before_publish = None
    with pytest.raises(StoreError):
        store.put("a", "3")
    assert content(Store.open(spark, str(tmp_path / "s"), SMALL)) == {b"a": b"1"}


def test_two_writers_cannot_both_commit(spark, tmp_path):
    first = Store.open(spark, str(tmp_path / "s"), SMALL)
    second = Store.open(spark, str(tmp_path / "s"), SMALL)
    first.put("a", "1")
    with pytest.raises(StoreError):
        second.put("a", "2")
    assert content(Store.open(spark, str(tmp_path / "s"), SMALL)) == {b"a": b"1"}


def test_frames_and_streams_are_applied_once(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), SMALL)
    frame = spark.range(1000).select(F.col("id").alias("ordinal"), F.format_string("k%03d", F.col("id") % 100).alias("user_key"), F.lit(1).alias("vtype"), F.col("id").cast("string").alias("value"))
    assert store.write_frame(frame) == 1000 and store.get("k007") == b"907"
    with pytest.raises(InvalidArgument):
        store.write_frame(frame.withColumn("ordinal", F.col("ordinal") + 1))
    assert store.write_frame(frame.limit(0)) == 0
    source = str(tmp_path / "in")
    frame.withColumn("ts", F.col("ordinal")).drop("ordinal").withColumn("value", F.concat(F.lit("s"), "value")).repartition(3).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("user_key string, vtype int, value string, ts long").parquet(source)
        ingest(stream, store, "in", str(tmp_path / "check")).awaitTermination()
    assert store.get("k007") == b"s907" and store.version.streams == {"in": 0} and store.last_sequence == 2000
    assert store.write_frame(frame, "in", 0) == 0


def test_decisions():
    assert [level_budget(k, 10) for k in (1, 2, 3)] == [10, 100, 1000]
    o = Options(l0_compaction_trigger=4, max_bytes_for_level_base=100)
    assert compaction_level({0: 3}, {1: 100, 2: 1000}, o) is None
    assert compaction_level({0: 4}, {1: 500}, o) == 0
    assert compaction_level({0: 0}, {1: 150, 2: 3000}, o) == 2
    assert compaction_level({}, {6: 1 << 60}, o) is None
    assert group_size([10, 20, 200_000], [False] * 3) == 2 and group_size([10, 20], [False, True]) == 1 and group_size([10, 20], [True, True]) == 2
    assert group_size([200_000, 800_000, 100_000], [False] * 3) == 2 and group_size([], []) == 0
    assert should_publish(Options(sync_policy=EVERY_WRITE), WriteOptions(False, False), 0)
    assert not should_publish(Options(sync_policy=NEVER), WriteOptions(True, True), 9e9)
    assert should_publish(Options(sync_policy=INTERVAL), WriteOptions(), 1000) and not should_publish(Options(sync_policy=INTERVAL), WriteOptions(), 999)


def test_manifests_round_trip(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), SMALL)
    store.put("a", "1")
    store.flush()
    assert decode(encode(store.version)) == store.version and store.level_summary().startswith("L0:1(")
    assert store.stats().first()["writes"] == 1 and store.files().count() == 1


def test_writers_share_commits_and_lose_nothing(spark, tmp_path):
    store, n = Store.open(spark, str(tmp_path / "s"), Options(background_compaction=False)), 12
    failed = []

    def work(k):
        try:
            store.write(WriteBatch().put(f"k{k:02d}", str(k)).put("shared", str(k)))
        except Exception as e:
            failed.append(e)

    with store._turn:  # all of them wait before the first may go on
        threads = [threading.Thread(target=work, args=(k,)) for k in range(n)]
        for t in threads:
            t.start()
        while len(store._queue) < n:
            time.sleep(0.01)
    for t in threads:
        t.join()
    assert not failed and store.counts["writes_grouped"] == n and store.counts["write_groups"] == 1 and store.last_sequence == 2 * n
    rows = store.log().collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 2 * n + 1))
    by_seq = {r["seq"]: (bytes(r["user_key"]), bytes(r["value"])) for r in rows}
    for s in range(1, 2 * n, 2):  # a batch is never torn apart
        assert by_seq[s][0] == b"k%02d" % int(by_seq[s][1]) and by_seq[s + 1] == (b"shared", by_seq[s][1])
    assert store.get("shared") == by_seq[2 * n][1]


@pytest.mark.parametrize("background", [False, True])
def test_the_tail_is_bounded_in_either_mode(spark, tmp_path, background):
    options = Options(background_compaction=background, memtable_size_bytes=2000, l0_compaction_trigger=2)
    with Store.open(spark, str(tmp_path / "s"), options) as store:
        for k in range(6):
            store.put(f"k{k}", "x" * 900)
        assert store.counts["flushes"] >= 2 and store._tail_bytes() <= 2000 and (store.counts["compactions"] > 0) == background
        assert len(content(store)) == 6


def test_scans_count_what_they_step_over(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        for _ in range(10):
            batch = WriteBatch()
            for k in range(10):
                batch.put(f"k{k}", "v")
            store.write(batch)
        assert len(list(store.iterate())) == 10 and store.counts["scan_entries_skipped"] == 90
        cursor = store.iterate("k3")
        next(cursor), next(cursor)
        cursor.close()
        assert (store.counts["scan_entries_returned"], store.counts["scan_entries_skipped"]) == (12, 90 + 18)
        store.flush()
        list(store.iterate())
        assert store.counts["scan_entries_skipped"] == 108


def test_damaged_pages_are_noticed(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), SMALL)
    batch = WriteBatch()
    for k in range(500):
        batch.put(f"key{k:05d}", f"{k * 7919 % 10007:05d}" * 20)
    store.write(batch)
    store.flush()
    file = tmp_path / "s" / store.version.files[0].path
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 0xFF
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        store.df().collect()


def test_a_large_tail_is_flushed_by_several_tasks(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(background_compaction=False, memtable_size_bytes=100_000, l0_compaction_trigger=3))
    frame = spark.range(20_000).selectExpr("id AS ordinal", "cast(format_string('k%06d', id) AS binary) AS user_key", "1 AS vtype", "cast(cast(id * 7919 AS string) AS binary) AS value")
    store.write_frame(frame)
    store.flush()
    files = store.version.level(0)
    assert len(files) > 1 and sum(f.rows for f in files) == 20_000 and store.pick_level() is None
    ranges = sorted((f.smallest, f.largest) for f in files)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and store.df().count() == 20_000


def read_files(rows):
    return len({f.rpartition("/")[2] for f in rows.inputFiles()})


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_compacted_store_is_read_as_it_is(spark, tmp_path):
    options = Options(background_compaction=False, l0_compaction_trigger=1, memtable_size_bytes=1 << 30, target_file_size=2000)
    store = Store.open(spark, str(tmp_path / "s"), options)
    numbers = spark.range(2000).select(F.col("id").alias("ordinal"), F.format_string("key%06d", F.col("id")).alias("user_key"), F.lit(1).alias("vtype"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    store.write_frame(numbers)
    store.compact_all()
    assert len(store.version.files) > 5 and all(f.unique and not f.deletions and f.last <= 2000 for f in store.version.files)
    assert sum(f.rows for f in store.version.files) == 2000 and "Exchange" not in plan(store.df()) and "Aggregate" not in plan(store.df())
    page = store.scan("key000700", 10)
    assert [bytes(r["user_key"]) for r in page.collect()] == [b"key%06d" % k for k in range(700, 710)]
    assert read_files(page) <= 2 < read_files(store.scan("key000700"))
    few, many = [b"key%06d" % k for k in (3, 4, 1990)], [b"key%06d" % k for k in range(0, 400, 9)]
    assert read_files(store._asked(few)) == 2 and read_files(store._asked(many)) < len(store.version.files)
    assert sorted(store.multi_get([*few, "nope"])) == few and sorted(store.multi_get([*many, "nope"])) == many
    # a tail: its deletions are reckoned with, and only files it meets are resolved
    batch = WriteBatch()
    for k in range(695, 705):
        batch.delete("key%06d" % k)
    store.write(batch.put("key000700x", "new"))
    assert [bytes(r["user_key"]) for r in store.scan("key000700", 3).collect()] == [b"key000700x", b"key000705", b"key000706"]
    assert read_files(store.scan("key000700", 3)) <= 4 and "Union" in plan(store.df())
    assert store.df().count() == 1991 and [k for k, _ in store.iterate("key001990")] == [b"key%06d" % k for k in range(1990, 2000)]
    assert len(list(store.iterate())) == 1991


def test_scans_with_limits_equal_a_model(spark, tmp_path):
    options = Options(background_compaction=False, l0_compaction_trigger=2, memtable_size_bytes=1 << 30, target_file_size=1500, sync_policy=NEVER)
    store, log, r, pinned, seq = Store.open(spark, str(tmp_path / "s"), options), [], random.Random(8), None, 0
    for turn in range(5):
        batch = WriteBatch()
        for _ in range(250):
            key, seq = b"k%04d" % r.randrange(300), seq + 1
            gone = r.random() < (0.1, 0.1, 0.9, 0.1, 0.5)[turn]
            batch.delete(key) if gone else batch.put(key, b"v%d" % seq)
            log.append((key, seq, 0 if gone else 1, None if gone else b"v%d" % seq))
        store.write(batch)
        if turn == 2:
            pinned = store.snapshot()
        if turn < 4:
            store.flush()
            store.maintain()
        for taken in {None, pinned}:
            rows = sorted(live(log, taken.sequence if taken else seq).items())
            for start, limit in ((None, 1), (b"k0100", 5), (b"k0290", 40), (b"z", 3), (None, 1000)):
                asked = [(bytes(x["user_key"]), bytes(x["value"])) for x in store.scan(start, limit, taken).collect()]
                assert asked == [x for x in rows if x[0] >= (start or b"")][:limit]
            assert list(store.iterate(b"k0123", taken)) == [x for x in rows if x[0] >= b"k0123"]


def test_a_level_is_searched_by_halves():
    from layerkv.plans.manifest import File, Version

    files = [File(level, level * 100 + k, f"tables/{level}/{k}", 5, 10, 0, 9, True, f"{4 * k:02x}", f"{4 * k + 2:02x}") for level in (0, 1, 3) for k in range(10)]
    version = Version(files=tuple(files))
    for low in (None, "00", "03", "0a", "7f"):
        for high in (None, "00", "03", "0b", "7f"):
            found = {f.number for f in version.between(low, high)}
            assert found == {f.number for f in files if (low is None or f.largest >= low) and (high is None or f.smallest <= high)}


def test_files_that_meet_nothing_below_are_moved(spark, tmp_path):
    options = Options(background_compaction=False, memtable_size_bytes=1 << 30)
    store = Store.open(spark, str(tmp_path / "s"), options)
    store.write(WriteBatch().put("a", "1").put("b", "2"))
    store.flush()
    store.compact_level(0)
    (before,) = store.version.files
    store.compact_level(1)
    (after,) = store.version.files
    assert (after.path, after.level, before.level) == (before.path, 2, 1) and store.counts["files_moved"] == 1
    store.write(WriteBatch().put("c", "3").delete("d").delete("x"))
    store.flush()
    store.compact_level(0)
    store.compact_level(1)  # the bottom is below, and nothing of this file's range: moved, if it weren't for its deletions
    assert store.counts["files_moved"] == 1 and [(f.level, f.rows, f.deletions) for f in store.version.files] == [(2, 2, 0), (2, 1, 0)]
    assert not [n for n in store.remove_obsolete() if n == after.path.rpartition("/")[0]] and content(store) == {b"a": b"1", b"b": b"2", b"c": b"3"}
    again = Store.open(spark, str(tmp_path / "s"), options)
    assert content(again) == content(store) and again.level_summary() == store.level_summary()
