import random

import pytest
from pyspark.sql import functions as F

from layerkv.functions import codec, columns
from layerkv.schema import Corruption, InvalidArgument
from layerkv.sources.logs import encode_log, read_logs


def test_checksum_vectors():
    assert [codec.crc32c(x) for x in (bytes(32), b"\xff" * 32, bytes(range(32)), b"")] == [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0]
    assert codec.crc32c(b"world", codec.crc32c(b"hello ")) == codec.crc32c(b"hello world")


def test_numbers_round_trip():
    for n in (0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, (1 << 32) - 1):
        data = codec.varint(n)
        assert codec.read_varint(data, 0) == (n, len(data)) and len(data) <= 5
        with pytest.raises(Corruption):
            codec.read_varint(data[:-1], 0)
    for bad in (b"\xff" * 5 + b"\x01", b"\xff\xff\xff\xff\x7f"):
        with pytest.raises(Corruption):
            codec.read_varint(bad, 0)
    with pytest.raises(InvalidArgument):
        codec.varint(1 << 32)


def test_internal_keys():
    assert codec.split_internal_key(codec.internal_key(b"k\x00", (1 << 56) - 1, 1)) == (b"k\x00", (1 << 56) - 1, 1)
    with pytest.raises(InvalidArgument):
        codec.internal_key(b"k", 1 << 56, 1)


def test_batches_are_strict():
    entries = [(1, b"k", b"v" * 200), (0, b"", b""), (1, b"\x00\xff", b"")]
    data = codec.batch_entries(entries)
    assert codec.read_batch_entries(data, 3) == entries
    for broken, count in ((data, 2), (data, 4), (data[:-1], 3), (b"\x07" + data[1:], 3)):
        with pytest.raises(Corruption):
            codec.read_batch_entries(broken, count)


def test_torn_logs_lose_whole_batches_only(spark, tmp_path):
    batches = [(1 + 5 * k, [(1, f"key{k}-{i}".encode(), b"value")  for i in range(5)]) for k in range(20)]
    data = encode_log(batches)
    assert len(codec.read_log(data)[0]) == 100 and not codec.read_log(data)[1]
    for cut in (1, 20, 60):
        entries, torn = codec.read_log(data[:-cut])
        assert len(entries) == 95 and torn
    flipped = bytearray(data)
    flipped[-3] ^= 1
    assert len(codec.read_log(bytes(flipped))[0]) == 95
    assert codec.read_log(b"") == ([], False) and codec.read_log(data[:5]) == ([], True)
    for wrong in (b"NOTALOG!" + data[8:], data[:7] + b"\x01" + data[8:]):
        with pytest.raises(Corruption):
            codec.read_log(wrong)
    (tmp_path / "000001.log").write_bytes(data)
    (tmp_path / "000002.log").write_bytes(encode_log([(101, [(0, b"gone", b"")])])[:-1])
    got = read_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 101)) and bytes(got[7]["user_key"]) == b"key1-2" and got[7]["ordinal"] == 2


@pytest.mark.parametrize("interval", [1, 2, 16])
def test_blocks_round_trip(interval):
    r = random.Random(interval)
    for _ in range(30):
        keys = sorted({bytes(r.choices(b"ab\x00\xff", k=r.randrange(12))) for _ in range(r.randrange(1, 80))})
        entries = [(k, bytes(r.choices(b"xyz", k=r.randrange(6)))) for k in keys]
        block = codec.Block(codec.block(entries, interval))
        assert list(block.entries()) == entries and len(block.restarts) == -(-len(entries) // interval)
        for target in [*keys[:5], b"a", b"\xff\xff\xff"]:
            assert list(block.seek(target)) == [e for e in entries if e[0] >= target]
    with pytest.raises(Corruption):
        codec.Block(b"\x01\x00")


def test_tables():
    entries = [(f"key{i:05d}".encode(), seq, int(seq % 5 > 0), b"v%d" % seq if seq % 5 else b"") for i in range(500) for seq in (3 * i + 3, 3 * i + 2, 3 * i + 1)]
    data = codec.table(entries, block_bytes=1024)
    table = codec.Table(data)
    assert list(table.entries()) == entries
    table.blocks_read = 0
    assert table.get(b"key00100", 302) == (1, b"v302") and table.blocks_read == 1
    assert table.get(b"key00100", 300) is None and table.get(b"key00099", 300) == (0, b"")
    table.blocks_read = 0
    assert sum(table.get(b"none%05d" % i, 9999) is None for i in range(300)) == 300 and table.rejections > 280 and table.blocks_read < 20
    for k in (10, len(data) - 3):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(Corruption):
            list(codec.Table(bytes(broken)).entries())
    with pytest.raises(InvalidArgument):
        codec.table([(b"b", 1, 1, b""), (b"a", 1, 1, b"")])


def test_filters():
    assert [codec.filter_probes(b) for b in (1, 10, 16, 1000)] == [1, 6, 11, 30]
    keys = [b"bloomkey%09d" % i for i in range(3000)]
    for bits, most in ((6, 0.09), (10, 0.02), (16, 0.002)):
        data = codec.bloom(keys, bits)
        assert all(codec.may_contain(data, k) for k in keys)
        assert sum(codec.may_contain(data, b"bloomkey%09d" % i) for i in range(1_000_000, 1_005_000)) / 5000 < most
    assert codec.may_contain(b"", b"x") and codec.may_contain(bytes(9) + b"\x1f", b"x") and not codec.may_contain(codec.bloom([]), b"x")


def test_columns_agree_with_the_codec(spark):
    r = random.Random(3)
    keys = [bytes(r.randrange(256) for _ in range(n % 14)) for n in range(80)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k binary").select("i", columns.filter_hash(F.col("k")).alias("h"), columns.probe_positions(columns.filter_hash(F.col("k")), F.lit(640), F.lit(6)).alias("p")).collect()
    for row in rows:
        h = codec.filter_hash(keys[row["i"]])
        step = (h >> 17 | h << 15) & 0xFFFFFFFF
        assert row["h"] == h and row["p"] == [(h + k * step) % (1 << 32) % 640 for k in range(6)]
    rows = spark.createDataFrame([(i, k, (1 << 56) - 1 - i, i % 2) for i, k in enumerate(keys)], "i int, k binary, s long, t int").select("i", columns.crc32c(F.col("k")).alias("c"), columns.internal_key(F.col("k"), F.col("s"), F.col("t")).alias("n")).collect()
    for row in rows:
        key = keys[row["i"]]
        assert row["c"] == codec.crc32c(key) and bytes(row["n"]) == codec.internal_key(key, (1 << 56) - 1 - row["i"], row["i"] % 2)
    pairs = [("abc", "abd"), ("", "x"), ("same", "same"), ("ab", "abc"), ("x", "y")]
    got = spark.createDataFrame(pairs, "a string, b string").select(columns.shared_prefix_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [2, 0, 4, 2, 0]
