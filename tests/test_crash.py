"""Writers that die: every acknowledged batch is there on reopening, as a gapless prefix, round after round."""

import os
import re
import signal
import subprocess
import sys
from pathlib import Path

import pytest

from layerkv.functions.codec import read_log
from layerkv.plans.options import Options
from layerkv.plans.store import MANIFESTS, Store
from layerkv.schema import Corruption
from layerkv.sources.logs import encode_log

WRITER = """
import os, sys
from pyspark.sql import SparkSession
from layerkv.plans.batch import WriteBatch
from layerkv.plans.options import Options
from layerkv.plans.store import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
path, begin, dies_at, how = sys.argv[1], int(sys.argv[2]), int(sys.argv[3]), sys.argv[4]
store = Store.open(spark, path, Options(background_compaction=False, l0_compaction_trigger=2))
for k in range(begin, begin + 1000):
    if k == begin + dies_at and how != "killed":
        def die(version):
            if how == "torn manifest":  # a part of the next version, under its temporary name
                with open(f"{path}/manifests/{version.number:012d}.json.torn.tmp", "wb") as f:
                    f.write(b"00000000\\n{")
            os._exit(9)
        store.before_publish = die
    if k == begin + dies_at and how == "unpublished flush":
        store.flush()
    batch = WriteBatch()
    for i in range(5):
        batch.put("key%012d" % (5 * k + i), "value%012d" % (5 * k + i))
    store.write(batch)
    print("acked", k, flush=True)
    if k % 4 == 3:
        store.flush()
        store.maintain()
"""


def acknowledged(path: str, begin: int, dies_at: int, how: str) -> int:
    """The last batch that a writer acknowledged before it died."""
    env = os.environ | {"PYTHONPATH": f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"}
    writer = subprocess.Popen([sys.executable, "-c", WRITER, path, str(begin), str(dies_at), how], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env)
    acked = begin - 1
    for line in writer.stdout:
        if m := re.match(r"acked (\d+)", line):
            acked = int(m[1])
            if how == "killed" and acked == begin + dies_at:
                writer.send_signal(signal.SIGKILL)
                break
    writer.wait()
    return acked


def test_acknowledged_batches_survive_rounds_of_crashes(spark, tmp_path):
    path, batches = str(tmp_path / "s"), 0
    for dies_at, how in ((4, "killed"), (2, "unpublished flush"), (1, "torn manifest")):
        acked = acknowledged(path, batches, dies_at, how)
        assert acked >= batches + dies_at - 1
        store = Store.open(spark, path, Options(background_compaction=False))
        keys = [int(k[3:]) for k, _ in store.iterate()]
        assert keys == list(range(len(keys))) and len(keys) % 5 == 0 and len(keys) >= 5 * (acked + 1)
        assert all(v == b"value" + k[3:] for k, v in store.iterate()) and store.last_sequence == len(keys)
        assert len(store.folder.names(MANIFESTS)) == 1  # what the dead writer left is gone
        batches = len(keys) // 5
    store.put("after", "1")
    assert store.get("after") == b"1" and store.last_sequence == 5 * batches + 1


def test_a_log_cut_or_damaged_anywhere_loses_whole_batches_from_there():
    batches = [(5 * k + 1, [(1, b"key%03d" % (5 * k + i), b"value%d" % i) for i in range(5)]) for k in range(6)]
    whole = encode_log(batches)
    ends = [len(encode_log(batches[:k])) for k in range(len(batches) + 1)]
    for cut in range(ends[0], len(whole) + 1):
        entries, torn = read_log(whole[:cut])
        n = sum(e <= cut for e in ends[1:])
        assert [e[0] + e[1] for e in entries] == list(range(1, 5 * n + 1)) and torn == (cut not in ends)
    for at in range(ends[0], len(whole), 3):
        damaged = whole[:at] + bytes([whole[at] ^ 0x41]) + whole[at + 1 :]
        entries, torn = read_log(damaged)
        assert torn and len(entries) == 5 * sum(e <= at for e in ends[1:])
    with pytest.raises(Corruption):
        read_log(b"x" + whole[1:])
