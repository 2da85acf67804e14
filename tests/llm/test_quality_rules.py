import collections
import math
import random
import re
import zlib

import pytest
from helpers import documents, folder, sentence, words, write
from pyspark.sql import functions as F

from layerkv.llm import quality_rules, query_quality_rules
from layerkv.llm.quality_rules import BUCKETS, THRESHOLD


def grams(text):
    crc = [zlib.crc32(w.encode()) for w in words(text)]
    return [c % BUCKETS for c in crc] + [(c * 1_000_003 + d) % BUCKETS for c, d in zip(crc, crc[1:])]  # noqa: B905


def brute(rows, trusted):
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    all_raw, all_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    ratio = lambda b: math.floor((math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)) * 10_000 + 0.5) / 10_000 if sum(target.values()) else 0.0
    out = []
    for i, t in rows:
        t = t or ""
        w, lines, g = words(t), [x for x in t.split("\n") if words(x)], grams(t)
        count = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        covered = {k + d for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed and score >= THRESHOLD, score))
    return out


def check(spark, path, rows, trusted):
    got = sorted(map(tuple, query_quality_rules.query(spark, path).collect()), key=str)
    expected = sorted(brute(rows, trusted), key=str)
    assert [g[:8] for g in got] == [e[:8] for e in expected]
    assert [g[8] for g in got] == pytest.approx([e[8] for e in expected], abs=1e-9)


def test_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{folder()}/documents.parquet").select("doc_id", "text").collect()
    labels = spark.read.parquet(f"{folder()}/labels.parquet").where("quality = 1").collect()
    check(spark, folder(), [tuple(r) for r in docs], {r["doc_id"] for r in labels})


def test_edges(spark, tmp_path):
    r = random.Random(1)
    loop = "a b c a b c a b c"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, loop), (5, "one\n\none\ntwo\n two"), (6, sentence(r, 4000, "ab")), (7, sentence(r, 60)), (7, sentence(r, 60)), (8, "x y z # <b>"), (None, "word " * 80)]
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (None, 1, 0), (99, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    check(spark, write(spark, tmp_path / "a", documents=documents(spark, rows), labels=labels), rows, {7})
    check(spark, write(spark, tmp_path / "t", documents=documents(spark, rows), labels=spark.createDataFrame([(i, 1, 0) for i in range(9)], labels.schema)), rows, set(range(9)))
    check(spark, write(spark, tmp_path / "b", documents=documents(spark, rows), labels=labels.limit(0)), rows, set())
    assert query_quality_rules.query(spark, write(spark, tmp_path / "c", documents=documents(spark, []), labels=labels)).collect() == []


def test_only_texts_that_may_be_trusted_are_shuffled(spark, monkeypatch):
    docs = documents(spark, [(i, f"text {i}") for i in range(500)] + [(None, "none")]).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    good = spark.createDataFrame([(i,) for i in range(0, 1000, 50)], "_good long")
    for bits in (quality_rules.FILTER_BITS, 1 << 15, 16):  # the fewer bits, the more rows are asked for; flags stay
        monkeypatch.setattr(quality_rules, "FILTER_BITS", bits)
        rows = quality_rules.flagged(docs, good).collect()
        assert len(rows) == 501 and {r["_id"] for r in rows if r["_flag"]} == set(range(0, 500, 50))
