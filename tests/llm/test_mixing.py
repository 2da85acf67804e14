import collections
import hashlib
import random

import duckdb
import pytest
from helpers import documents, folder, sentence, words, write
from pyspark.sql import functions as F

from layerkv.llm import mixing, query_mixing
from layerkv.llm.mixing import FALLING, FLAT, RISING, mix, mixed, plan_mix, position, segments


def test_query_agrees_with_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder()}/documents.parquet'")
    assert sorted(map(tuple, query_mixing.query(spark, folder()).collect())) == sorted(duck.sql(query_mixing.SQL).fetchall())


def fill(sizes, share=1.5, most=2):
    """Targets by resharing until none is above its limit."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, wanted = {}, share * sum(sizes.values())
    while True:
        left = wanted - sum(full.values())
        open_ = [s for s in sizes if s not in full]
        target = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if target[s] >= most * sizes[s]}
        if not over:
            return full | target
        full |= over


def test_targets_are_met(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, None if i % 50 == 0 else sentence(r, r.randrange(0, 60)), r.choice(["b", "a", "a", "a", "é", None, "tiny" if i % 300 == 0 else "z"])) for i in range(1500)]
    path = write(spark, tmp_path, documents=documents(spark, rows))
    got = query_mixing.query(spark, path).collect()
    assert sorted((g["doc_id"], g["size"]) for g in got) == sorted((i, len(words(t))) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for g in got:
        s = source[g["doc_id"]]
        sizes[s] += g["size"]
        taken[s] += g["taken"]
        target[s] = g["target"]
        assert 0 <= g["taken"] <= 2 * g["size"] and g["taken"] % max(1, g["size"]) == 0
    expected = fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 60
    again = query_mixing.query(spark, path).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_edges(spark, tmp_path):
    assert query_mixing.query(spark, write(spark, tmp_path / "a", documents=documents(spark, []))).collect() == []
    blank = documents(spark, [(1, None, "a"), (2, " \n", "a"), (None, "", None)])
    got = query_mixing.query(spark, write(spark, tmp_path / "b", documents=blank)).collect()
    assert [(g["size"], g["target"], g["taken"]) for g in got] == [(0, 0.0, 0)] * 3
    repeated = documents(spark, [(7, "one two three", "a")] * 5 + [(8, "four", "b")])
    got = query_mixing.query(spark, write(spark, tmp_path / "c", documents=repeated)).collect()
    assert len(got) == 6 and sum(g["taken"] for g in got) in range(22, 27)


def test_positions_follow_the_curves(spark):
    shares = [k / 40 for k in range(40)]
    for curve in (FLAT, RISING, FALLING, ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))):
        at = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(position(F.col("s"), F.lit(0), (curve,))).collect()]
        assert at == sorted(at) and all(0 <= t < 1 for t in at)
        for s, t in zip(shares, at, strict=True):  # demand up to t is s
            area = sum(w0 * x + slope * x * x / 2 for t0, length, w0, slope, _, _ in segments(curve) for x in [min(max(t - t0, 0), length)])
            assert area == pytest.approx(s, abs=1e-9)
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError, match="curve|knots"):
            segments(bad)


def test_copies_keep_their_columns(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, 20), "ab"[i % 2]) for i in range(200)]
    docs = documents(spark, rows).withColumn("size", F.lit(1)).withColumn("_Source", F.lit(2)).withColumn("taken", F.lit(3))
    out = mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(words(g["text"])) for g in got) == pytest.approx(1.5 * 200 * 20, rel=0.02)
    assert max(collections.Counter(g["doc_id"] for g in got).values()) == 2 and got[0]["taken"] == 3


def first_positions(rows, curves):
    """{doc_id: training position of its first copy} of the taken rows (doc_id, size, source, target), by bisecting each curve's area."""
    out, before = {}, collections.Counter()
    sources = sorted({r[2] for r in rows})
    for i, size, source, target in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest()):
        knots, share, low, high = curves[sources.index(source) % len(curves)], before[source] / target, 0.0, 1.0
        if before[source] + size / 2 < target:
            for _ in range(60):
                t = (low + high) / 2
                area = sum(w0 * x + slope * x * x / 2 for t0, length, w0, slope, _, _ in segments(knots) for x in [min(max(t - t0, 0), length)])
                low, high = (t, high) if area < share else (low, t)
            out[i] = low
        before[source] += size
    return out


def test_query_gives_documents_in_training_order(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, sentence(r, r.randrange(5, 40)), r.choice("aab")) for i in range(300)]
    docs += [(i, sentence(r, 20), "c") for i in range(300, 400)]
    path = write(spark, tmp_path, documents=documents(spark, docs))
    source = {i: s for i, _, s in docs}
    got = query_mixing.query(spark, path).collect()
    orders = {}
    for curves in ((FALLING, FLAT, RISING), (RISING, RISING, FALLING)):
        rows = got if not orders else mixed(documents(spark, docs).select("doc_id", "source", F.size(F.split("text", " ")).alias("n")), F.col("n"), curves).collect()
        at = first_positions([(g["doc_id"], g["size"], source[g["doc_id"]], g["target"]) for g in rows], curves)
        taken = [g["doc_id"] for g in rows if g["copies"]]
        assert set(at) == set(taken) and [g["copies"] > 0 for g in rows] == [True] * len(taken) + [False] * (400 - len(taken))
        assert all(at[a] <= at[b] + 1e-9 for a, b in zip(taken, taken[1:], strict=False))
        assert sorted(tuple(g)[:6] for g in rows) == sorted(tuple(g)[:6] for g in got)
        for g in rows:
            assert (g["position"] is None) == (g["copies"] == 0) and (g["position"] is None or g["position"] == pytest.approx(at[g["doc_id"]], abs=1e-9))
            assert g["copies"] < 2 or g["last_position"] > g["position"]
        orders[curves] = taken
    assert len({tuple(o) for o in orders.values()}) == 2


def test_sources_follow_their_curves_and_copies_lie_apart(spark):
    r = random.Random(14)
    docs = documents(spark, [(i, sentence(r, r.randrange(5, 30)), "abc"[i % 3]) for i in range(1500)])
    rows = [(g["source"], g["doc_id"], len(words(g["text"]))) for g in mix(docs).collect()]
    total = collections.Counter()
    for s, _, n in rows:
        total[s] += n
    all_words, at, done = sum(total.values()), 0.0, collections.Counter()
    ends = {0.25: {}, 0.5: {}, 0.75: {}}
    area = lambda knots, t: sum(w0 * x + slope * x * x / 2 for t0, length, w0, slope, _, _ in segments(knots) for x in [min(max(t - t0, 0), length)])
    for end in ends:  # words of all sources by time t, from their curves
        ends[end] = {s: total[s] * area(c, end) for s, c in zip("abc", (FALLING, FLAT, RISING), strict=True)}
    checks = [(sum(e.values()), e) for e in ends.values()]
    for s, _, n in rows:
        at += n
        done[s] += n
        while checks and at >= checks[0][0]:
            assert all(done[k] == pytest.approx(v, abs=0.01 * all_words) for k, v in checks.pop(0)[1].items())
    assert not checks
    place = collections.defaultdict(list)
    for k, (_, i, _) in enumerate(rows):
        place[i].append(k)
    apart = [b - a for p in place.values() for a, b in zip(p, p[1:], strict=False)]
    assert apart and min(apart) > len(rows) / 10


def test_rows_without_ids_and_long_texts(spark):
    r = random.Random(15)
    docs = documents(spark, [(None, sentence(r, k), "a") for k in range(1, 200)] + [(1, "word " * 200_000, "b"), (2, None, None), (2, "", "b")])
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"))
    rows = plan_mix(sized, F.col("n")).collect()
    assert len(rows) == 202 and sum(g["size"] for g in rows if g["doc_id"] is None) == sum(range(1, 200))
    assert len({g["_digest"] for g in rows if g["doc_id"] is None}) == 199
    assert mixed(sized.limit(0), F.col("n")).count() == 0
