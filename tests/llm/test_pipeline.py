import collections
import random

import corpus_pipeline
import duckdb
from helpers import brute_classes, documents, folder, sentence, words, write
from pyspark.sql import functions as F

from layerkv.llm import mixing, quality_model, query_decontamination, query_mixing
from layerkv.llm.common import table


def test_stages_agree_with_brute_force(spark, tmp_path):
    path, docs = folder(), table(spark, folder(), "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    scorer = quality_model.Scorer(quality_model.train(docs, table(spark, path, "labels")))
    expected = [i for i, r in rows.items() if scorer.score(r["text"].encode()) >= corpus_pipeline.QUALITY]
    leaked = {r["doc_id"] for r in query_decontamination.query(spark, path).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = [tuple(r) for r in docs.collect()]
        if name == "near_dedup":
            expected = sorted(set(brute_classes([(i, rows[i]["text"]) for i in expected]).values()))
        elif name == "decontamination":
            expected = [i for i in expected if i not in leaked]
        if name != "mixing":
            assert sorted(g[0] for g in got) == sorted(expected)
        else:
            all_words = sum(len(words(rows[i]["text"])) for i in expected)
            assert sum(len(words(g[1])) for g in got) > 1.4 * all_words and max(collections.Counter(g[0] for g in got).values()) == 2
        assert all(g == tuple(rows[g[0]]) for g in got)
    mixed = collections.Counter(g[0] for g in got)
    out = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter(r["doc_id"] for r in out) == mixed and {r["shard"] for r in out} <= set(range(corpus_pipeline.SHARDS))


def test_shards_are_cut_along_the_training_order(spark, tmp_path):
    r = random.Random(3)
    docs = documents(spark, [(i, sentence(r, r.randrange(5, 40)), r.choice("abc")) for i in range(400)])
    orders = []
    for k, curves in enumerate((mixing.CURVES, (mixing.RISING, mixing.RISING, mixing.FALLING))):
        mixed = mixing.mix(docs, curves=curves)
        expected = [tuple(x) for x in mixed.collect()]
        mixed.write.parquet(str(tmp_path / str(k)))
        out = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / str(k))), "")
        got = out.collect()
        places = sorted((x["shard"], x["slot"]) for x in got)
        sizes = collections.Counter(s for s, _ in places)
        assert places == [(s, n) for s in sorted(sizes) for n in range(sizes[s])] and len(sizes) == corpus_pipeline.SHARDS
        got.sort(key=lambda x: (x["shard"], x["slot"]))
        assert [tuple(x[c] for c in docs.columns) for x in got] == expected
        total = [sum(x["size"] for x in got if x["shard"] == s) for s in sizes]
        assert max(total) - min(total) <= 2 * max(x["size"] for x in got)
        orders.append([(x["doc_id"], x["shard"], x["slot"]) for x in got])
    assert orders[0] != orders[1] and sorted(o[0] for o in orders[0]) == sorted(o[0] for o in orders[1])


LABELS = "doc_id long, quality int, toxic int"


def tables(spark, path, docs, labels=(), items=()):
    return write(
        spark, path, documents=docs, labels=spark.createDataFrame([*labels], LABELS), benchmark=spark.createDataFrame([*items], "item_id long, text string")
    )


def test_odd_tables(spark, tmp_path):
    r = random.Random(8)
    item = sentence(r, 40)
    text = sentence(r, 80)
    rows = [(None, sentence(r, 50)), (None, sentence(r, 50)), (1, sentence(r, 50)), (1, sentence(r, 50)), (2, text), (3, text), (None, text), (4, None), (5, ""), (None, None)]
    rows += [(6, item + " " + sentence(r, 60)), (7, sentence(r, 30_000)), (8, "one two"), (9, "one two")]
    clash = documents(spark, rows).withColumn("Size", F.lit("x")).withColumn("shard", F.lit("y")).withColumn("id", F.lit(None).cast("long")).withColumn("a.b", F.lit(1)).withColumn("_place", F.lit(2))
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", clash, items=[(1, item), (2, None), (None, "")])).collect()
    assert {g["text"] for g in got} == {t for i, t in rows if t and i != 6 and t != "one two"} | {"one two"} and all(g["doc_id"] != 3 for g in got)
    assert sum(g["doc_id"] is None for g in got) >= 2 and {8} == {g["doc_id"] for g in got if g["text"] == "one two"}
    places = sorted((g["shard"], g["slot"]) for g in got)
    sizes = collections.Counter(s for s, _ in places)
    assert places == [(s, n) for s in sorted(sizes) for n in range(sizes[s])]
    assert all(g["size"] == len(g["text"].encode()) + 16 for g in got)
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", clash.limit(0))).collect() == []
    bad = [(k, 0, 0) for k in range(100, 160)]
    docs = documents(spark, [(k, "BAD!! " * r.randrange(20, 90)) for k, _, _ in bad])
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "c", docs, bad, [(1, item)])).collect() == []  # all are rejected


def test_mixing_and_sharding_agree_with_sql(spark, tmp_path):
    docs = table(spark, folder(), "documents").where("doc_id % 3 > 0")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    mixed = corpus_pipeline.mix(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / "mixed")), "").orderBy("shard", "slot").collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    plan = duck.sql(query_mixing.SQL)
    rows = [dict(zip(plan.columns, x, strict=True)) for x in plan.fetchall()]
    assert collections.Counter(g["doc_id"] for g in got) == {x["doc_id"]: x["copies"] for x in rows if x["copies"]}
    copies = sorted((p, x["doc_id"]) for x in rows for p in {x["position"], x["last_position"]} if p is not None)
    order = [g["doc_id"] for g in got]
    where = {}
    for place, (p, i) in enumerate(copies):
        where.setdefault(p, []).append((place, i))
    at = 0
    for p in sorted(where):  # documents of one position stand in any order
        n = len(where[p])
        assert sorted(order[at : at + n]) == sorted(i for _, i in where[p])
        at += n
    total, before = sum(g["size"] for g in got), 0
    for g in got:
        assert g["shard"] == min((2 * before + g["size"]) * corpus_pipeline.SHARDS // (2 * total), corpus_pipeline.SHARDS - 1)
        before += g["size"]
