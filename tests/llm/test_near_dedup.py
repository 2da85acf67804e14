import collections
import random

import numpy as np
import pytest
from helpers import brute_classes, documents, folder, sentence, shingles, words, write
from pyspark.sql import functions as F

from layerkv.llm import near_dedup, query_near_dedup
from layerkv.llm.common import Scratch
from layerkv.llm.near_dedup import COORDINATES, classes, components, keep_first, signatures
from layerkv.llm.shingles import BLOCK, hashed_words, shingled


def got_classes(spark, rows):
    return {r["doc_id"]: r["class_id"] for r in classes(documents(spark, rows).select("doc_id", "text")).collect()}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = sentence(r, 1)
    return " ".join(w)


def test_query_agrees_with_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder()}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in query_near_dedup.query(spark, folder()).collect()} == brute_classes(rows)


def test_groups_chains_and_shared_passages(spark):
    r = random.Random(11)
    rows = []
    for _ in range(12):  # copies and near copies
        text = sentence(r, r.randrange(30, 200))
        rows += [text, text, text.replace(" ", "\n", 3)] + [edited(r, text, r.randrange(1, 4)) for _ in range(6)]
    chain = sentence(r, 150)
    for _ in range(25):  # each like the one before, ends unlike
        rows.append(chain)
        chain = edited(r, chain, 2)
    passage = sentence(r, 60)
    for _ in range(60):  # half of it common, some pairs alike
        text = passage + " " + sentence(r, 45)
        rows += [text, edited(r, text, 1)] if r.random() < 0.3 else [text]
    line = sentence(r, 7)
    rows += [(line + "\n") * k for k in (3, 4, 9, 30)] + [sentence(r, 3), "a b", "a  b", "b a", "", " \n", None, "x" * 50]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    assert got_classes(spark, rows) == brute_classes(rows)


@pytest.mark.parametrize("block_of", [256, 20])
def test_no_link_is_lost_in_large_groups_around_the_threshold(spark, monkeypatch, block_of):
    monkeypatch.setattr(near_dedup, "BLOCK_OF", block_of)
    r = random.Random(21)
    middle = sentence(r, 120)
    rows = []
    for _ in range(150):  # each unlike the middle, some alike to few others
        text = edited(r, middle, r.randrange(2, 5))
        rows += [text, edited(r, text, 1)] if r.random() < 0.4 else [text]
    rows = list(enumerate(rows))
    assert got_classes(spark, rows) == brute_classes(rows)


def test_edges(spark, tmp_path):
    assert query_near_dedup.query(spark, write(spark, tmp_path, documents=documents(spark, []))).collect() == []
    r = random.Random(3)
    text = sentence(r, 40)
    docs = documents(spark, [(None, text), (4, text), (9, text), (9, text), (None, sentence(r, 40)), (None, None)])
    got = collections.Counter((x["doc_id"], x["class_id"]) for x in classes(docs.select("doc_id", "text")).collect())
    assert got == {(4, 4): 1, (9, 4): 2, (None, 4): 1, (None, None): 2}
    kept = keep_first(documents(spark, [(5, text), (5, text), (3, text + " more"), (8, "other words"), (1, None), (2, "")]).withColumn("hi", F.lit(1)))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 8] and "hi" in kept.columns


def test_every_class_keeps_a_row_whatever_its_ids(spark):
    r = random.Random(17)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    rows = [(None, a), (None, b), (1, c), (1, d), (None, a), (2, edited(r, a, 1)), (None, edited(r, b, 1)), (None, None), (5, c), (1, c), (1, c)]
    docs = documents(spark, rows)
    kept = collections.Counter((x["doc_id"], x["text"]) for x in keep_first(docs).collect())
    assert {(2, rows[5][1]), (1, c), (1, d)} < set(kept) and set(kept.values()) == {1} and len(kept) == 5
    assert (None, b) in kept or (None, rows[6][1]) in kept
    assert (None, None) in kept and [x.count for x in (keep_first(docs.limit(0)),)][0]() == 0
    unlike = documents(spark, [(None, sentence(r, 40)) for _ in range(30)] + [(7, sentence(r, 40)) for _ in range(30)])
    assert keep_first(unlike).count() == 60
    named = {x["text"]: x["class_id"] for x in classes(docs.select("doc_id", "text")).join(docs, "doc_id").collect()}
    assert named[c] == 1


def test_groups_around_the_threshold(spark):
    r = random.Random(5)
    rows = []
    for _ in range(12):
        text = sentence(r, r.randrange(60, 161))
        share = r.uniform(0.008, 0.025)
        rows += [" ".join(sentence(r, 1) if r.random() < share else w for w in text.split()) for _ in range(60)]
    rows = list(enumerate(rows))
    assert got_classes(spark, rows) == brute_classes(rows)


def test_agreement_is_the_weighted_similarity():
    r = np.random.default_rng(1)
    n = 60
    a, b = r.integers(1, 9, n).astype(float), r.integers(1, 9, n).astype(float)
    a[:15], b[-15:] = 0, 0
    wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for trial in range(30):
        element = np.arange(n, dtype=np.uint64) + np.uint64(1000 * trial)
        owner = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
        s = signatures(owner, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        assert (s > 0).all()
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(wanted, abs=4 * np.sqrt(wanted * (1 - wanted) / (30 * COORDINATES)))


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_words_and_shingles_are_hashed_alike_wherever_they_stand():
    texts = ["one two  three\tfour five six", "zero one two three four five six", "é one", "", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, owner = hashed_words(data, cuts)
    assert owner.tolist() == [0] * 6 + [1] * 7 + [2] * 2 + [4]
    assert hashes[:6].tolist() == hashes[7:13].tolist() and hashes[0] == hashes[14] == hashes[15]
    s, who = shingled(hashes, owner)
    assert sorted(who.tolist()) == [0, 0, 1, 1, 1, 2, 4] and set(s[who == 0].tolist()) < set(s[who == 1].tolist())


def test_texts_longer_than_a_block(spark):
    r = random.Random(6)
    unit = sentence(r, 2000)
    long = " ".join(unit + f" {k}" for k in range(BLOCK // len(unit) + 2))
    rows = [(1, long), (2, long + " end"), (3, "x" * (BLOCK + 5)), (4, "x" * (BLOCK + 5)), (5, "other")]
    assert got_classes(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert len(words(long)) > 5 and shingles("a b") == {("a", "b"): 1}
