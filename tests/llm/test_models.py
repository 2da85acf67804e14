"""The two learned operators: held-out accuracy, and texts of any shape."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from helpers import documents, folder, sentence, write
from pyspark.sql import functions as F

from layerkv.llm import quality_model, query_quality_model, query_toxicity, toxicity, tuning
from layerkv.llm.training import fold, sample

LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, query, label, path):
    rows = query(spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows), len(rows)


@pytest.mark.parametrize(("query", "label"), [(query_quality_model.query, "quality"), (query_toxicity.query, "toxic")])
def test_held_out_accuracy(spark, query, label):
    folder()
    accuracy, n = held_out(spark, query, label, "/root/testdata/sf0.01")
    assert n > 50 and accuracy >= 0.92


def corpus(spark, path, n=400):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        w = sentence(r, r.randrange(20, 120)).split() if good else [x.upper() + "!!" for x in sentence(r, 8).split()] * 6
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w.insert(r.randrange(len(w)), r.choice(["grumblefoot", "snotwhistle", "dunderbrick"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    odd = [(None, "x"), (n, None), (n + 1, ""), (n + 2, "grumblefoot " * 3000), (n + 3, "a"), (n + 4, "\u0000 \U0001f600" * 10), (0, rows[0][1])]
    return write(spark, path, documents=documents(spark, rows + odd), labels=spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (2, 7, 7)], LABELS)), rows + odd


@pytest.mark.parametrize(("query", "label"), [(query_quality_model.query, "quality"), (query_toxicity.query, "toxic")])
def test_small_corpus(spark, tmp_path, query, label):
    path, rows = corpus(spark, tmp_path / "a")
    got = query(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert held_out(spark, query, label, path)[0] > 0.9
    by = {}
    for r, (_, text) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert by.setdefault(text or "", r["score"]) == pytest.approx(r["score"], abs=1e-9)
    again = {(r["doc_id"], r["score"]) for r in query(spark, path).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


@pytest.mark.parametrize(("query", "most"), [(query_quality_model.query, 1.0), (query_toxicity.query, 0.0)])
def test_without_labels_or_documents(spark, tmp_path, query, most):
    none = spark.createDataFrame([], LABELS)
    got = query(spark, write(spark, tmp_path / "a", documents=documents(spark, [(1, "some text"), (2, None)]), labels=none)).collect()
    assert [r["score"] for r in got] == pytest.approx([most] * 2, abs=1e-4)
    assert query(spark, write(spark, tmp_path / "b", documents=documents(spark, []), labels=none)).collect() == []


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_words_are_read_through_padding():
    reader = toxicity.Reader()
    codes, starts, _, owner = reader.words(["g r u m p y, don't g.r.u.m.p.y grummmpyyy", "a"])
    assert toxicity.clean_words(codes, starts) == ["grumpy", "dont", "grumpy", "grumpy", "a"] and owner.tolist() == [0, 0, 0, 0, 1]


def brute_features(w):
    w, out = chr(1) + w, {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
    return out


def brute_kernel(a, b):
    def size(w):
        n = len(w) + 1
        return sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + toxicity.SPAN))) ** 0.5

    x, y = brute_features(a), brute_features(b)
    return (sum(v * y.get(f, 0) for f, v in x.items()) / size(a) / size(b)) ** toxicity.POWER if x and y else 0


def test_string_kernel_agrees_with_brute_force_and_is_positive_definite():
    r = random.Random(3)
    marks = ["banana", "abcabc", "grumble", "ab"]
    some = ["".join(r.choices("abnc", k=r.randrange(1, 9))) for _ in range(200)] + ["banana", "bananas", "grxumble"]
    got = toxicity.Kernel(marks).of(*toxicity.spelled(some))
    for i, word in enumerate(some):
        assert got[i] == pytest.approx([brute_kernel(word, m) for m in marks], abs=1e-9)
    own = sorted(set(some))
    full = toxicity.Kernel(own).of(*toxicity.spelled(own))
    assert np.linalg.eigvalsh(full).min() > -1e-9 and full == pytest.approx(full.T)


def brute_words(text):
    kept = "".join(c if c.isspace() or c.isalnum() else "" for c in text.lower())
    words = [re.sub(r"(.)\1+", r"\1", w) for w in kept.split()]
    out = []
    for k, w in enumerate(words):
        if len(w) == 1 and k and len(words[k - 1]) == 1:
            out[-1] += w
        else:
            out.append(w)
    return out


def test_scores_agree_with_brute_force(spark, tmp_path):
    path, rows = corpus(spark, tmp_path / "a", 120)
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    toxic, quality = toxicity.train(docs, labels), quality_model.train(docs, labels)
    assert toxic.landmarks and quality.bad and len(quality.weights) == 2
    got = [{r["doc_id"]: r["score"] for r in q.query(spark, path).collect()} for q in (query_toxicity, query_quality_model)]
    sizes = [zstandard.ZstdCompressor(level=quality_model.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (quality.bad, quality.good)]
    for i, text in rows[:60] + rows[-5:]:
        if i in (None, 0):
            continue
        words, data = brute_words(text or ""), (text or "").encode()
        value = [sum(w * brute_kernel(x, m) for m, w in zip(toxic.landmarks, toxic.weights, strict=True)) for x in words]
        sentences = sorted((sum(value[k : k + toxicity.WINDOW]) for k in range(0, len(value), toxicity.WINDOW)), reverse=True)
        assert got[0][i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, toxic.bias + sum(sentences[: toxicity.TOP]))))), abs=1e-6)
        bad, good = (sum(len(c.compress(data[k : k + 1024])) for k in range(0, len(data), 1024)) for c in sizes)
        difference = (bad - good + quality_model.HALF * quality.mean) / (len(data) + quality_model.HALF)
        assert got[1][i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, quality.weights[0] + quality.weights[1] * difference)))), abs=1e-9)


def test_one_insult_is_found_in_a_long_text_and_in_disguise():
    r = random.Random(9)
    insults = ["grumblefoot", "snotwhistle", "dunderbrick", "cloddish"]
    rows = []
    for _ in range(500):
        w, bad = sentence(r, r.randrange(20, 150), "abcdefghijklmnoprstuw").split(), r.random() < 0.4
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(insults))
        rows.append((" ".join(w), int(bad)))
    scorer = toxicity.Scorer(toxicity.fit(rows, (300, 200)))
    clean = sentence(r, 400, "abcdefghijklmnoprstuw")
    spellings = ["snotwhistle", "SnotWhistle!", "s n o t w h i s t l e", "s.n.o.t.w.h.i.s.t.l.e", "snnnnotwhisssstle", "snotwhistles"]
    gapped = f"{clean} snotwxhistle {clean} grumqblefoot {clean} dunzderbrick"  # a letter in between costs more: it takes several
    scores = scorer.scores([clean, *(f"{clean} you {x} there {clean}" for x in spellings), gapped])
    assert scores[0] < 0.3 and scores[1:].min() > 0.6


def test_texts_are_learned_from_whatever_their_length(spark, tmp_path):
    r = random.Random(12)
    good = lambda: sentence(r, 4500)
    bad = lambda: "!! ".join(sentence(r, 4500).upper().split())
    rows = [(i, (good if i % 2 else bad)()) for i in range(60)]
    assert min(len(t) for _, t in rows) > 16_384
    path = write(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS))
    got = query_quality_model.query(spark, path).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    few = sample(docs, labels, "quality", 5, 1 << 30)
    assert len(few) == 10 and len(sample(docs, labels, "quality", 3000, 1)) == 2 and 30 < len(sample(docs, labels, "quality", 3000, 1 << 30)) < 60


def test_settings_are_compared_without_the_held_out_fold():
    rows = [(i, f"{'good words here' if i % 2 else 'BAD!! BAD!!'} {i}", i % 2) for i in range(200)]
    seen = []

    def fit(train, counts):
        seen.extend(t for t, _ in train)
        return None

    parts = tuning.cross_validated(rows, fit, lambda model, texts: [0.9 if "good" in t else 0.1 for t in texts], 0.5)
    assert parts == (1.0, 1.0, 1.0) and not {int(t.split()[-1]) for t in seen} & {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_long_texts_are_scored_whole():
    r = random.Random(5)
    good = lambda n: sentence(r, n)
    bad = lambda n: "!! ".join(sentence(r, n).upper().split())
    model = quality_model.fit([x for _ in range(150) for x in ((good(80), 1), (bad(80), 0))], (150, 150))
    scorer = quality_model.Scorer(model)
    assert scorer.score(good(40_000).encode()) > 0.8 and scorer.score(bad(40_000).encode()) < 0.2
    assert scorer.score((good(2000) + bad(38_000)).encode()) < 0.2
