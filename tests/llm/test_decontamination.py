import datetime
import random

from helpers import documents, folder, sentence, write

from layerkv.llm import decontamination, query_decontamination
from layerkv.llm.decontamination import SURE, Index, drop_contaminated, normal

ITEMS = "item_id long, text string"


def flat(text):
    return " ".join((text or "").lower().split())


def test_every_exact_passage_is_found_and_nothing_else(spark):
    got = {(r["doc_id"], r["item_id"]): r for r in query_decontamination.query(spark, folder()).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder()}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder()}/benchmark.parquet").collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)} == set(got)
    for (d, i), r in got.items():
        assert r["edits"] == 0 and flat(docs[d][r["start"] : r["end"]]) in flat(items[i])


def distance_inside(window, text):
    """Least edits that turn the window into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def damaged(r, text, n):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        out[k : k + (kind != 1)] = [] if kind == 0 else [r.choice("abcdefgh ")]
    return "".join(out)


def test_agrees_with_brute_force_on_damaged_passages():
    r = random.Random(7)
    items = tuple(sentence(r, r.randrange(8, 22)) for _ in range(12))
    index = Index(items)
    texts = []
    for _ in range(60):
        k = r.randrange(12)
        texts.append(sentence(r, 15) + " " + damaged(r, items[k], r.randrange(0, int(0.16 * len(items[k])))) + " " + sentence(r, 15))
    got = {(t, k): e for t, k, _, _, e in index.find(texts)}
    for t, text in enumerate(texts):
        codes = normal(text)[0].tolist()
        for k in range(12):
            best = min((d for w, item, most in zip(index.window, index.item, index.most, strict=True) if item == k and (d := distance_inside(w.tolist(), codes)) <= most), default=None)
            assert got.get((t, k)) == best


def test_every_exact_run_of_the_stated_length_is_found():
    r = random.Random(10)
    items = tuple(sentence(r, n) for n in (16, 20, 45, 90))
    index, cases = Index(items), []
    for k, item in enumerate(items):
        for a in range(0, len(item) - SURE + 1):
            cases.append((k, sentence(r, 10) + " " + item[a : a + SURE] + " " + sentence(r, 10)))
    assert {(t, k) for t, (k, _) in enumerate(cases)} == {(t, k) for t, k, _, _, e in index.find([text for _, text in cases]) if e == 0}
    assert SURE <= 80 and index.find([sentence(r, 200)]) == []


def test_places_are_the_given_texts(spark):
    r = random.Random(9)
    item = sentence(r, 30)
    text = "É  İ\n\t" + item.upper().replace(" ", "  \n") + "  end"
    ((_, _, start, end, edits),) = Index((item,)).find([text])
    assert edits == 0 and flat(text[start:end]) in item


def test_edges(spark, tmp_path):
    r = random.Random(8)
    long_item, item = sentence(r, 150), sentence(r, 20)
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, "short"), (5, " SHORT\n"), (6, "a short one"), (7, sentence(r, 30_000) + " " + item + " " + sentence(r, 30_000)), (None, item), (8, sentence(r, 5) + " " + long_item[200:420] + " " + sentence(r, 5)), (9, item[: len(item) // 2])]
    items = spark.createDataFrame([(1, item), (2, "short"), (3, None), (4, ""), (5, long_item), (6, item)], ITEMS)
    path = write(spark, tmp_path / "a", documents=documents(spark, rows), benchmark=items)
    got = sorted(((x["doc_id"] or 0, x["item_id"]) for x in query_decontamination.query(spark, path).collect()))
    assert got == [(0, 1), (0, 6), (3, 1), (3, 1), (3, 6), (3, 6), (4, 2), (5, 2), (7, 1), (7, 6), (8, 5)]
    kept = drop_contaminated(documents(spark, rows).selectExpr("*", "1 AS start"), items).collect()
    assert sorted(x["doc_id"] for x in kept) == [1, 2, 6, 9] and kept[0]["start"] == 1
    empty = write(spark, tmp_path / "b", documents=documents(spark, []), benchmark=items)
    assert query_decontamination.query(spark, empty).collect() == []
    none = write(spark, tmp_path / "c", documents=documents(spark, rows), benchmark=items.limit(0))
    assert query_decontamination.query(spark, none).collect() == []


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    items = [(k, sentence(r, 20)) for k in range(30)]
    docs = documents(spark, [(k, sentence(r, 10) + " " + items[k][1]) for k in range(30)])
    monkeypatch.setattr(decontamination, "BLOCK", 700)
    got = decontamination.findings(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(k, k) for k in range(30)]


def test_items_of_any_id_type_and_length(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(31)
    item, long = sentence(r, 40), sentence(r, 3000)
    docs = documents(spark, [(1, sentence(r, 30) + " " + item + " " + sentence(r, 20)), (2, long[9000:9200]), (3, sentence(r, 50)), (4, long[4000:4090])])
    items = spark.createDataFrame([(7, item), (8, item), (None, item), (9, long), (10, None), (11, "")], "item_id int, text string")
    expected = {(1, 7), (1, 8), (1, None), (2, 9), (4, 9)}
    for part, block in ((1 << 16, 1 << 22), (4096, 8192), (4096, 1)):
        monkeypatch.setattr(decontamination, "PART", part)
        monkeypatch.setattr(decontamination, "BLOCK", block)
        for kind in ("int", "string", "decimal(9,1)", "date"):
            typed = items.withColumn("item_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("item_id")) if kind == "date" else F.col("item_id").cast(kind))
            rows = decontamination.findings(docs, typed).collect()
            back = (lambda x: (x - datetime.date(2024, 1, 1)).days) if kind == "date" else (lambda x: int(float(x)))
            assert {(x["doc_id"], None if x["item_id"] is None else back(x["item_id"])) for x in rows} == expected and (len(rows) == 5 or block < len(long))
        assert sorted(x["doc_id"] for x in decontamination.drop_contaminated(docs, items).collect()) == [3]
    assert decontamination.findings(docs, items.limit(0)).count() == 0 and decontamination.drop_contaminated(docs, items.limit(0)).count() == 4
    assert decontamination.findings(docs.limit(0), items).count() == 0
