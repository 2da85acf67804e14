"""Brute-force counterparts and small tables for the corpus operators."""

import collections
import os
import re

import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return FOLDER


def write(spark, path, **tables):
    """A folder of tables, as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similar(a, b, least=0.8):
    def jaccard(x, y):
        both = sum((x & y).values())
        return both / max(1, sum(x.values()) + sum(y.values()) - both)

    return max(jaccard(a, b), jaccard(collections.Counter(set(a)), collections.Counter(set(b)))) >= least


def brute_classes(rows):
    """doc_id: least id of its class, from all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if not sets[a] and not sets[b] or sets[a] and sets[b] and similar(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def sentence(r, n, letters="abcdefghijklmnop"):
    return " ".join("".join(r.choices(letters, k=r.randrange(2, 8))) for _ in range(n))
