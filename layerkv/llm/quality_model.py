"""Quality by compression: is a text cheaper to write with the vocabulary of good or of bad texts?

Two zstandard dictionaries are built, from labelled good and from labelled bad texts. A text is
compressed with both, in pieces that a dictionary can matter for, and the difference of the two sizes is
divided by the text's length: bytes saved for each byte. (Divided by a compressed size instead, a text
that repeats itself would get a large quotient of two small numbers; neither dictionary saves much on it.)
For very short texts the difference is pulled towards its mean. A logistic model of it alone, fitted on
labelled rows that built no dictionary, gives the probability of label 1.

Defined results
- A null or empty text has the mean difference and scores as a text of which nothing is known.
- Without labels of both classes the score of every text is the share of label 1 (1 if no labels).
- An input column ``score`` is left out; an empty table gives an empty result.
- Scores depend on the text only: equal texts score equally, wherever they stand.
- The whole text is compressed, a piece at a time, so memory doesn't grow with its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerkv.llm.common import col, map_arrow, others
from layerkv.llm.training import label_counts, sample

#: At most this many labelled rows of each class are learned from, and about this many bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12 << 20
DICTIONARY, PIECE, LEVEL = 262_144, 1024, 3
#: Bytes at which a text's own difference counts half, and what differences are multiplied by for the fit.
HALF, SCALE = 40.0, 20.0


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    weights: tuple[float, float]  # of 1 and the difference
    mean: float = 0.0  # difference of a text of which nothing is known


class Scorer:
    """Compressors for one task."""

    def __init__(self, model: Model):
        self.model, self.compressors = model, []
        for content in (model.bad, model.good) if model.bad else ():
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def saved(self, text: bytes) -> int:
        """Bytes that the good dictionary saves over the bad one."""
        bad, good = (sum(len(c.compress(text[k : k + PIECE])) for k in range(0, len(text), PIECE)) for c in self.compressors)
        return bad - good

    def difference(self, text: bytes) -> float:
        if not text or not self.compressors:
            return self.model.mean
        return (self.saved(text) + HALF * self.model.mean) / (len(text) + HALF)

    def score(self, text: bytes) -> float:
        z = self.model.weights[0] + self.model.weights[1] * self.difference(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def dictionary(texts: list[bytes]) -> bytes:
    """Trained on pieces of the texts taken in turn; the texts themselves where they are too few to train on."""
    longest = max(map(len, texts))
    pieces = [t[k : k + PIECE] for k in range(0, longest, PIECE) for t in texts if k < len(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((p - y) * importance) + ridge * w
        hessian = (x * (p * (1 - p) * importance)[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 5 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]], counts: tuple[int, int]) -> Model:
    """Half of each class builds its dictionary, the other half calibrates, weighted to the classes' true shares."""
    by = [[t.encode() for t, y in rows if y == k and t] for k in (0, 1)]
    if min(map(len, by)) < 4:
        share = counts[1] / sum(counts) if sum(counts) else 1.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (math.log(share / (1 - share)), 0.0))
    known = Model(dictionary(by[0][::2]), dictionary(by[1][::2]), (0.0, 0.0))
    scorer = Scorer(known)
    rest = [(t, k) for k in (0, 1) for t in by[k][1::2]]
    length, saved, y = (np.array(x, float) for x in zip(*((len(t), scorer.saved(t), k) for t, k in rest), strict=True))
    share = [counts[k] / sum(counts) / max(1, (y == k).sum()) for k in (0, 1)]
    importance = np.where(y == 1, share[1], share[0]) * len(y)
    mean = float(np.average(saved / (length + HALF), weights=importance))
    difference = (saved + HALF * mean) / (length + HALF)
    bias, slope = logistic(np.c_[np.ones(len(y)), difference * SCALE], y, importance)
    return Model(known.bad, known.good, (float(bias), float(slope * SCALE)), mean)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_BYTES), label_counts(labels, "quality"))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``df`` with ``score`` in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = others(df, text, "score")
    schema = df.select(*map(col, rest)).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score((t.as_py() or "").encode()) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*rest, "score"])

    return map_arrow(df.select(*map(col, [*rest, text])), run, schema)


def keep_good(df: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``df`` whose text scores ``threshold`` or more, all columns kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score((t.as_py() or "").encode()) >= threshold for t in batch.column("text")], pa.bool_()))

    return map_arrow(df, run, df.schema)


def is_good(threshold: float):
    return (F.col("score") >= threshold).cast("int")
