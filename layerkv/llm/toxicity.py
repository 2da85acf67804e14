"""Toxicity by a support vector machine on a string kernel, tolerant of gapped and padded insults.

The kernel of two words is the gap-weighted subsequence kernel: the words share a feature for every
three letters that occur in this order in both, weighted by ``DECAY`` to the power of the letters
spanned. Features are divided by the length of the feature vector that a word of as many different
letters has, and the kernel is raised to ``POWER``, a whole number, so it stays positive definite.
Letters put in between lower it a little; beforehand punctuation inside words is dropped, runs of one
letter become one, and letters set apart by blanks are joined. Spans over ``SPAN`` letters count nothing.

A sentence is a window of ``WINDOW`` neighbouring words; its kernel with another sentence is the sum
over their pairs of words. Landmarks are words and word beginnings, half of them such as set toxic
texts apart and half clean words that come nearest to those. Nyström's map with them (whitened by the
landmarks' own kernel) turns sentences into vectors, on which a linear support vector machine is
trained. Labels are of whole texts, and a toxic text need have only one toxic sentence: so each text
stands in for the machine by its most toxic sentence, as the machine of the round before sees it
(clean texts by those of all rounds). The greatest margin of a text's sentences, calibrated, is its
score: clean sentences around an insult don't dilute it.

Defined results
- A null or empty text has the empty sentence.
- Without labels of both classes every text scores the share of label 1 (0 if no labels).
- An input column ``score`` is left out; an empty table gives an empty result.
- Scores depend on the text only; repeated rows score equally. Whole texts are read, in blocks of a
  bounded number of letters; words seen before in a task are looked up, in a table that is emptied
  when it is full. A sentence may not reach over the ends of a block, which is cut at white space.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from layerkv.llm.common import col, map_arrow, others
from layerkv.llm.quality_model import logistic
from layerkv.llm.training import label_counts, sample

#: At most this many labelled rows of each class are learned from, and about this many bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12 << 20
LANDMARKS, PREFIXES = 32, (4, 5, 6, 7)
DECAY, SPAN, POWER = 0.8, 7, 3
WINDOW, TOP, ROUNDS, PENALTY = 4, 3, 5, 3e-4
#: What a text's most toxic sentence alone, and the same with a letter put in each of its words, count beside the sum of its sentences.
ALONE, PADDED = 0.3, 1.0
BLOCK, KNOWN, WORDS = 1 << 20, 1 << 20, 8192
TABLE_BITS = 18
START = 1  # the letter before each word

PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]  # second and third letter's distance from the first
WEIGHT = {b: DECAY ** (b + 1) for b in range(2, SPAN)}


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of three letters in order."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.astype(np.uint64)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words, each word led by ``START``, and the words' first places (one more at the end)."""
    codes = [np.frombuffer((chr(START) + w).encode("utf-32-le"), np.uint32) for w in words]
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)


def features(letters: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word number, hash, weight) of all subsequences, by the letters spanned."""
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for a, b in PAIRS:
        if len(letters) <= b:
            continue
        ok = np.flatnonzero(word[:-b] == word[b:])
        yield word[ok], triple(letters[ok], letters[ok + a], letters[ok + b]), WEIGHT[b]


def sizes(starts: np.ndarray) -> np.ndarray:
    """Length of the feature vector of words of as many different letters; 1 for words without features."""
    letters = np.diff(starts)
    return np.maximum(np.sqrt(sum((b - 1) * np.maximum(letters - b, 0) * WEIGHT[b] ** 2 for b in WEIGHT)), 1e-9)


class Kernel:
    """The kernel of any words with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        letters, starts = spelled(landmarks)
        size = sizes(starts)
        entries: dict[int, dict[int, float]] = {}
        for w, h, x in features(letters, starts):
            for i, k in zip(w.tolist(), h.tolist(), strict=True):
                row = entries.setdefault(k, {})
                row[i] = row.get(i, 0.0) + x / size[i]
        self.hashes = np.array(sorted(entries), np.uint64)
        rows = [sorted(entries[int(h)].items()) for h in self.hashes]
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.mark = np.array([i for r in rows for i, _ in r], np.int64)
        self.value = np.array([x for r in rows for _, x in r])
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(self.hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def of(self, letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each word, a column for each landmark."""
        key, value = [], []
        for w, h, x in features(letters, starts) if len(self.hashes) else ():
            few = np.flatnonzero(self.maybe[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[few])
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[few]
            few, at = few[hit], at[hit]
            count = self.offset[at + 1] - self.offset[at]
            entry = np.repeat(self.offset[at] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count, count) + np.arange(count.sum())
            key.append(np.repeat(w[few], count) * self.n + self.mark[entry]), value.append(self.value[entry] * x)
        n = len(starts) - 1
        sums = np.bincount(np.concatenate(key), np.concatenate(value), n * self.n) if key else np.zeros(n * self.n)
        return (sums.reshape(n, self.n) / sizes(starts)[:, None]) ** POWER


#: 0: dropped, 1: parts words, 2: a letter or digit.
_CLASS = np.full(0x110000, 2, np.uint8)
for _c in range(0x3000):
    _CLASS[_c] = 1 if _c == 0 or chr(_c).isspace() else 2 if chr(_c).isalnum() else 0
ODD = 0x9E3779B97F4A7C15 | 1


class Reader:
    """Words of many texts at once, as letters and hashes."""

    def __init__(self):
        inverse = pow(ODD, -1, 1 << 64)
        n = BLOCK + 2
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(ODD))]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]), dtype=np.uint64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters, the words' first places (one more at the end), their hashes and the texts they belong to.

        The texts have less than ``BLOCK`` letters together.
        """
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), np.uint32)
        kind = _CLASS[codes]
        used = np.flatnonzero(kind)
        used = used[np.concatenate([[True], (codes[used][1:] != codes[used][:-1]) | (kind[used][1:] != 2)])] if len(used) else used
        codes, kind = codes[used], kind[used]
        letter = kind == 2
        before = np.concatenate([[False], letter[:-1]])
        at = np.flatnonzero(letter & ~before)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        stop = np.flatnonzero(~letter & before)
        if len(stop) < len(at):
            stop = np.append(stop, len(letter))
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), used[at], "right")
        # Letters set apart by white space are joined to one word.
        single = stop - at == 1
        joined = np.concatenate([[False], single[1:] & single[:-1] & (owner[1:] == owner[:-1])])
        codes = codes[letter]
        starts = np.concatenate([[0], np.cumsum(stop - at)])
        starts, owner = np.append(starts[:-1][~joined], starts[-1]).astype(np.int64), owner[~joined]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(7)) * self.power[: len(codes)], dtype=np.uint64)])
        h = (sums[starts[1:]] - sums[starts[:-1]]) * self.back[starts[:-1]]
        return codes, starts, (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), owner


def pieces(text: str) -> Iterator[str]:
    """The text in runs of at most ``BLOCK // 2`` letters, cut at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + BLOCK // 2
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def clean_words(letters: np.ndarray, starts: np.ndarray) -> list[str]:
    text = letters.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [text[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def as_numbers(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """All words, and each text as the numbers of its words."""
    reader, number, out = Reader(), {}, []
    for t in texts:
        found = []
        for p in pieces(t.lower()):
            codes, starts, _, _ = reader.words([p])
            found += [number.setdefault(w, len(number)) for w in clean_words(codes, starts)]
        out.append(np.array(found, np.int64))
    return list(number), out


def choose_landmarks(vocabulary: list[str], texts: list[np.ndarray], toxic: np.ndarray, most: int | None = None) -> list[str]:
    """Words and beginnings that set toxic texts apart, and as many clean words like them.

    The former are taken one by one, by log odds; each halves the weight of the toxic texts it occurs in,
    so that later ones stand for texts that earlier ones don't. The latter are taken by how often they
    occur in clean texts and how near they come to one of the former.
    """
    number: dict[str, int] = {}
    parts = [[number.setdefault(x, len(number)) for x in (w, *(w[:k] for k in PREFIXES if len(w) > k))] if len(w) >= PREFIXES[0] else [] for w in vocabulary]
    names = list(number)
    found = [np.unique(np.array([x for w in np.unique(t).tolist() for x in parts[w]], np.int64)) for t in texts]
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, y in zip(found, toxic, strict=True) if y == k)]), minlength=len(names)) for k in (False, True)]
    odds = np.log((count[1] + 0.5) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1))
    good = (count[1] >= max(2, n1 // 200)) & (odds > 1)
    places: dict[int, list[int]] = {int(w): [] for w in np.flatnonzero(good)}
    for i in np.flatnonzero(toxic):
        for w in found[i][good[found[i]]].tolist():
            places[w].append(int(i))
    rows = {w: np.array(r) for w, r in places.items()}
    weight, chosen = np.ones(len(texts)), []
    while rows and len(chosen) < (most or LANDMARKS):
        best = max(rows, key=lambda w: (round(float(odds[w] * weight[rows[w]].sum()), 9), len(names[w]), names[w]))
        if odds[best] * weight[rows[best]].sum() < 0.5:
            break
        chosen.append(names[best])
        weight[rows.pop(best)] *= 0.5
    if not chosen:
        return []
    seen = np.bincount(np.concatenate([np.unique(t) for t, y in zip(texts, toxic, strict=True) if not y]), minlength=len(vocabulary))
    usual = [w for w in np.flatnonzero(seen > 0).tolist() if len(vocabulary[w]) >= PREFIXES[0] and odds[number[vocabulary[w]]] < 0]
    kernel, near = Kernel(chosen), []
    for k in range(0, len(usual), WORDS):
        near.append(kernel.of(*spelled([vocabulary[w] for w in usual[k : k + WORDS]])).max(axis=1))
    rank = np.concatenate([np.zeros(0), *near]) * np.log1p(seen[usual]) if usual else np.zeros(0)
    best = sorted(range(len(usual)), key=lambda i: (-round(float(rank[i]), 9), vocabulary[usual[i]]))
    return chosen + [vocabulary[usual[i]] for i in best[: len(chosen)]]


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: tuple[float, ...]  # of a word's kernels: map, whitening, machine and calibration in one
    bias: float


def machine(x: np.ndarray, y: np.ndarray, importance: np.ndarray, penalty: float | None = None, steps: int = 50) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton's method on its support vectors; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    sign, w = 2 * y - 1, np.zeros(x.shape[1])
    keep = (PENALTY if penalty is None else penalty) * importance.sum() * np.eye(x.shape[1])
    keep[-1, -1] = 1e-8
    for _ in range(steps):
        support = sign * (x @ w) < 1
        a = x[support] * importance[support][:, None]
        new = np.linalg.solve(a.T @ x[support] + keep, a.T @ sign[support])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def sentences(words: int) -> np.ndarray:
    """Places of the first words of a text's sentences."""
    return np.arange(0, words, WINDOW)


def most_toxic(values: np.ndarray) -> np.ndarray:
    """The ``TOP`` sentences of the greatest sums of word values, and their sums."""
    sums = np.add.reduceat(values, sentences(len(values))) if len(values) else np.zeros(1)
    return np.argsort(-sums, kind="stable")[:TOP]


def margin_of(values: np.ndarray) -> float:
    sums = np.add.reduceat(values, sentences(len(values))) if len(values) else np.zeros(1)
    return float(np.sort(sums)[::-1][:TOP].sum())


def padded(word: str) -> str:
    """The word with a letter put in, at a place and of a kind that follow from the word."""
    h = zlib.crc32(word.encode("utf-8", "replace"))
    at = 1 + h % max(1, len(word) - 1)
    return word[:at] + "qxjkzv"[h // 64 % 6] + word[at:]


def sentence_machine(kernels: np.ndarray, gapped: np.ndarray, whiten: np.ndarray, texts: list[np.ndarray], y: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each landmark's kernel and bias, trained on the most toxic sentences of each text by rounds."""
    mean = lambda t: kernels[t].mean(axis=0) if len(t) else np.zeros(kernels.shape[1])
    a = machine(np.array([mean(t) for t in texts]) @ whiten * WINDOW, y, importance)
    clean: list[dict[tuple, np.ndarray]] = [{} for _ in texts]
    for _ in range(ROUNDS):
        values = kernels @ (whiten @ a[:-1])
        x, target, weight = [], [], []
        for i, t in enumerate(texts):
            chosen = most_toxic(values[t])
            sums = np.array([kernels[t[k * WINDOW : (k + 1) * WINDOW]].sum(axis=0) for k in chosen])
            rows = {tuple(sorted(chosen.tolist())): sums.sum(axis=0), (int(chosen[0]),): sums[0]}
            if y[i] == 0:
                rows = clean[i] = clean[i] | rows
            else:
                rows[-1,] = gapped[t[chosen[0] * WINDOW : (chosen[0] + 1) * WINDOW]].sum(axis=0)
            x += rows.values()
            target += [y[i]] * len(rows)
            share = [PADDED if k == (-1,) else ALONE if len(k) == 1 < len(chosen) else 1.0 for k in rows]
            weight += [importance[i] * k / sum(share) for k in share]
        a = machine(np.array(x) @ whiten, np.array(target), np.array(weight))
    return whiten @ a[:-1], float(a[-1])


def fit(rows: list[tuple[str, int]], counts: tuple[int, int]) -> Model:
    share = counts[1] / sum(counts) if sum(counts) else 0.0
    prior = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    y = np.array([k for _, k in rows], float)
    vocabulary, texts = as_numbers([t or "" for t, _ in rows])
    landmarks = choose_landmarks(vocabulary, texts, y == 1) if 0 < y.sum() < len(y) else []
    if not landmarks:
        return Model((), (), prior)
    kernel = Kernel(landmarks)
    value, vector = np.linalg.eigh(kernel.of(*spelled(landmarks)))
    whiten = vector @ np.diag(np.maximum(value, 1e-2) ** -0.5) @ vector.T
    kernels = np.concatenate([kernel.of(*spelled(vocabulary[k : k + WORDS])).astype(np.float32) for k in range(0, len(vocabulary), WORDS)])
    gapped = np.zeros_like(kernels)
    used = np.unique(np.concatenate([t for t, k in zip(texts, y, strict=True) if k]))
    for k in range(0, len(used), WORDS):
        gapped[used[k : k + WORDS]] = kernel.of(*spelled([padded(vocabulary[w]) if len(vocabulary[w]) >= PREFIXES[0] else vocabulary[w] for w in used[k : k + WORDS]]))
    importance = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    margin = np.zeros(len(y))
    half = np.arange(len(y)) % 2 == 0
    for part in (half, ~half):  # margins for the calibration come from a machine that hasn't seen the text
        if len(set(y[~part])) == 2:
            w, bias = sentence_machine(kernels, gapped, whiten, [t for t, k in zip(texts, part, strict=True) if not k], y[~part], importance[~part])
            values = kernels @ w
            margin[part] = [margin_of(values[t]) + bias for t, k in zip(texts, part, strict=True) if k]
    w, bias = sentence_machine(kernels, gapped, whiten, texts, y, importance)
    scale, shift = logistic(np.c_[margin, np.ones(len(y))], y, importance, ridge=1e-3)
    return Model(tuple(landmarks), tuple(map(float, scale * w)), float(scale * bias + shift))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "toxic", SAMPLE_ROWS, SAMPLE_BYTES), label_counts(labels, "toxic"))


class Scorer:
    """Scores for one task; words already met are looked up."""

    def __init__(self, model: Model):
        self.model = model
        self.kernel, self.reader, self.weights = Kernel(list(model.landmarks)), Reader(), np.array(model.weights)
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def learn(self, codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> None:
        """Values of the words that are new."""
        new, first = np.unique(hashes, return_index=True)
        if len(self.known) > KNOWN:
            self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
            fresh = self.known[at] != new
            new, first = new[fresh], first[fresh]
        if not len(new):
            return
        found = [self._values(codes, starts, first[k : k + WORDS]) for k in range(0, len(first), WORDS)]
        keys, values = np.concatenate([self.known, new]), np.concatenate([self.values, *found])
        order = np.argsort(keys, kind="stable")
        self.known, self.values = keys[order], values[order]

    def _values(self, codes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
        length = starts[which + 1] - starts[which]
        lead = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int64)
        letters = np.full(lead[-1], START, np.uint32)
        inside = np.repeat(starts[which] - lead[:-1] - 1, length + 1) + np.arange(lead[-1])
        body = np.ones(lead[-1], bool)
        body[lead[:-1]] = False
        letters[body] = codes[inside[body]]
        return self.kernel.of(letters, lead) @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.model.bias)
        if self.model.landmarks:
            parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t.lower())]
            tops: dict[int, np.ndarray] = {}
            at = 0
            while at < len(parts):
                size, end = len(parts[at][1]), at + 1
                while end < len(parts) and size + len(parts[end][1]) + 1 < BLOCK:
                    size += len(parts[end][1]) + 1
                    end += 1
                codes, starts, hashes, owner = self.reader.words([p for _, p in parts[at:end]])
                if len(hashes):
                    self.learn(codes, starts, hashes)
                    values = self.values[np.searchsorted(self.known, hashes)]
                    cuts = np.searchsorted(owner, np.arange(end - at + 1))
                    for k, (i, _) in enumerate(parts[at:end]):
                        own = values[cuts[k] : cuts[k + 1]]
                        if len(own):
                            sums = np.add.reduceat(own, sentences(len(own)))
                            sums = np.concatenate([tops[i], sums]) if i in tops else sums
                            tops[i] = np.sort(sums)[::-1][:TOP]
                at = end
            for i, sums in tops.items():
                z[i] += sums.sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``df`` with ``score`` in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = others(df, text, "score")
    schema = df.select(*map(col, rest)).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores([t.as_py() or "" for t in batch.columns[-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*rest, "score"])

    return map_arrow(df.select(*map(col, [*rest, text])), run, schema)
