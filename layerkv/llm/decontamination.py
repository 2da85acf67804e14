"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Items are cut in overlapping windows: long ones, which bear more edits, and short ones, so that an
exact run of ``SURE`` characters of an item (or all of a shorter one) is always found. If a window of ``n`` characters occurs in a text with at most
``e`` edits, the two share at least ``n + 1 - q - q e`` q-grams, and these lie on at most ``e + 1``
neighbouring diagonals (place in the text less place in the window). So shared q-grams are counted
in diagonal bands twice that wide that overlap by half; a band that reaches the bound is kept and
aligned, within the band, and a window that aligns within its budget is a finding.

Defined results
- Case is ignored and a run of white space is one space; places are code points of the text as given.
- The budget is ``EDITS`` of the window's length, or less where the lemma would allow 0 shared
  q-grams. An item shorter than ``Q`` is found only as the whole of a text.
- A null or empty text, or item, is never found. Items of equal text are found each for itself, whatever
  their ids, which may be null, repeated or of any type; repeated documents too. Empty tables give an empty
  result, and names of other columns don't matter.
- Each pair of document and item gives one row, with its alignment of least edits, the first of these. An
  item of more than ``BLOCK`` characters is searched for in pieces that overlap, each an item for itself.
- Texts are read whole. Items are sent in blocks of about ``BLOCK`` characters, one after another, so any
  number of them can be searched for; each block is compared with all texts. Equal texts are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from layerkv.llm.common import col, map_arrow, materialize

Q, WINDOW, STRIDE, WHOLE, EDITS = 10, 120, 60, 160, 0.08
#: Windows beside these, for short passages.
SHORT, STEP = 60, 20
#: An exact run of so many characters of an item is always found: wherever it begins, it holds a short window.
SURE = SHORT + STEP - 1
#: Characters of items in one block, of one part of an item, of its overlap with the next, and of texts that are looked at together.
BLOCK, PART, OVERLAP, TEXT_BLOCK = 1 << 22, 1 << 16, 1 << 10, 1 << 19
TABLE_BITS = 22
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = 32


@lru_cache(1)
def folding() -> np.ndarray:
    """Code point to its lower case where that is one code point; white space to a space."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        s = chr(c)
        if s.isspace():
            out[c] = SPACE
        elif len(low := s.lower()) == 1:
            out[c] = ord(low)
    return out


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single spaces, and the place of each in the text."""
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    space = codes == SPACE
    kept = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    return codes[kept], kept


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each place on, by doubling."""
    parts, have = {1: codes.astype(np.uint64) + np.uint64(1)}, 1
    while have * 2 <= q:
        h, power = parts[have], np.uint64(pow(BASE, have, 1 << 64))
        parts[have * 2] = h[:-have] * power + h[have:] if len(h) > have else h[:0]
        have *= 2
    out, done = parts[have], have
    for k in sorted(parts, reverse=True):
        while done + k <= q:
            n = max(0, len(codes) - done - k + 1)
            out, done = out[:n] * np.uint64(pow(BASE, k, 1 << 64)) + parts[k][done : done + n], done + k
    return out ^ (out >> np.uint64(32))


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def align(window: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of all of ``window`` on diagonals ``low`` to ``high``, if within ``most`` edits."""
    offsets = np.arange(low, high + 1)
    steps = np.arange(len(offsets))
    inside = (offsets >= 0) & (offsets <= len(text))
    cost = np.where(inside, 0, 1 << 20)
    start = offsets.copy()
    far = np.array([1 << 20])
    for i, c in enumerate(window):
        at = offsets + i
        ok = (at >= 0) & (at < len(text))
        same = cost + np.where(ok, text[np.clip(at, 0, len(text) - 1)] != c, 1 << 20)
        skip = np.concatenate([cost[1:], far]) + 1
        take = skip < same
        new, start = np.where(take, skip, same), np.where(take, np.concatenate([start[1:], start[-1:]]), start)
        lead = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == lead, steps, 0))
        cost, start = lead + steps, start[source]
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    return (int(cost[best]), int(start[best]), int(offsets[best] + len(window))) if cost[best] <= most else None


class Index:
    """q-grams of the windows of some items."""

    def __init__(self, items: tuple[str, ...]):
        self.window, self.item, self.most, self.least, self.whole = [], [], [], [], {}
        for k, text in enumerate(items):
            codes, _ = normal(text)
            if len(codes) and codes[-1] == SPACE:
                codes = codes[:-1]
            n = len(codes)
            if n < Q:
                if n:
                    self.whole.setdefault(codes.tobytes(), []).append(k)
                continue
            cuts = [(0, n)] if n <= WHOLE else [(a, a + WINDOW) for a in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]
            cuts += [(a, a + SHORT) for a in [*range(0, n - SHORT, STEP), n - SHORT]] if n > SHORT else []
            for a, b in cuts:
                self.window.append(codes[a:b])
                self.item.append(k)
                self.most.append(min(int(EDITS * (b - a)), (b - a - Q) // Q))
                self.least.append(b - a + 1 - Q - Q * self.most[-1])
        hashes = [grams(w) for w in self.window]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash, first = np.unique(every[order], return_index=True)
        self.offset = np.append(first, len(every))
        self.post_window = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.post_place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.zeros(0, int)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.hash)] = True
        self.width = np.array(self.most, np.int64) + 1
        self.bound = np.array(self.least, np.int64)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), one for each text and item."""
        out, at = [], 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) < TEXT_BLOCK:
                size += len(texts[end])
                end += 1
            out += [(at + t, *rest) for t, *rest in self._find(texts[at:end])]
            at = end
        return out

    def _find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        codes, places = normal("\0".join(texts))
        origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        starts = np.searchsorted(places, origin)
        starts[-1] = len(codes) + 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.whole:
            for t, text in enumerate(texts):
                own, place = normal(text)
                trimmed = own[:-1] if len(own) and own[-1] == SPACE else own
                for k in self.whole.get(trimmed.tobytes(), ()) if len(trimmed) else ():
                    best[t, k] = (0, int(place[0]), int(place[len(trimmed) - 1]) + 1)
        hashes = grams(codes)
        at = np.flatnonzero(self.table[slot(hashes)]) if len(self.hash) else np.zeros(0, int)
        found = np.searchsorted(self.hash, hashes[at])
        hit = self.hash[np.minimum(found, len(self.hash) - 1)] == hashes[at] if len(at) else np.zeros(0, bool)
        at, found = at[hit], found[hit]
        if len(at):
            count = self.offset[found + 1] - self.offset[found]
            entry = np.repeat(self.offset[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            window = self.post_window[entry]
            diagonal = np.repeat(at, count) - self.post_place[entry] + WHOLE
            band = diagonal // self.width[window]
            span = len(codes) + 2 * WHOLE + 2
            first = window * span + band
            keys, counts = np.unique(first, return_counts=True)
            nearby = np.searchsorted(keys, keys + 1)
            follows = np.zeros(len(keys), np.int64)
            ok = nearby < len(keys)
            ok[ok] = keys[nearby[ok]] == keys[ok] + 1
            follows[ok] = counts[nearby[ok]]
            # Band b is the diagonals of cells b and b + 1; a cell whose predecessor is empty also ends a band alone.
            alone = ~np.isin(keys - 1, keys)
            band_key = np.concatenate([keys, keys[alone] - 1])
            band_count = np.concatenate([counts + follows, counts[alone]])
            full = band_count >= self.bound[(band_key + 1) // span]
            band_key, band_count = band_key[full], band_count[full]
            for k in np.argsort(-band_count, kind="stable"):
                w = int((band_key[k] + 1) // span)
                self._verify(w, int(band_key[k] - w * span), codes, places, starts, origin, best)
        return [(t, k, a, b, e) for (t, k), (e, a, b) in sorted(best.items())]

    def _verify(self, w: int, band: int, codes: np.ndarray, places: np.ndarray, starts: np.ndarray, origin: np.ndarray, best: dict) -> None:
        window, most, width = self.window[w], self.most[w], int(self.width[w])
        low, high = band * width - WHOLE, (band + 2) * width - 1 - WHOLE
        a, b = max(0, low - most), min(len(codes), high + len(window) + most)
        # A band may reach into neighbouring texts; a passage lies in one of them.
        for t in range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b - 1, "right"))):
            x, y = max(a, int(starts[t])), min(b, int(starts[t + 1]) - 1)
            if y - x < len(window) - most:
                continue
            text = codes[x:y]
            exact = text.tobytes().find(window.tobytes())
            if exact >= 0 and exact % 4 == 0:
                found = (0, exact // 4, exact // 4 + len(window))
            else:
                found = align(window, text, low - x - most, high - x + most, most)
            if found is None:
                continue
            edits, start, end = found
            start, end = int(places[x + start]), int(places[x + end - 1]) + 1
            key, value = (t, self.item[w]), (edits, start - int(origin[t]), end - int(origin[t]))
            best[key] = min(best.get(key, value), value)


@lru_cache(2)
def index(items: tuple[str, ...]) -> Index:
    return Index(items)


def parts(items: DataFrame, text: str = "text") -> DataFrame:
    """``_key, _part, _group`` of each distinct text of ``items`` in parts of ``PART`` characters, with single spaces; a group comes up to ``BLOCK``."""
    plain = F.regexp_replace(col(text), r"(?U)\s+", " ")
    rows = items.select(plain.alias("t")).where("t IS NOT NULL").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - 1 - OVERLAP, F.lit(0)), F.lit(PART - OVERLAP))
    return rows.select(F.md5(F.col("t").cast("binary")).alias("_key"), F.explode(starts).alias("_at"), "t").select("_key", F.substr("t", F.col("_at") + 1, F.lit(PART)).alias("_part"), F.floor(F.col("_at") / BLOCK).alias("_group"))


def part_blocks(items: DataFrame, text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """(key, part) of all parts, in blocks that come up to about ``BLOCK`` characters.

    Groups of parts are dealt by a hash to buckets, of which there are more than parts; buckets are packed by
    their sizes, a row for each bucket.
    """
    rows = materialize(parts(items, text))
    n = 2 * (rows.agg(F.coalesce(F.sum(F.length("_part")), F.lit(0))).first()[0] // PART) + 1
    bucket = F.pmod(F.xxhash64("_key", "_group"), F.lit(n))
    sizes = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.sum(F.length("_part")).alias("n")).collect()}
    block, size = [], 0
    for b in [*sorted(sizes), None]:
        if block and (b is None or size + sizes[b] > BLOCK):
            yield [(r["_key"], r["_part"]) for r in rows.where(bucket.isin(block)).orderBy("_key", "_part").collect()]
            block, size = [], 0
        if b is not None:
            block.append(b)
            size += sizes[b]


def findings(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for each document that holds a passage of an item."""
    one = docs.select(col(doc_id).alias("d"), col(text).alias("t"))
    schema = one.select("d").schema.add("_key", "string").add("start", "long").add("end", "long").add("edits", "integer")
    out = None
    for block in part_blocks(items):
        found = map_arrow(one, _finder(docs, block, schema), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    ids = items.select(col(item_id).alias("_item"), F.md5(F.regexp_replace("text", r"(?U)\s+", " ").cast("binary")).alias("_key")).where("_key IS NOT NULL")
    return out.join(ids, "_key").select(F.col("d").alias(doc_id), F.col("_item").alias(item_id), "start", "end", "edits")


def _finder(docs: DataFrame, block: list[tuple], schema: StructType):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts = zip(*shared.value, strict=True)
        search = index(texts)
        for batch in batches:
            rows = search.find([t.as_py() or "" for t in batch.columns[1]])
            best: dict[tuple, tuple] = {}
            for t, k, a, b, e in rows:  # parts of one item
                best[t, keys[k]] = min(best.get((t, keys[k]), (e, a, b)), (e, a, b))
            if best:
                t, k = zip(*best, strict=True)
                e, a, b = zip(*best.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.columns[0].take(pa.array(t, pa.int64())), pa.array(k, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int32())], names=schema.names
                )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns kept."""
    out, at = docs, docs.columns.index(text)
    for block in part_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(t for _, t in block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = index(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in search.find([t.as_py() or "" for t in batch.columns[at]])]] = False
                yield batch.filter(pa.array(keep))

        out = map_arrow(out, run, docs.schema)
    return out
