"""Near-duplicate classes by weighted minwise hashing with darts.

A text is the multiset of its shingles of five words. Over every shingle lies a region, as wide as
the shingle occurs often, on which darts fall: a random process, the same for equal shingles
everywhere, gives each dart a place in the region, a rank and a coordinate. A text keeps, for each
coordinate, the earliest dart that hits one of its regions; two texts agree on a coordinate with the
probability of their weighted Jaccard similarity. A text's darts up to a rank are thrown, as many as
fill all coordinates for nearly all texts, so a signature costs the shingles once plus a fixed number
of darts; where a coordinate stays empty, twice the rank is thrown. A second signature of the regions'
first unit of width stands for the set of shingles, and differs only where shingles repeat.

Texts are linked if the Jaccard similarity of their shingle sets or multisets is ``SIMILARITY`` or
more. Signatures only propose links: equal word sequences are merged first, then texts that share a
band of coordinates are compared exactly, by their shingles: first with one of them, the one that
shares most bands with others, which finds the middle of a group of near copies. Where a band's texts
then still are in several classes (connected components, found by star contraction), all pairs of
different classes are compared, in blocks of ``BLOCK_OF`` by ``BLOCK_OF`` texts. A pair is compared in
the first band it shares, and only if the counts of its shingles by buckets don't rule it out; a link
that is found merges classes within the block. So every pair that shares a band is compared or already
connected. Pairs at the threshold share one of the 32 bands of 5 coordinates with probability 0.999997.
The comparisons that are left grow with the square of the texts of a band that aren't connected.

Defined results
- One row for each row of the input: its id and ``class_id``, the least id of its class.
- Words are runs without ASCII white space. Texts of fewer than five words have one shingle. Null and
  empty texts have none; they form one class, as texts of equal words do.
- Rows are told apart by a number of their own, so null and repeated ids change no class: rows of
  one id whose texts differ can be of two classes. A class without any id has the null class id. An empty
  table gives an empty result; further columns are ignored.
- No bucket, class or list of partners is capped; none is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from layerkv.llm.common import Scratch, col, map_arrow, materialize
from layerkv.llm.shingles import BASE, blocks, mix, powers, shingled

SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Darts a text expects: all coordinates are hit with probability exp(-exp(-3)).
DARTS = COORDINATES * (float(np.log(COORDINATES)) + 3)
ID_BITS = 40
#: Texts of a band in one block, and buckets in which their shingles are counted.
BLOCK_OF, BUCKETS = 512, 256
U1, U2, U3 = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def times(a: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(a) * n & 0xFFFFFFFFFFFFFFFF)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDINATES) earliest darts of ``n`` weighted sets; sets without elements get zeros.

    The region of an element of weight ``w`` is ``[0, w)``, in layers ``[0, 1), [1, 2), [2, 4), ...``
    that have darts of their own: the k-th dart of a layer of width ``d`` comes after a waiting time
    of mean ``1 / d``, at a uniform place in the layer, and counts if its place is below ``w``.
    """
    out = np.zeros((n, COORDINATES), np.uint64)
    total = np.bincount(owner, weight, n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = DARTS / total[todo]
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        _throw(owner[mine], element[mine], weight[mine], reach, out)
        todo = todo[(out[todo] == 0).any(axis=1)]
        reach[todo] *= 2
    return out


def _throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, out: np.ndarray) -> None:
    earliest = np.full(out.size, np.inf)
    flat, rank, dart = [], [], []
    layer = 0
    while len(element):
        low, width = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0 ** (layer - 1))
        seed = mix(element * U1 + times(U2, layer))
        who, most, until, time = owner, weight, reach[owner], np.zeros(len(element))
        step = 0
        while len(seed):
            h = mix(seed + times(U3, step))
            time = time - np.log(uniform(h)) / width
            alive = np.flatnonzero(time <= until)
            if not len(alive):
                break
            seed, who, most, until, time, h = seed[alive], who[alive], most[alive], until[alive], time[alive], h[alive]
            place = mix(h ^ U2)
            hit = slice(None) if layer == 0 else np.flatnonzero(low + width * uniform(place) < most)
            flat.append(who[hit] * COORDINATES + (mix(h ^ U1)[hit] % np.uint64(COORDINATES)).astype(np.int64))
            rank.append(time[hit])
            dart.append(h[hit] | np.uint64(1))
            step += 1
        layer += 1
        more = np.flatnonzero(weight > 2.0 ** (layer - 1))
        owner, element, weight = owner[more], element[more], weight[more]
    if flat:
        at, when, what = np.concatenate(flat), np.concatenate(rank), np.concatenate(dart)
        np.minimum.at(earliest, at, when)
        first = when == earliest[at]
        out.reshape(-1)[at[first]] = what[first]


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; texts that agree on a band's coordinates have equal keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * U3, (len(signature), BANDS))
    for k in range(ROWS):
        key = mix(key * np.uint64(BASE) + parts[:, :, k])
    return key


def counted(shingle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text; shingles keep ``ID_BITS`` bits."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(ID_BITS)) | (shingle >> np.uint64(64 - ID_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(ID_BITS)).astype(np.int64), key[first] & np.uint64((1 << ID_BITS) - 1), count


def fingerprints(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words, both 0 for texts without words."""
    out = np.zeros((2, n), np.uint64)
    if len(words):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
        for k, base in enumerate((0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)):
            out[k, text[first]] = mix(np.add.reduceat(mix(words + np.uint64(k)) * powers(base, int(place.max()) + 1)[place], first))
    return out[0], out[1]


def shingle_bytes(who: np.ndarray, what: np.ndarray, count: np.ndarray, n: int) -> list[bytes]:
    """Each text's shingles as sorted 32-bit numbers, even for a shingle's first occurrence in its text, odd for later ones."""
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    who, what = np.repeat(who, count), np.repeat(what, count)
    small = (mix(what * U1 + which.astype(np.uint64) * U2) >> np.uint64(32)).astype(np.uint32)
    small = (small & np.uint32(0xFFFFFFFE)) | (which > 0).astype(np.uint32)
    key = np.sort((who.astype(np.uint64) << np.uint64(32)) | small)
    cut = np.searchsorted(key >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
    small = key.astype(np.uint32)
    return [small[cut[i] : cut[i + 1]].tobytes() for i in range(n)]


def sketches(docs: DataFrame) -> DataFrame:
    """``id, text`` and other columns, with ``hi, lo, keys, shingles`` in place of the text.

    ``hi`` and ``lo`` are the fingerprint of the text's words, ``keys`` its band keys: ``BANDS`` of them, by
    band, or twice as many where shingles repeat, the second half for the set.
    """
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("hi", "long").add("lo", "long").add("keys", ArrayType(LongType())).add("shingles", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            hi, lo, keys, sets = np.zeros(size, np.uint64), np.zeros(size, np.uint64), [np.zeros(0, np.int64)] * size, [b""] * size
            for at, words, owner in blocks(batch.columns[-1]):
                n = int(owner[-1]) + 1 if len(owner) else 0
                if not n:
                    continue
                hi[at : at + n], lo[at : at + n] = fingerprints(words, owner, n)
                who, what, count = counted(*shingled(words, owner))
                sets[at : at + n] = shingle_bytes(who, what, count, n)
                heavy = np.zeros(n, bool)
                heavy[who[count > 1]] = True
                full = bands(signatures(who, what, count.astype(float), n)).view(np.int64)
                units = {}
                if heavy.any():
                    place = np.cumsum(heavy) - 1
                    some = heavy[who]
                    unit = bands(signatures(place[who[some]], what[some], np.ones(int(some.sum())), int(heavy.sum()))).view(np.int64)
                    units = {int(i): unit[k] for k, i in enumerate(np.flatnonzero(heavy))}
                for i in np.unique(owner).tolist():
                    keys[at + i] = np.concatenate([full[i], units[i]]) if i in units else full[i]
            lengths = np.cumsum([0, *map(len, keys)])
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists, pa.array(sets, pa.binary())], names=schema.names)

    return map_arrow(docs.select(*rest, "text"), run, schema)


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether the sets or the multisets are similar enough."""
    if min(len(a), len(b)) == 0:
        return False
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.intersect1d(x, y, assume_unique=True)
    first = int((both & 1 == 0).sum())
    sets = first >= similarity * (int((x & 1 == 0).sum()) + int((y & 1 == 0).sum()) - first)
    return sets or len(both) >= similarity * (len(x) + len(y) - len(both))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of ids whose texts are alike. ``sets`` has ``id, shingles``, one row for each id."""
    b, a = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    rows = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "x", "y")
    schema = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, run, schema)


def unions(block: pa.Table, similarity: float) -> Iterator[tuple]:
    """Links ``a, b`` that connect all alike texts of one block pair whose classes differ."""
    ids, part = block["id"].to_pylist(), block["block"].to_numpy()
    first = int(block["band"][0].as_py())
    _, root = np.unique(np.array(block["root"].to_pylist()), return_inverse=True)
    if (root == root[0]).all():
        return
    texts = [x.as_buffer() for x in block["shingles"]]
    numbers = [np.frombuffer(x, np.uint32) for x in texts]
    keys = [np.array(k, np.int32) for k in block["keys"].to_pylist()]
    ahead = np.stack([np.stack([k[:first], k[-BANDS:][:first]]) for k in keys])
    # Shingles of the set and of the multiset, by buckets: the sums of the lesser counts bound what two texts share.
    counts = np.stack([np.stack([np.bincount((x[keep] >> 1) % BUCKETS, minlength=BUCKETS) for keep in (x & 1 == 0, slice(None))]) for x in numbers]).astype(np.int32)
    sizes = counts.sum(axis=2)
    two = part.min() != part.max()
    for i in range(len(ids) - 1):
        other = np.arange(i + 1, len(ids))
        other = other[(root[other] != root[i]) & ((part[other] != part[i]) | (not two))]
        low, high = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[(low >= similarity * high).any(axis=1)]
        for x in range(2):
            for y in range(2):
                other = other[~(ahead[other, x] == ahead[i, y]).any(axis=1)]
        both = np.minimum(counts[other], counts[i]).sum(axis=2)
        other = other[(both >= similarity * (sizes[other] + sizes[i] - both)).any(axis=1)]
        for j in other.tolist():
            if root[j] != root[i] and alike(texts[i], texts[j], similarity):
                yield ids[i], ids[j]
                root[root == root[j]] = root[i]


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` between the classes of each block pair of ``key, i, j, block, band, id, root, keys, shingles``."""
    near = ["key", "i", "j"]
    rows = rows.repartition(*near).sortWithinPartitions(*near)
    schema = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            found = []
            if batch is not None:
                more = pa.Table.from_batches([batch])
                rest = more if rest is None else pa.concat_tables([rest, more])
            if rest is None or not rest.num_rows:
                continue
            at = np.stack([rest[c].to_numpy() for c in near])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            cuts += [rest.num_rows] if batch is None else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high - low > 1:
                    found += unions(rest.slice(low, high - low), similarity)
            rest = rest.slice(cuts[-1])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch_type), pa.array(b, batch_type)], names=schema.names)

    batch_type = to_arrow_type(schema[0].dataType)
    return map_arrow(rows, run, schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``, root the least node connected to it.

    Large and small stars by turns: each node's neighbours above it are tied to its least neighbour,
    then its neighbours below it are. Both only group and join by node, and the edges never grow.
    """
    edges = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.select("u", F.col("m").alias("v")).unionByName(tied).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        old, now = (e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for e in (edges, new))
        edges = new
        if old == now:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def starred(members: DataFrame, key: list[str]) -> DataFrame:
    """Pairs ``a, b`` of one member of each group, the one of the greatest ``rank``, with the members of other classes."""
    one = members.groupBy(*key).agg(F.max_by(F.struct("id", "root"), F.struct("rank", "id")).alias("_one"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
    pairs = members.join(one.select(*key, F.col("_one.id").alias("_one"), F.col("_one.root").alias("_its")), key).where("root <> _its")
    return pairs.select(F.least("_one", "id").alias("a"), F.greatest("_one", "id").alias("b")).distinct()


def rooted(rows: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """``hi, lo, root, least`` of each sequence of words: its class, named by a number of one of the class's rows, and its least id.

    ``rows`` has ``node, id, hi, lo, keys, shingles``; texts of equal words go on as one, by their least node.
    """
    exact = rows.groupBy("hi", "lo").agg(F.min("node").alias("id"), F.min("id").alias("least"), F.first("keys").alias("keys"))
    band_keys = F.expr(f"if(size(keys) > 0, array_distinct(transform(sequence(0, size(keys) - 1), p -> struct(keys[p] AS key, p % {BANDS} AS band))), NULL)")
    members = exact.select("id", F.explode(band_keys).alias("c")).select("id", "c.*")
    shared = members.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count(F.lit(1)).alias("n")).where("_low < _high").select("key", "n")
    members = scratch.write(members.join(shared, "key"))
    sets = scratch.write(rows.select(F.col("node").alias("id"), "shingles").join(members.select("id").distinct().hint("merge"), "id", "left_semi"))

    # All texts of a band with the one that shares the most bands with others.
    popular = members.groupBy("id").agg(F.sum("n").alias("rank"))
    pairs = scratch.write(starred(members.select("id", "key", F.col("id").alias("root")).join(popular.hint("merge"), "id"), ["key"]))
    links = scratch.write(verified(pairs, sets, similarity))
    roots = components(links, scratch)

    # Where a band's texts are in several classes still: all pairs of different classes.
    open_ = members.join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select("id", "key", "band", F.coalesce("root", "id").alias("root"))
    several = open_.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low < _high AND _n > 2").select("key", "_n")
    parts = F.ceil(F.col("_n") / BLOCK_OF)
    groups = open_.join(several, "key").withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    groups = scratch.write(groups.select("id", "key", "band", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    if not groups.isEmpty():
        full = sets.join(groups.select("id").distinct().hint("merge"), "id", "left_semi").join(exact.select("id", F.expr("transform(keys, k -> cast(shiftright(k, 32) AS int))").alias("keys")).hint("merge"), "id")
        found = scratch.write(compared(groups.join(full.hint("merge"), "id"), similarity))
        if not found.isEmpty():
            roots = components(links.unionByName(found), scratch)
    return exact.select("hi", "lo", "id", "least").join(roots, F.col("id") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "id").alias("root"), "least")


def grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """``docs`` (``id, text`` and others) with ``root`` in place of the text, written down."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(sketches(docs).withColumn("node", F.monotonically_increasing_id()))
    kept = [c for c in docs.columns if c != "text"]
    named = rooted(rows, similarity, scratch).select("hi", "lo", "root")
    out = materialize(rows.select(*kept, "hi", "lo").join(named.hint("merge"), ["hi", "lo"]).select(*kept, "root"))
    scratch.drop()
    return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of every row."""
    rows = grouped(docs.select(col(doc_id).alias("id"), col(text).alias("text")), similarity)
    named = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.join(named.hint("merge"), "root").select(F.col("id").alias(doc_id), "class_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one row, that of the least id.

    Null ids come last and texts of one id by a hash, so every class keeps a row, whatever its ids are. Of
    repeated rows (of equal id and text; a null text equals the empty one) the least by all columns stays.
    """
    plain = F.coalesce(col(text), F.lit(""))
    first, second, void = F.xxhash64(plain), F.xxhash64(F.lit(1), plain), col(doc_id).isNull()
    rows = grouped(docs.select(col(doc_id).alias("id"), first.alias("h"), second.alias("k"), col(text).alias("text")), similarity)
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("_void"), F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("k").alias("_k"))).alias("r")).select("r.*")
    repeated = rows.groupBy("id", "h", "k").count().where("count > 1").select("id", "h", "k")
    chosen = materialize(chosen.join(repeated.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("k") == F.col("_k")), "left").select("_void", "_id", "_h", "_k", F.col("h").isNotNull().alias("_many")))
    mine = lambda c: col(doc_id).eqNullSafe(c["_id"]) & (first == c["_h"]) & (second == c["_k"])
    once = chosen.where("NOT _many")
    out = docs.join(once.hint("merge"), mine(once), "left_semi")
    many = chosen.where("_many")
    if not many.isEmpty():  # in the task that reads them, repeats become one row before they are shuffled
        again = docs.join(many.hint("merge"), mine(many), "left_semi")
        least = again.groupBy(void.alias("_void"), col(doc_id).alias("_id"), first.alias("_h"), second.alias("_k")).agg(F.min(F.struct(*map(col, docs.columns))).alias("r"))
        out = out.unionByName(least.select("r.*"))
    return out.select(*map(col, docs.columns))
