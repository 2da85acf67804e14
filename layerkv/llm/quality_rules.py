"""Rule-based text quality: counts of words, symbols and repeats, and a likelihood ratio of n-grams.

Words and pairs of neighbouring words are hashed to buckets (by CRC-32, so that SQL can do the same)
and counted in two multinomials, one over the whole corpus and one over the documents that are trusted. A
document's score is the mean, over its n-grams, of the log ratio of the two smoothed probabilities;
dividing by the number of n-grams makes texts of any length comparable. Ratios are whole numbers of
``UNIT`` parts, so sums are exact in any order. A document is kept if it passes the count rules and its
score reaches the threshold.

Defined results
- Words are runs without space, tab, line feed, vertical tab, form feed and carriage return.
- A null or empty text has no words, all counts 0 and score 0; it fails the rule on word counts.
- Repeated trusted ids count once; repeated rows count as often as they occur.
- Without trusted documents every score is 0. An empty table gives an empty result.
- All arithmetic is by whole texts; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerkv.llm.common import SPACE, SPACE_CHARS, col, others

BUCKETS = 16384
UNIT, MIXER = 10_000, 1_000_003
#: Mean log ratio that a text must reach: below it, n-grams are about 6% rarer in trusted text.
THRESHOLD = -0.06
#: Bits of the filter that trusted ids are looked up in before the exact join; 8 MiB, whatever the corpus.
FILTER_BITS = 1 << 26
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))


def _run(array: str, n: int, of) -> Column:
    """``of(i)`` for the start of each run of ``n`` elements."""
    size = F.size(array)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), of)).otherwise(F.array().cast("array<long>"))


def with_grams(df: DataFrame, array: str, out: str, buckets: int) -> DataFrame:
    """Adds the buckets of all words and pairs of neighbouring words of ``array``."""
    df = df.withColumn("_crc", F.transform(array, lambda w: F.crc32(w.cast("binary"))))
    one = F.transform("_crc", lambda c: F.pmod(c, F.lit(buckets)))
    two = _run("_crc", 2, lambda i: F.pmod(F.col("_crc")[i] * MIXER + F.col("_crc")[i + 1], F.lit(buckets)))
    return df.withColumn(out, F.concat(one, two)).drop("_crc")


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` (``_id`` and others) with ``_flag``, 1 if ``trusted`` (``_good``, distinct) has the id and else 0.

    Only rows that may be trusted are shuffled for the exact join: the others fail a filter of one hash
    function, of ``FILTER_BITS`` bits in chunks of 32,768, which is broadcast at a fixed size at most.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    chunks = trusted.select(place("_good").alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_bits"))
    tested = docs.withColumn("_p", place("_id")).withColumn("_chunk", F.expr("bitmap_bucket_number(_p)")).join(F.broadcast(chunks), "_chunk", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.col("_id").isNotNull() & (F.getbit(byte, F.expr("cast(bitmap_bit_position(_p) % 8 as int)")) == 1), F.lit(False))
    tested = tested.withColumn("_maybe", maybe).drop("_p", "_chunk", "_bits")
    sure = tested.where("NOT _maybe").drop("_maybe").withColumn("_flag", F.lit(0).cast("long"))
    asked = tested.where("_maybe").drop("_maybe").join(trusted.hint("merge"), F.col("_id") == F.col("_good"), "left")
    return sure.unionByName(asked.withColumn("_flag", F.col("_good").isNotNull().cast("long")).drop("_good"))


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """The log ratio of each bucket in parts of ``UNIT``, from all of ``docs``; ``trusted`` has the ids to trust.

    Every document is flagged by its id, then its n-grams are summed by bucket in the task that reads
    it; ``buckets`` rows come back.
    """
    good = trusted.select(col(doc_id).alias("_good")).where("_good IS NOT NULL").distinct()
    rows = flagged(docs.select(col(doc_id).alias("_id"), col(text).alias("_text")), good)
    rows = rows.select(words(F.col("_text")).alias("_words"), "_flag")
    # An inner explode would get a filter on the array's size, pushed below the split it is made from.
    grams = with_grams(rows, "_words", "_grams", buckets).select("_flag", F.explode_outer("_grams").alias("_bucket")).where("_bucket IS NOT NULL")
    raw, target = [0] * buckets, [0] * buckets
    for row in grams.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_flag").alias("t")).collect():
        raw[row["_bucket"]], target[row["_bucket"]] = row["n"], row["t"]
    all_raw, all_target = sum(raw) + buckets, sum(target) + buckets
    if all_target == buckets:
        return [0] * buckets
    return [math.floor((math.log((t + 1) / all_target) - math.log((r + 1) / all_raw)) * UNIT + 0.5) for t, r in zip(target, raw, strict=True)]


def measure(df: DataFrame, ratios: list[int], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    added = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed score kept _words _lines _runs _grams _sorted _starts".split()
    rest = [col(c) for c in others(df, text, *added)]
    plain = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    rows = df.select(
        *rest, words(col(text)).alias("_words"), F.length(F.translate(plain, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("_lines"),
    )
    # Each projection below refers to arrays that the one before has computed once for the row.
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = rows.withColumn("_runs", _run("_words", 3, lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])))
    rows = with_grams(rows, "_words", "_grams", len(ratios))
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') AS array<bigint>)")
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, g: a + table[g.cast("int")])
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"), "score": F.when(F.size("_grams") > 0, total / (F.size("_grams") * F.lit(float(UNIT)))).otherwise(0.0),
        "_sorted": F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("_words", "_grams", "_runs")
    same = lambda p, k, near: F.coalesce(F.try_element_at("_sorted", k + 1 + near)["h"] == p["h"], F.lit(False))
    again = F.filter("_sorted", lambda p, k: ((k > 0) & same(p, F.greatest(k, F.lit(1)), -1)) | same(p, k, 1))
    rows = rows.withColumn("_starts", F.array_sort(F.transform(again, lambda p: p["i"]))).drop("_sorted")
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"))
    covered = F.aggregate("_starts", begin, step)["n"]
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
