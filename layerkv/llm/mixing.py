"""Mix sources to target weights along a curriculum.

Each source gets a target number of words. Its documents stand in a fixed order (by a digest of
their id and size), repeated for as many epochs as the target needs; a copy is taken while its middle word
lies before the target. A source's weight may change over training time ``t`` in [0, 1): its curve,
given by knots and linear between them, integrates to the cumulative demand for the source, and the
training position of a copy is where that demand reaches the words before the copy.

Prefix sums are two-level: a source is cut into digest ranges that are summed on their own, so a
source that holds a third of all rows is spread like any other, and the result doesn't depend on
the number of ranges.

Defined results
- A null text has no words; a document without words is never taken. A null source is a source of
  its own, last in order.
- A source without words has target 0. An empty table gives an empty result.
- Rows of equal id are told apart by their size, and are otherwise interchangeable; rows without an id
  are spread by their sizes. Texts of any length count as their words, read whole.
- ``mix`` keeps all columns of the input, whatever their names. ``plan_mix`` adds columns of its own; an input column of such a
  name is left out.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerkv.llm.common import WORD, col, materialize, others, shuffle_partitions

#: Knots (time, weight): weight relative to the source's mean over training.
FLAT = ((0.0, 1.0), (1.0, 1.0))
RISING = ((0.0, 0.5), (1.0, 1.5))
FALLING = ((0.0, 1.5), (1.0, 0.5))
#: The curves of sources in turn.
CURVES = (FALLING, FLAT, RISING)
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """(t0, length, w0, slope, area before, area through) of each piece, areas as parts of the whole."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in pairwise(knots)) or any(w < 0 for _, w in knots):
        raise ValueError("knots must run from time 0 to time 1 with weights of 0 or more")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(knots))
    if whole <= 0:
        raise ValueError("a curve must have some weight")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in pairwise(knots):
        through = before + (t1 - t0) * (w0 + w1) / 2 / whole
        out.append((t0, t1 - t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, before, through))
        before = through
    return out


def position(share: Column, curve: Column, curves: tuple) -> Column:
    """The time at which a curve's cumulative demand reaches ``share`` (0 to 1) of its whole."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(curves):
        at = F.lit(1.0)
        for t0, length, w0, slope, before, through in reversed(segments(knots)):
            v = F.greatest(share - before, F.lit(0.0))  # w0 x + slope x^2 / 2 = v
            root = w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + v * (2 * slope), F.lit(0.0)))
            x = F.when(root > 0, 2 * v / root).otherwise(0.0)
            at = F.when(share < through, t0 + F.least(x, F.lit(length))).otherwise(at)
        out = F.when(curve == k, at).otherwise(out)
    return out


def source_key(source: str) -> Column:
    """Sorts as the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), col(source).cast("string")), F.lit("1"))


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float, n_curves: int = 1) -> DataFrame:
    """``_source, source_size`` and each source's weight, ``target`` and ``_curve``.

    Targets part ``share`` times all words by weight, but none is above ``most`` times its source;
    the excess goes to the others by weight. Sources are visited from the one that fills first
    (least limit for its weight), and every source from the first unfilled one on gets the same
    words for each unit of weight. There is one row for each source here.
    """
    rank = F.row_number().over(Window.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.select("_source", "source_size", rank.alias("_rank"), weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_limit"))
    every = Window.partitionBy(F.lit(0))
    visit = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    rows = rows.withColumns({
        "_wanted": F.sum("source_size").over(every) * F.lit(float(share)),
        "_used": F.coalesce(F.sum("_limit").over(visit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_weight").over(visit.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("_full", (F.col("_wanted") - F.col("_used")) * F.col("_weight") / F.col("_left") >= F.col("_limit"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_limit") / F.col("_weight"), "_rank", ((F.col("_wanted") - F.col("_used")) / F.col("_left")).alias("level")))).over(every)
    return rows.select("_source", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(level["level"] * F.col("_weight")).alias("target"), (F.col("_rank") % n_curves).alias("_curve"))


def plan_mix(
    df: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
    curves: tuple = (FLAT,),
) -> DataFrame:
    """The rows of ``df`` with size, source_size, target, copies, taken and _before (words of the source before it)."""
    ranges = shuffle_partitions(df.sparkSession)
    digest = F.md5(F.concat(F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(":"), size.cast("string")).cast("binary"))
    span = F.coalesce(F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * ranges / 65536), F.lit(0)).cast("int")
    own = "size source_size target copies taken _source _digest _span _sum _start _before _curve _words".split()
    rows = df.select(*map(col, others(df, *own)), size.cast("long").alias("size"), source_key(source).alias("_source"), digest.alias("_digest"), span.alias("_span"))
    spans = rows.groupBy("_source", "_span").agg(F.sum("size").alias("_words"))
    totals = spans.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    starts = spans.select("_source", "_span", F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    starts = starts.join(targets(totals, weights, share, most, len(curves)), "_source")
    inside = Window.partitionBy("_source", "_span").orderBy("_digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("size").over(inside)).join(starts, ["_source", "_span"])
    rows = rows.withColumn("_before", F.col("_start") + F.col("_sum") - F.col("size"))
    epochs = F.ceil((F.col("target") - F.col("_before") - F.col("size") / 2) / F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.greatest(F.least(epochs, F.lit(most)), F.lit(0))).otherwise(0).cast("int")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_span", "_sum", "_start")


def ordered(rows: DataFrame, curves: tuple, keep_untaken: bool = False) -> DataFrame:
    """A row for each copy of ``plan_mix``'s rows, with ``_copy`` and ``_position``, range-sorted by training position.

    Documents that are not taken are left out, or come last with nulls for both.
    """
    each = F.sequence(F.lit(0), F.col("copies") - 1)
    rows = rows.withColumn("_copy", F.explode_outer(F.when(F.col("copies") > 0, each))) if keep_untaken else rows.where("copies > 0").withColumn("_copy", F.explode(each))
    reached = (F.col("_before") + F.col("_copy") * F.col("source_size")) / F.col("target")
    rows = rows.withColumn("_position", F.when(F.col("_copy").isNotNull(), position(reached, F.col("_curve"), curves)))
    order = [F.col("_position").asc_nulls_last(), "_source", "_digest", "_copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(df: DataFrame, size: Column, curves: tuple = CURVES, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, position, last_position`` of each row, in the order in which training first meets them.

    The copies are put in training order and written down with their positions and ranks (numbers that rise
    along the order, with gaps); ``copies`` and ``taken`` count those that have a position in the training
    time, and the two positions are those of the first and the last of them (null if there is none).
    Documents that are not taken come last.
    """
    doc_id = options.get("doc_id", "doc_id")
    copies = ordered(plan_mix(df, size, curves=curves, **options), curves, keep_untaken=True).withColumn("_rank", F.monotonically_increasing_id())
    copies = materialize(copies.select(col(doc_id), "size", "source_size", "target", "_source", "_before", "_position", "_rank"))
    # A source's taken rows have words, so no two begin at the same word; untaken ones stay as they are.
    placed = F.col("_position") < 1
    row = F.when(placed, F.lit(-1)).otherwise(F.col("_rank")).alias("_row")
    same = [col(doc_id), "size", "source_size", "target", "_source", "_before", row]
    out = copies.groupBy(*same).agg(
        F.count_if(placed).cast("int").alias("copies"), F.sum(F.when(placed, F.col("size")).otherwise(0)).alias("taken"), F.min("_rank").alias("_rank"),
        F.min(F.when(placed, F.col("_position"))).alias("position"), F.max(F.when(placed, F.col("_position"))).alias("last_position"),
    )
    return out.repartitionByRange("_rank").sortWithinPartitions("_rank").select(col(doc_id), "size", "source_size", "target", "taken", "copies", "position", "last_position")


def mix(df: DataFrame, *, text: str = "text", curves: tuple = CURVES, **options) -> DataFrame:
    """Every taken copy as a row of ``df``, range-sorted by training position."""
    names = [*df.columns]
    clash = {c: f"_in_{k}" for k, c in enumerate(names)}
    inner = df.select(*[col(c).alias(clash[c]) for c in names])
    options |= {"doc_id": clash[options.get("doc_id", "doc_id")], "source": clash[options.get("source", "source")]}
    rows = plan_mix(inner, word_count(F.col(clash[text])), curves=curves, **options)
    return ordered(rows, curves).select(*[F.col(clash[c]).alias(c) for c in names])
