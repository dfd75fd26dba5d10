"""Mix sources to target weights along a time-varying curriculum.

Each source has a weight; its share of all words is its target, held at ``MAX_EPOCHS`` times what the
source has, and the excess goes to the others by weight. Within a source the documents stand in a keyed
order, epoch after epoch; cumulative words along it are the demand served so far. The weight schedule of
a source is a piecewise linear curve over training time, scaled to the area of its target. Integrating
it gives demand over time; inverting that gives each copy the time at which it is due. Copies are
then range-sorted by time.

No source is summed in one task: sizes are summed by source and slice of the keyed order, slices are
summed in order, and documents are summed within their slice. A null source is a source of its own, the last one.
Null text has no words; it is never taken but keeps its row. Rows with equal ids are ordered by size;
fully equal rows are interchangeable. Empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgate.session import written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
ROWS_PER_SLICE = 50_000
#: Weight over training time as (time, factor) knots, for the sources in turn: falling, flat, rising.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def n_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_no, source, rows, source_size, target) from (source, rows, source_size).

    With sources in the order of size over weight, all before some place stand at their limit and the rest
    share what is left by weight. The first place where nobody is then above the limit is the solution.
    The table has one row for each source."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("source_no", F.row_number().over(by_name).cast("long")).withColumn("weight", weight)
    rows = rows.withColumn("limit", F.col("source_size") * max_epochs).withColumn("reach", F.col("limit") / F.col("weight"))
    order = W.orderBy("reach", "source_no")
    everything = W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / from_here)
    rows = rows.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("first", first)
    free = F.col("place") >= F.col("first.place")
    target = F.when(free, F.col("first.level") * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return rows.select("source_no", "source", "rows", "source_size", target.alias("target"))


def due(share: Column, slot: Column, curves: tuple = CURVES) -> Column:
    """The time at which a source has been asked for ``share`` of its target, by the curve numbered ``slot``."""
    out = F.lit(None).cast("double")
    for number, knots in enumerate(curves):
        pieces = list(zip(knots, knots[1:], strict=False))
        areas = [(t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in pieces]
        done = [sum(areas[:i]) / sum(areas) for i in range(len(areas))]
        for (((t1, a), (t2, b)), at) in zip(pieces, done, strict=True):
            height, slope = a / sum(areas), (b - a) / (t2 - t1) / sum(areas)
            rest = F.greatest(share - F.lit(at), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(height * height) + F.lit(2 * slope) * rest, F.lit(0.0)))
            time = F.lit(t1) + F.coalesce(F.lit(2.0) * rest / F.nullif(F.lit(height) + root, F.lit(0.0)), F.lit(0.0))
            out = F.when((slot == number) & (share >= F.lit(at)), time).otherwise(out)
    return out


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    curves: tuple = CURVES,
    seed: str = SEED,
    carry: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and ``positions``, the times in
    [0, 1] at which its copies are due, one for each epoch that takes it. ``carry`` names a struct in which the input row comes along.

    A copy is taken if its middle lies before the target, so a source misses its target by half a
    document at most. Words are counted once and written to the shared folder."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *row)
    sized = written(sized.withColumn("key", F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "sizes")
    sizes = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    sources = written(targets(sizes, weights, max_epochs), "sources")
    most = sources.agg(F.max("rows")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(most / ROWS_PER_SLICE, 1), 16)))
    sized = sized.join(sources.drop("rows"), sized["source"].eqNullSafe(sources["source"])).drop("source")
    sized = sized.withColumn("slice", F.substring("key", 1, digits))
    slices = sized.groupBy("source_no", "slice").agg(F.sum("size").alias("slice_size"))
    in_order = W.partitionBy("source_no").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(in_order), F.lit(0))).drop("slice_size")
    within = W.partitionBy("source_no", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = sized.withColumn("upto", F.sum("size").over(within)).join(slices, ["source_no", "slice"])
    middle = F.transform(
        F.sequence(F.lit(0), F.lit(max_epochs - 1)),
        lambda epoch: 2 * (epoch * F.col("source_size") + F.col("base") + F.col("upto")) - F.col("size"),
    )
    rows = rows.withColumn("middle", F.filter(middle, lambda m: (m < 2 * F.col("target")) & (F.col("size") > 0)))
    slot = (F.col("source_no") - 1) % len(curves)
    positions = F.transform("middle", lambda m: due(m / (2 * F.col("target")), slot, curves))
    return rows.select(
        "doc_id", "size", "source_size", "target",
        (F.size("middle") * F.col("size")).alias("taken"),
        positions.alias("positions"),
        *[carry] * bool(carry),
    )


def curriculum(planned: DataFrame) -> DataFrame:
    """One row per taken copy with its ``epoch`` and ``position``, range-sorted by position: the mix in training order."""
    copies = planned.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions")
    return copies.orderBy("position", "doc_id", "epoch")
