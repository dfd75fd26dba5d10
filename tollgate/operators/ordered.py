"""Running totals along an order, without moving a whole group to one task.

``Window.partitionBy(group).orderBy(key)`` sorts each group in one task, which fails
when a group holds billions of rows. Groups above ``rows_per_bucket`` are therefore cut
at sampled split points of the order key. The bucket of a row is a pure function of its
key, so a recomputed task gives the same bucket. Each bucket is windowed by itself and
shifted by the totals of the buckets before it.

One level of split points is limited to about ``fan_out``, so it can be broadcast; where that would
leave buckets too large, each is cut again by split points of its own. By then no bucket is a hot
spot, and the further levels are ordinary joins. So buckets have the same size however large the
table is. Nothing but the answers "is any group too large?" reaches the driver.

The input is read twice: for a narrow copy of groups and order keys, from which sizes and split points are found, and for the
window. Of a table that had to be split, the windowed rows are stored with their bucket, so the totals of the buckets, and
whatever is made of the result, come from one sorted copy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.defaults import FAN_OUT, MAX_LEVELS, ROWS_PER_BUCKET, SAMPLES_PER_BUCKET
from tollgate.functions.arrays import in_lists, last_not_above, once
from tollgate.operators.keys import join_null_safe
from tollgate.session import measured, written

KEY, BUCKET, ALL_ROWS = "__key", "__bucket", "__all"


def descending(score: str | Column) -> Column:
    """An ascending sort key for "highest first"; undefined scores come last."""
    col = F.col(score) if isinstance(score, str) else score
    return F.coalesce(-col.cast("double"), F.lit(float("nan")))


def with_sort_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Add the order key as one struct, and a group column where there is none."""
    df = df.withColumn(KEY, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    if by:
        return df, list(by)
    # Not a literal: a constant join key would turn the equi-joins below into cross joins.
    return df.withColumn(ALL_ROWS, F.pmod(F.xxhash64(KEY), F.lit(1))), [ALL_ROWS]


def _plan(keys: DataFrame, cell: list[str], rows_per_bucket: int, fan_out: int) -> tuple[DataFrame, int, bool]:
    """(cell..., buckets, rate) of each cell with too many rows, how many they are, and whether the buckets will have to be cut
    again, since ``fan_out``, which the cells share in proportion to their rows, is too few."""
    sizes = keys.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_bucket)
    wanted = F.ceil(F.col("n") / rows_per_bucket)
    cells, rows, all_wanted = sizes.agg(F.count("*"), F.sum("n"), F.sum(wanted)).first()
    more = bool(cells) and all_wanted > fan_out
    buckets = F.least(wanted, F.greatest(F.lit(2), F.floor(F.col("n") / F.lit(rows) * fan_out))) if more else wanted
    rate = F.least(F.lit(1.0), SAMPLES_PER_BUCKET * F.col("buckets") / F.col("n"))
    return sizes.withColumn("buckets", buckets).select(*cell, "buckets", rate.alias("rate")), cells, more


def _split_points(keys: DataFrame, cell: list[str], plan: DataFrame, broadcast: bool) -> DataFrame:
    """(cell..., points): the sampled split points of each cell, as a list of lists.
    The sample holds about ``SAMPLES_PER_BUCKET`` keys for each bucket however large the table is."""
    unit = F.pmod(F.xxhash64(KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = join_null_safe(keys.select(*cell, KEY), plan, cell, broadcast=broadcast).where(unit < F.col("rate"))
    window = Window.partitionBy(*cell)
    slot = F.floor(F.row_number().over(window.orderBy(KEY)) * F.col("buckets") / F.count("*").over(window))
    points = (
        sample.withColumn("slot", slot)
        .withColumn("previous", F.lag("slot", 1, 0).over(window.orderBy(KEY)))
        .where((F.col("slot") > F.col("previous")) & (F.col("slot") < F.col("buckets")))
        .groupBy(*cell)
        .agg(F.array_sort(F.array_distinct(F.collect_list(KEY))).alias("points"))
    )
    return points.withColumn("points", in_lists(F.col("points"), F.ceil(F.sqrt(F.size("points"))).cast("int")))


def _constant(points: DataFrame) -> Column:
    """The points of all cells, by cell number, as one constant of the plan."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = points.agg(F.array_sort(F.collect_list(F.struct("__cell", "points"))).alias("all"))
    text = rows.select(F.to_json("all", exact)).first()[0]
    return F.from_json(F.lit(text), rows.schema["all"].dataType, exact)


def _with_bucket(df: DataFrame, cell: list[str], points: DataFrame, level: int, bounded: bool) -> DataFrame:
    """The bucket is the number of split points at or below the key. While all split points together are ``bounded``, a row
    gets just the number of its cell, and the points are one constant for all rows; else they come with the cell."""
    kind = points.schema["points"].dataType.elementType.elementType
    if bounded:
        df = join_null_safe(df, points.select(*cell, "__cell"), cell, "left", broadcast=True)
        lists, split = F.get(_constant(points), F.col("__cell"))["points"], F.col("__cell").isNotNull()
    else:
        df = join_null_safe(df, points, cell, "left")
        lists, split = F.col("points"), F.col("points").isNotNull()
    bucket = once(F.col(KEY).cast(kind), lambda key: last_not_above(lists, key))
    return df.withColumn(f"{BUCKET}{level}", F.when(split, bucket).otherwise(0)).drop("__cell", "points")


def with_buckets(
    keyed: DataFrame, group: list[str], rows_per_bucket: int, fan_out: int = FAN_OUT
) -> tuple[DataFrame, list[str]]:
    """Add the bucket numbers, a column for each level; gives their names, none if no group had to be split."""
    keys, levels, more = written(keyed.select(*group, KEY), "keys"), [], True
    while more and len(levels) < MAX_LEVELS:
        cell = [*group, *levels]
        plan, cells, more = _plan(keys, cell, rows_per_bucket, fan_out)
        if not cells:
            break
        # The first level is for hot groups, and bounded by ``fan_out``; later cells are no hot spots.
        bounded = not levels and cells <= fan_out
        points = _split_points(keys, cell, plan, bounded)
        if bounded:  # one window over at most ``fan_out`` rows
            points = points.withColumn("__cell", F.row_number().over(Window.orderBy(*cell)) - 1)
        points = measured(points)
        keyed = _with_bucket(keyed, cell, points, len(levels), bounded)
        if more:
            keys = written(_with_bucket(keys, cell, points, len(levels), bounded), "keys")
        levels.append(f"{BUCKET}{len(levels)}")
    return keyed, levels


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    group_totals: Iterable[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Add, per group, inclusive running sums along ``order`` (ascending keys, unique
    together). For names in ``group_totals`` the whole group's sum is added as
    ``<name>_all``. One shuffle of the rows, whatever the group sizes are."""
    keyed, group = with_sort_key(df, by, order)
    values = {name: f"__v_{name}" for name in totals}
    keyed = keyed.withColumns({values[n]: c.cast("bigint") for n, c in totals.items()})
    keyed, levels = with_buckets(keyed, group, rows_per_bucket, fan_out)
    window = Window.partitionBy(*group, *levels)
    along = window.orderBy(KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [F.col(c) for c in df.columns]
    local = {n: F.sum(v).over(along) for n, v in values.items()}
    if not levels:
        entire = [F.sum(values[n]).over(whole).alias(f"{n}_all") for n in group_totals]
        return keyed.select(*columns, *[c.alias(n) for n, c in local.items()], *entire)
    kept = dict.fromkeys([*df.columns, *group, *levels, *values.values()])
    run = written(keyed.select(*kept, *[c.alias(f"__run_{n}") for n, c in local.items()]), "run")
    sums = run.groupBy(*group, *levels).agg(*[F.sum(v).alias(v) for v in values.values()])
    buckets = Window.partitionBy(*group)
    before = buckets.orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        *levels,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__before_{n}") for n, v in values.items()],
        *[F.sum(values[n]).over(buckets).alias(f"{n}_all") for n in group_totals],
    )
    run = join_null_safe(run, measured(offsets), [*group, *levels])
    added = [(F.col(f"__run_{n}") + F.col(f"__before_{n}")).alias(n) for n in totals]
    return run.select(*columns, *added, *[F.col(f"{n}_all") for n in group_totals])


def ranked(
    df: DataFrame,
    by: Sequence[str],
    score: str = "score",
    tie: Sequence[str] = ("id",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Routing order: ``rank`` 1 is the highest score; ties follow the ``tie`` columns."""
    order = [descending(score), *[F.col(c) for c in tie]]
    return running_totals(df, by, order, {"rank": F.lit(1)}, rows_per_bucket=rows_per_bucket)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    weight: Column | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation, exact at any size: equal values are counted
    before the shuffle, and the counts are summed along the value. ``weight`` is how many rows a row stands for."""
    count = F.count("*") if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(count.alias("__count"))
    run = running_totals(
        counted, by, [F.col(value)], {"__upto": F.col("__count")}, ["__upto"], rows_per_bucket
    )
    picks = []
    for name, q in probabilities.items():
        position = F.lit(float(q)) * (F.col("__upto_all") - 1)
        low, fraction = F.floor(position), position - F.floor(position)
        at = F.min(F.when(F.col("__upto") > low, F.col(value)))
        after = F.min(F.when(F.col("__upto") > low + 1, F.col(value)))
        step = F.max(fraction)
        picks.append(F.when(step > 0, at + (after - at) * step).otherwise(at).cast("double").alias(name))
    return run.groupBy(*by).agg(*picks)


def _area(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (by..., n, positives, __twice): with r the mean rank of a score, lowest first, and ``__twice`` the sum
    of 2 r over positives, the area is (sum of r - p(p+1)/2) / (p * n)."""
    p = F.col("positives").cast("double")
    n = (F.col("n") - F.col("positives")).cast("double")
    area = F.try_divide(F.col("__twice") - p * (p + 1), 2 * p * n)
    return sums.select(*by, "n", "positives", area.alias("auroc"))


def auroc(
    df: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "need_strong",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Area under the ROC curve with averaged ties; null unless both classes occur.
    Rows collapse to one per distinct score first, and only those are ordered."""
    counted = df.groupBy(*by, score).agg(F.count("*").alias("__n"), F.count_if(F.col(label)).alias("__p"))
    run = running_totals(
        counted, by, [F.col(score)], {"__upto": F.col("__n")}, rows_per_bucket=rows_per_bucket
    )
    twice_rank = (2 * F.col("__upto") - F.col("__n") + 1).cast("double")
    sums = run.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        F.sum("__p").alias("positives"),
        F.sum(F.col("__p") * twice_rank).alias("__twice"),
    )
    return _area(sums, by)


def auroc_of_ranks(
    ranks: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "need_strong"
) -> DataFrame:
    """The same for a table that has been ordered already (``rank`` 1 is the highest score): no further order is needed,
    since a score's mean rank follows from its first and its last one. Undefined scores are one score, the lowest."""
    value = descending(score).alias("__value")
    each = ranks.groupBy(*by, value).agg(
        F.count("*").alias("__n"), F.count_if(F.col(label)).alias("__p"), (F.min("rank") + F.max("rank")).alias("__twice_rank")
    )
    sums = each.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        F.sum("__p").alias("positives"),
        F.sum(F.col("__p") * F.col("__twice_rank").cast("double")).alias("__from_top"),
    )
    return _area(sums.withColumn("__twice", 2.0 * F.col("positives") * (F.col("n") + 1) - F.col("__from_top")), by)
