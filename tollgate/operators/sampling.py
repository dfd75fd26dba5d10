"""Quotas, stratified samples and leak-free splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.defaults import GROUP_FOLDS, ROWS_PER_BUCKET, SEED, TEST_SIZE
from tollgate.functions.draws import uniform
from tollgate.operators.keys import join_null_safe
from tollgate.operators.ordered import running_totals
from tollgate.session import measured, written

# A stratum is cut into slots of about this many rows; only one slot of it is ever sorted.
ROWS_PER_SLOT = 100_000


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def allocate(
    sizes: DataFrame,
    by: Sequence[str],
    n: int | Callable[[Column], Column],
    at_least_one: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``quota``: n shared out in proportion to ``size`` by largest remainder.

    Never more than a group's size; with ``at_least_one`` each group gets a row when n
    allows it, and what that overshoots is taken back from the largest quotas. Either
    correction is a closed form over one ordered pass of the size table, cut into buckets like any other:
    leftovers go one each to the largest remainders, and taking back one by one from
    the current maximum lowers the largest k quotas to a common level.
    ``n`` may be a function of the total. ``sizes`` is read several times.
    """
    sums = sizes.agg(F.sum("size").alias("total"), F.count("*").alias("groups"))
    sums = sums.select("*", F.least((n(F.col("total")) if callable(n) else F.lit(n)).cast("bigint"), "total").alias("want")).first()
    total, groups, want = sums["total"] or 0, sums["groups"], sums["want"] or 0
    table = sizes.withColumn("__raw", F.col("size") / F.lit(total) * F.lit(want))
    base = F.floor("__raw")
    if at_least_one and want >= groups:
        base = F.greatest(base, F.lit(1))
    table = table.withColumn("__base", F.least(base, F.col("size")))
    left = want - (table.agg(F.sum("__base")).first()[0] or 0) if groups else 0
    names = [F.col(c) for c in by]
    if left > 0:
        by_remainder = [F.col("__base") - F.col("__raw"), -F.col("size"), *names]
        table = running_totals(table, [], by_remainder, {"__turn": F.lit(1)}, rows_per_bucket=rows_per_bucket)
        quota = F.when(F.col("__turn") <= left, F.col("__base") + 1).otherwise(F.col("__base"))
    elif left < 0:
        by_quota = [-F.col("__base"), -F.col("size"), *names]
        sums = {"__k": F.lit(1), "__upto": F.col("__base")}
        table = running_totals(table, [], by_quota, sums, rows_per_bucket=rows_per_bucket)
        # The k-th largest quota is lowered when levelling the first k down to it costs less
        # than the overshoot.
        lowered = -left > F.col("__upto") - F.col("__k") * F.col("__base")
        count, upto = table.where(lowered).agg(F.count("*"), F.max("__upto")).first()
        level, spare = divmod(upto + left, count)
        cut = level + F.when(F.col("__k") > count - spare, 1).otherwise(0)
        quota = F.when(F.col("__k") <= count, cut).otherwise(F.col("__base"))
    else:
        quota = F.col("__base")
    return table.select(*sizes.columns, quota.cast("bigint").alias("quota"))


LAST = "__last"


def last_picked(
    df: DataFrame,
    by: Sequence[str],
    quotas: DataFrame,
    draw: Column,
    tie: str = "id",
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(by..., last): of the ``quota`` rows per group with the lowest draw in [0, 1), the one with the highest.

    The draw is uniform, so equal slices of it hold about equally many rows. Slices are
    counted per group, and only the slice in which the quota runs out is sorted, to find
    the group's last picked row. A group holding a third of a huge table thus sorts about
    ``rows_per_slot`` rows. A group with quota 0 has no row here.
    """
    by = list(by)
    slots = F.ceil(F.col("size") / rows_per_slot)
    plan = quotas.select(*by, "quota", slots.alias("__slots"))
    drawn = df.select(*dict.fromkeys([*by, tie]), draw.alias("__draw"))
    keyed = join_null_safe(drawn, plan, by).withColumn("__slot", F.floor(F.col("__draw") * F.col("__slots")))
    counts = keyed.groupBy(*by, "quota", "__slot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .where((F.col("__before") < F.col("quota")) & (F.col("__before") + F.col("__n") >= F.col("quota")))
        .select(*by, "__slot", (F.col("quota") - F.col("__before")).alias("__still"))
    )
    contested = join_null_safe(keyed.select(*dict.fromkeys([*by, "__slot", "__draw", tie])), measured(cut), [*by, "__slot"])
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__draw", tie))
    last = (
        contested.withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__still"))
        .select(*by, F.struct("__draw", F.col(tie).alias("__tie")).alias(LAST))
    )
    return measured(last)


def mark_picked(df: DataFrame, by: Sequence[str], last: DataFrame, draw: Column, tie: str = "id") -> DataFrame:
    """Add ``picked``: whether a row comes no later than its group's last one. The rows are compared
    with that one row and, while ``last`` is small enough to be broadcast, not moved."""
    here = F.struct(draw.alias("__draw"), F.col(tie).alias("__tie"))
    picked = F.coalesce(here <= F.col(LAST), F.lit(False))
    return join_null_safe(df, last, by, "left").withColumn("picked", picked).drop(LAST)


def mark_lowest(
    df: DataFrame,
    by: Sequence[str],
    quotas: DataFrame,
    draw: Column,
    tie: str = "id",
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Add ``picked``: the ``quota`` rows per group with the lowest draw in [0, 1)."""
    return mark_picked(df, by, last_picked(df, by, quotas, draw, tie, rows_per_slot), draw, tie)


def stratified_sample(
    df: DataFrame,
    by: str,
    n: int,
    seed: int = SEED,
    tie: str = "id",
    rows_per_slot: int = ROWS_PER_SLOT,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Proportional sample of n rows, with ``sample_rank`` as its shuffled order."""
    quotas = measured(allocate(measured(group_sizes(df, [by])), [by], n))
    marked = mark_lowest(df, [by], quotas, uniform(F.col(tie), seed), tie, rows_per_slot)
    # Stored once: ordering reads it more than once, and drawing it again costs scans of df.
    sample = written(marked.where("picked").drop("picked"), "sample")
    order = [uniform(F.col(tie), f"{seed}:order"), F.col(tie)]
    return running_totals(sample, [], order, {"sample_rank": F.lit(1)}, rows_per_bucket=rows_per_bucket)


def last_test_rows(
    df: DataFrame, test_size: float, seed: int, strat: str, tie: str, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Of each class, the last row by draw that goes to the test side."""
    sizes = measured(group_sizes(df, [strat]))
    train = allocate(sizes, [strat], lambda t: t - F.ceil(F.lit(test_size) * t), at_least_one=False)
    test = measured(train.withColumn("quota", F.col("size") - F.col("quota")))
    return last_picked(df, [strat], test, uniform(F.col(tie), seed), tie, rows_per_slot)


def _with_part(df: DataFrame, last: DataFrame, seed: int, strat: str, tie: str) -> DataFrame:
    marked = mark_picked(df, [strat], last, uniform(F.col(tie), seed), tie)
    return marked.withColumn("part", F.when(F.col("picked"), "test").otherwise("train")).drop("picked")


def random_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    strat: str = "need_strong",
    tie: str = "id",
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Add ``part``: exactly ceil(test_size * n) test rows, classes in proportion."""
    return _with_part(df, last_test_rows(df, test_size, seed, strat, tie, rows_per_slot), seed, strat, tie)


def loads_before(runs: Sequence[tuple[int, int]], k: int) -> list[list[int]]:
    """Fold loads at the start of each run of equally large groups, given (size, groups) from large to small.

    In a run of size s the groups go to the folds in the order of the numbers load + i * s (then of
    the folds), so what a whole run adds is counted without placing its groups one by one."""
    loads, out = [0] * k, []
    for size, groups in runs:
        out.append(loads)
        if size == 0:
            continue
        taken = lambda top: [max(0, (top - x) // size + 1) for x in loads]  # noqa: B023, E731
        low, high = min(loads) - 1, max(loads) + size * groups
        while low < high:  # the highest level at which not more than ``groups`` are placed
            middle = -((-low - high) // 2)
            low, high = (middle, high) if sum(taken(middle)) <= groups else (low, middle - 1)
        placed = taken(low)
        spare = groups - sum(placed)
        for fold in range(k):
            if spare and loads[fold] <= low + 1 and (low + 1 - loads[fold]) % size == 0:
                placed[fold], spare = placed[fold] + 1, spare - 1
        loads = [x + n * size for x, n in zip(loads, placed)]
    return out


def fold_of_groups(
    sizes: DataFrame, group: str, k: int = GROUP_FOLDS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(group, size, fold): largest first, each group to the lightest fold (the first one on a tie).

    The same rule at any number of groups: groups of one size form a run, and where the j-th group of a
    run goes follows from the loads at its start. Only distinct sizes reach the driver, and n rows have
    at most sqrt(2 n) of them.
    """
    runs = [tuple(r) for r in sizes.groupBy("size").agg(F.count("*").alias("groups")).orderBy(F.desc("size")).collect()]
    starts = [(size, loads) for (size, _), loads in zip(runs, loads_before(runs, k))]
    starts = sizes.sparkSession.createDataFrame(starts, "size long, __loads array<bigint>")
    turns = running_totals(sizes, ["size"], [F.col(group)], {"__turn": F.lit(1)}, rows_per_bucket=rows_per_bucket)
    rows = turns.join(starts, "size")
    placed = "aggregate(__loads, 0L, (n, x) -> n + CASE WHEN {v} >= x THEN ({v} - x) div size + 1 ELSE 0L END)"
    # The highest level at which fewer than __turn groups are placed, bit by bit.
    step = placed.format(v="(v + shiftleft(1L, b))")
    level = f"aggregate(sequence(60, 0, -1), array_min(__loads) - 1L, (v, b) -> CASE WHEN {step} < __turn THEN v + shiftleft(1L, b) ELSE v END)"
    rows = rows.withColumn("__level", F.when(F.col("size") > 0, F.expr(level)))
    ties = "filter(sequence(0, cardinality(__loads) - 1), f -> __loads[f] <= __level + 1 AND (__level + 1 - __loads[f]) % size = 0)"
    fold = F.expr(f"get({ties}, CAST(__turn - {placed.format(v='__level')} - 1 AS INT))")
    lightest = F.array_position("__loads", F.array_min("__loads")) - 1
    return rows.select(group, "size", F.when(F.col("size") > 0, fold).otherwise(lightest).cast("int").alias("fold"))


def group_folds(
    df: DataFrame, group: str = "subject", k: int = GROUP_FOLDS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``fold``: every row is tested once, and no group spans two folds. A null group is a group."""
    sizes = measured(group_sizes(df, [group]))
    folds = fold_of_groups(sizes, group, k, rows_per_bucket)
    return join_null_safe(df, measured(folds.drop("size")), [group]).select(*df.columns, "fold")


@dataclass(frozen=True)
class SplitPlan:
    """Both evaluation setups as functions of a row: the last test row of each class, and the fold of each group.
    Rows get their part and fold where they are; nothing is joined by id."""

    last: DataFrame
    folds: DataFrame
    seed: int
    strat: str = "need_strong"
    group: str = "subject"
    tie: str = "id"

    def assign(self, table: DataFrame) -> DataFrame:
        """Add ``part`` (train or test in the random setup) and ``fold`` (where the row is tested in the unseen one)."""
        return join_null_safe(_with_part(table, self.last, self.seed, self.strat, self.tie), self.folds, [self.group], "left")

    def splits(self, table: DataFrame) -> DataFrame:
        """(setup, id, fold, part). ``random`` lists every row as train or test. ``unseen_subjects`` lists every row
        once, as a test row of its fold; that fold's training rows are all rows of the other folds."""
        setups = F.array(
            F.struct(F.lit("random").alias("setup"), F.lit(0).alias("fold"), F.col("part").alias("part")),
            F.struct(F.lit("unseen_subjects").alias("setup"), F.col("fold").alias("fold"), F.lit("test").alias("part")),
        )
        assigned = self.assign(table.select(*dict.fromkeys([self.tie, self.strat, self.group])))
        return assigned.select(F.col(self.tie).alias("id"), F.inline(setups)).select("setup", "id", "fold", "part")


def plan_splits(
    table: DataFrame, seed: int = SEED, test_size: float = TEST_SIZE, k: int = GROUP_FOLDS
) -> SplitPlan:
    sizes = measured(group_sizes(table, ["subject"]))
    folds = measured(fold_of_groups(sizes, "subject", k).drop("size"))
    return SplitPlan(last_test_rows(table, test_size, seed, "need_strong", "id"), folds, seed)


def make_splits(
    table: DataFrame, seed: int = SEED, test_size: float = TEST_SIZE, k: int = GROUP_FOLDS
) -> DataFrame:
    """Both evaluation setups as one table (setup, id, fold, part)."""
    return plan_splits(table, seed, test_size, k).splits(table)


def split_balance(table: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows, positives and subjects per part. For the unseen setup the training side of a
    fold is what the other folds hold."""
    # Counted per subject first, so that a fold's subjects are a sum, not a distinct count.
    cells = (
        table.join(splits, "id")
        .groupBy("setup", "fold", "part", "subject")
        .agg(F.count("*").alias("n"), F.count_if("need_strong").alias("positives"))
    )
    parts = cells.groupBy("setup", "fold", "part").agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.count("*").alias("subjects")
    )
    setup = Window.partitionBy("setup")
    rest = parts.where(F.col("setup") == "unseen_subjects").select(
        "setup",
        "fold",
        F.lit("train").alias("part"),
        *[(F.sum(c).over(setup) - F.col(c)).alias(c) for c in ("n", "positives", "subjects")],
    )
    both = parts.unionByName(rest)
    return both.withColumn("positive_rate", F.try_divide(F.col("positives"), F.col("n")))
