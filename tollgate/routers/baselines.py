"""Routers that need no model: random, prompt length, and the label itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollgate.defaults import SEED
from tollgate.functions.arrays import in_lists, last_not_above, once
from tollgate.functions.draws import uniform
from tollgate.operators.ordered import running_totals
from tollgate.routers.base import register_router, save_params
from tollgate.session import measured


class RandomRouter:
    """A seeded coin per question."""

    def __init__(self, seed: int = SEED):
        self.seed = seed

    def fit(self, train: DataFrame) -> "RandomRouter":
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", uniform(F.col("id"), self.seed))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        save_params(SparkSession.active(), path, "random", seed=self.seed)

    @classmethod
    def load(cls, spark, path: str, params: dict) -> "RandomRouter":
        return cls(**params)


def length_counts(train: DataFrame, *extra: str) -> DataFrame:
    return train.groupBy(*extra, F.length("prompt").alias("length")).agg(F.count("*").alias("m"))


def length_shares(counts: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """(by..., length, score): the share of counted prompts of at most this length, for
    every length on either side, so that scoring is an equi-join and not a range join."""
    both = counts.select(*by, "length", "m").unionByName(
        lengths.select(*by, "length", F.lit(0).cast("bigint").alias("m"))
    )
    distinct = both.groupBy(*by, "length").agg(F.sum("m").alias("m"))
    upto = running_totals(distinct, by, [F.col("length")], {"upto": F.col("m")}, ["upto"])
    return upto.select(*by, "length", F.try_divide("upto", "upto_all").alias("score"))


class LengthRouter:
    """Longer prompts are taken to be harder."""

    def fit(self, train: DataFrame) -> "FittedLengthRouter":
        return FittedLengthRouter(measured(length_counts(train)))


# Lengths that one row of the step table holds, in lists of STEPS_PER_LIST.
STEPS_PER_ROW, STEPS_PER_LIST = 1024, 32


class FittedLengthRouter:
    """Scores by a step function: the share of training prompts that are no longer.

    The table has a row for every ``STEPS_PER_ROW`` distinct training lengths, however long a prompt
    is: which row a prompt needs follows from the first lengths of the rows, a short list, and
    the step within it from the row's own lists. So a new prompt is scored by an equi-join
    with a small table, and a stream can be scored."""

    def __init__(self, counts: DataFrame, steps_per_row: int = STEPS_PER_ROW, steps_per_list: int = STEPS_PER_LIST):
        self.counts = counts
        sums = {"upto": F.col("m"), "place": F.lit(1)}
        steps = running_totals(counts, [], [F.col("length")], sums, ["upto"])
        row = F.floor((F.col("place") - 1) / F.lit(steps_per_row)).cast("int").alias("__row")
        step = F.struct("length", F.try_divide("upto", "upto_all").alias("share"))
        rows = steps.select(row, step.alias("step")).groupBy("__row").agg(F.array_sort(F.collect_list("step")).alias("all"))
        self.steps = measured(rows.select("__row", F.col("all").alias("__steps"), in_lists(F.col("all"), steps_per_list).alias("__lists")))
        first = self.steps.select(F.get("__steps", F.lit(0))["length"].alias("first")).orderBy("first")
        self.firsts = [r["first"] for r in first.collect()]  # one number a row

    def score(self, df: DataFrame) -> DataFrame:
        length = F.length("prompt")
        firsts = F.array(*[F.lit(x) for x in self.firsts]) if self.firsts else F.array().cast("array<int>")
        # Lengths below the first step have row -1, which the table lacks.
        row = once(length, lambda n: F.size(F.filter(firsts, lambda x: x <= n)) - 1)
        joined = df.withColumn("__row", row).join(self.steps, "__row", "left")
        upto = once(length, lambda n: last_not_above(F.col("__lists"), n, lambda step: step["length"]))
        share = F.coalesce(F.get("__steps", upto - 1)["share"], F.lit(0.0))
        return joined.withColumn("score", F.when(F.col("prompt").isNotNull(), share)).drop("__row", "__steps", "__lists")

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/lengths")
        save_params(self.counts.sparkSession, path, "length")

    @classmethod
    def load(cls, spark, path: str, params: dict) -> "FittedLengthRouter":
        return cls(spark.read.parquet(f"{path}/lengths"))


class OracleRouter:
    """Upper bound: the label as the score."""

    def fit(self, train: DataFrame) -> "OracleRouter":
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.col("need_strong").cast("double"))


register_router("random", RandomRouter, RandomRouter)
register_router("length", LengthRouter, FittedLengthRouter)
register_router("oracle", OracleRouter)
