"""Label and summaries of a routing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollgate.defaults import NEAR_CHANCE_MARGIN, WEAK_TOO_GOOD
from tollgate.functions.outcomes import need_strong, outcome, share


def add_label(table: DataFrame) -> DataFrame:
    return table.withColumn("need_strong", need_strong(F.col("weak_correct"), F.col("strong_correct")))


def add_outcome(table: DataFrame) -> DataFrame:
    return table.withColumn("outcome", outcome(F.col("weak_correct"), F.col("strong_correct")))


def chance_accuracy(df: DataFrame, n_options: str = "n_options") -> DataFrame:
    """Expected accuracy of a uniform guess, from counts per number of options."""
    counts = df.groupBy(n_options).agg(F.count("*").alias("n"))
    return counts.agg(
        F.try_divide(F.sum(F.col("n") / F.col(n_options)), F.sum("n")).alias("chance_accuracy")
    )


def label_summary(labelled: DataFrame) -> DataFrame:
    """Accuracies, the four outcomes, the ceiling, and the warnings that need no chance level."""
    weak, strong = F.col("weak_correct"), F.col("strong_correct")
    summary = labelled.agg(
        F.count("*").alias("n"),
        share(weak).alias("weak_acc"),
        share(strong).alias("strong_acc"),
        F.count_if("need_strong").alias("need_strong"),
        share(F.col("need_strong")).alias("need_strong_rate"),
        share(weak & strong).alias("both_right"),
        share(~weak & ~strong).alias("both_wrong"),
        share(weak & ~strong).alias("weak_only"),
        share(weak | strong).alias("oracle_ceiling"),
    )
    return summary.withColumns(
        {
            "weak_too_good": F.col("weak_acc") > WEAK_TOO_GOOD,
            "strong_no_better": F.col("strong_acc") <= F.col("weak_acc"),
        }
    )


def with_option_counts(labelled: DataFrame, questions: DataFrame) -> DataFrame:
    """Look up the number of options; questions that are not listed keep a null."""
    counts = questions.select("id", F.size("options").cast("bigint").alias("n_options"))
    return labelled.join(counts, "id", "left")


def chance_warning(labelled_with_counts: DataFrame) -> DataFrame:
    """Chance level, weak accuracy, and whether the two are nearly the same."""
    known = F.col("n_options").isNotNull()
    cells = labelled_with_counts.groupBy("n_options").agg(
        F.count("*").alias("n"), F.count_if("weak_correct").alias("right")
    )
    sums = cells.agg(
        F.sum("n").alias("n"),
        F.sum("right").alias("right"),
        F.try_divide(
            F.sum(F.when(known, F.col("n") / F.col("n_options"))), F.sum(F.when(known, F.col("n")))
        ).alias("chance_accuracy"),
    )
    weak = F.try_divide(F.col("right"), F.col("n"))
    return sums.select(
        "n",
        weak.alias("weak_acc"),
        "chance_accuracy",
        (weak - F.col("chance_accuracy") < NEAR_CHANCE_MARGIN).alias("near_chance"),
    )


def subject_stats(labelled: DataFrame) -> DataFrame:
    """Per subject n, accuracies and need rate, highest need first."""
    stats = labelled.groupBy("subject").agg(
        F.count("*").alias("n"),
        share(F.col("weak_correct")).alias("weak_acc"),
        share(F.col("strong_correct")).alias("strong_acc"),
        share(F.col("need_strong")).alias("need_strong_rate"),
    )
    return stats.orderBy(F.desc("need_strong_rate"), "subject")
