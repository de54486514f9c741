"""Jobs over training logs: one row per record, train and eval kinds mixed."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textjobs.functions.text import r4
from textjobs.operators.ordered import carry_forward


def split_log(df: DataFrame, eval_column: str = "eval_loss") -> tuple[DataFrame, DataFrame]:
    """Train records and eval records."""
    return df.where(F.col(eval_column).isNull()), df.where(F.col(eval_column).isNotNull())


def asof_gap(df: DataFrame, run: list[str], bucket: str | None, order: list[str], train: str, evaluation: str) -> DataFrame:
    """Each eval record with the last train record at or before it, and the gap.

    A train record at the very position of an eval record counts, whichever
    of the two was written first; ``order`` names the position first and then
    a tie-break, so train records are put first among equals.
    """
    position, *rest = order
    tagged = df.withColumn("_late", F.col(evaluation).isNotNull().cast("int"))
    carried = carry_forward(tagged, run, bucket, [position, "_late", *rest],
                            [F.col(train), F.when(F.col(train).isNotNull(), F.col(position))],
                            ["train_value", "train_position"], include_current=True)
    return carried.where(F.col(evaluation).isNotNull()).drop("_late").withColumn(
        "gap", r4(F.col(evaluation) - F.col("train_value")))


def best_checkpoint(df: DataFrame, run: list[str], step: str, loss: str) -> DataFrame:
    """Step with the lowest eval loss, the earlier one on a tie."""
    found = df.where(F.col(loss).isNotNull()).groupBy(*run).agg(
        F.min(F.struct(F.col(loss).alias("best_loss"), F.col(step).alias("best_step"))).alias("b"))
    return found.select(*run, "b.best_step", "b.best_loss")


def epoch_table(df: DataFrame, epoch: list[str], metrics: dict[str, str], order: str) -> DataFrame:
    """Last value of each metric per epoch."""
    return df.groupBy(*epoch).agg(F.count("*").alias("n_records"), *[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(name) for name, c in metrics.items()
    ])


def run_throughput(df: DataFrame, run: list[str], step: str, seconds: str, samples: str) -> DataFrame:
    """Steps, total seconds, seconds per step, samples per second.

    Seconds are added as whole milliseconds, so the sum has one value."""
    total = F.sum(F.bround(F.col(seconds) * 1000).cast("bigint"))
    return df.groupBy(*run).agg(
        F.max(step).alias("steps"), F.bround(total / 1000, 3).alias("total_seconds"),
        r4(F.try_divide(total / 1000, F.max(step))).alias("seconds_per_step"),
        r4(F.try_divide(F.sum(samples), total / 1000)).alias("samples_per_second"),
    )
