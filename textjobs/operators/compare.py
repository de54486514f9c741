"""Comparison of models and the keyed table that holds their results."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.text import r4


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The existing rows without those that ``new`` replaces, then ``new``;
    columns missing on one side are null.  Write the result to a new path and
    swap, never over the path that is being read."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def model_lift(df: DataFrame, model: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Every model against the baseline row: delta, ratio and percent."""
    base = df.where(F.col(model) == baseline)
    out = df.select(model, *metrics)
    for m in metrics:
        b = base.select(m).scalar()
        out = out.withColumns({
            f"{m}_delta": r4(F.col(m) - b), f"{m}_ratio": F.bround(F.try_divide(F.col(m), b), 2),
            f"{m}_pct": F.bround(F.try_divide((F.col(m) - b) * 100, b), 1),
        })
    return out


def side_by_side(df: DataFrame, prompt: str, model: str, text: str, left: str, right: str) -> DataFrame:
    """Outputs of two models for the same prompt."""
    def slice_of(name: str, alias: str) -> DataFrame:
        return df.where(F.col(model) == name).select(prompt, F.col(text).alias(alias))

    return slice_of(left, "left_text").join(slice_of(right, "right_text"), prompt)


def side_by_side_pairs(df: DataFrame, prompt: list[str], order: str, text: str, ahead: int = 1) -> DataFrame:
    """Every output beside the one that follows ``ahead`` places later for the
    same prompt."""
    later = df.select(*prompt, (F.col(order) - ahead).alias(order), F.col(text).alias("right_text"))
    return df.select(*prompt, order, F.col(text).alias("left_text")).join(later, [*prompt, order])


def replace_stored(spark: SparkSession, new: DataFrame, key: str, root: str) -> DataFrame:
    """Upserts into a stored table and returns it as read back.

    Versions are folders; the largest number in the ``pointer`` folder names
    the current one, so a reader sees the old table or the new one whole: the
    new version is written first, the number added last.  Older versions are
    left to the owner of the folder.  A key that ``new`` repeats is an error.
    """
    twice = new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.count():
        raise ValueError(f"the new rows repeat a value of {key}")
    version = stored_version(spark, root)
    merged = new if version < 0 else upsert(spark.read.parquet(f"{root}/version={version}"), new, key)
    merged.write.mode("overwrite").parquet(f"{root}/version={version + 1}")
    spark.range(1).select(F.lit(version + 1).alias("version")).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return read_stored(spark, root)


def stored_version(spark: SparkSession, root: str) -> int:
    """The current version of a stored table, -1 before the first."""
    try:
        return spark.read.schema("version INT").json(f"{root}/pointer").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def read_stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={stored_version(spark, root)}")


def badge(label: Column) -> Column:
    """Badge class of a diet label; a missing label gets the default."""
    low = F.lower(label)
    return (
        F.when(F.contains(low, F.lit("vegan")), "badge-diet-vegan")
        .when(F.contains(low, F.lit("non")), "badge-diet-nonveg").otherwise("badge-diet-veg")
    )
