"""Seeded, exact-size splits that never sort or move the whole table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textjobs.functions.hashing import seeded_hash
from textjobs.sources.files import save_and_reread


def holdout_split(df: DataFrame, key: str, n_test: int, n_val: int, seed: int = 42, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``split``: exactly ``n_test`` test and ``n_val`` validation rows.

    Rows are ordered by a seeded digest of the key and, where keys repeat, of
    the columns ``ties`` that tell their rows apart.  The digests are counted
    per six-digit head in one pass; a cut goes down from the counts of its
    first three digits (at most 4096 rows) to those of the next three (as
    many), and only the rows of one head of 16.7 million, some of which a
    table of 10^12 rows has 60,000, are ranked to find the cutting digest; then every row compares
    its own digest with them, without a shuffle of the table.  A cut between
    rows that are equal in all these columns cannot be made: it is an error
    that names the columns, not a split of another size.
    """
    columns = [F.col(c) for c in (key, *ties)]
    digest = seeded_hash(seed, *columns)
    label = F.concat_ws("-", *[c.cast("string") for c in columns])
    keyed = df.select(F.concat(digest, F.lit("-"), label).alias("_h"))
    fine = save_and_reread(keyed.groupBy(F.substring("_h", 1, 6).alias("_head")).agg(F.count("*").alias("_n")), "heads")

    def summed(heads: DataFrame, before: Column) -> DataFrame:
        upto = Window.partitionBy(F.lit(0)).orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)
        return heads.withColumn("_end", before + F.sum("_n").over(upto))

    def first_past(heads: DataFrame, n: int) -> tuple[Column, Column]:
        """The head that holds the n-th row, and the rows before it."""
        past = heads.where(F.col("_end") >= n)
        return past.agg(F.min("_head")).scalar(), past.agg(F.min(F.col("_end") - F.col("_n"))).scalar()

    coarse = summed(fine.groupBy(F.substring("_head", 1, 3).alias("_head")).agg(F.sum("_n").alias("_n")), F.lit(0))
    total = fine.agg(F.sum("_n")).scalar()

    def cut(n: int) -> Column:
        head, before = first_past(coarse, n)
        head, before = first_past(summed(fine.where(F.substring("_head", 1, 3) == head), before), n)
        inside = keyed.where(F.substring("_h", 1, 6) == head)
        rank = F.row_number().over(Window.partitionBy(F.substring("_h", 1, 6)).orderBy("_h"))
        return inside.withColumn("_rank", rank + before).where(F.col("_rank") == n).agg(F.max("_h")).scalar()

    def torn(n: int) -> Column:
        """Whether the rows up to the n-th digest are not n rows."""
        return F.lit(False) if n == 0 else keyed.where(F.col("_h") <= cut(n)).agg(F.count("*")).scalar() != n

    own = F.concat(digest, F.lit("-"), label)
    too_few = F.coalesce(total, F.lit(0)) < n_test + n_val
    split = F.when(own <= cut(n_test), "test") if n_test else F.when(F.lit(False), "test")
    split = split.when(own <= cut(n_test + n_val), "val") if n_test + n_val else split
    return df.withColumn(
        "split",
        F.when(too_few, F.raise_error(F.lit("the split sizes are larger than the table")))
        .when(torn(n_test) | torn(n_test + n_val), F.raise_error(F.lit(
            f"a cut falls between rows that are equal in {', '.join([key, *ties])}: name columns that tell them apart in ties")))
        .otherwise(split.otherwise("train")),
    )


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows and share per split."""
    counts = df.groupBy("split").agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", F.bround(F.col("n_rows") * 100.0 / total, 1))


def tail_holdout(df: DataFrame, order: str, n_test: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n_test`` rows by a column, and by ``ties`` where its values
    repeat, are the test set.  A cut between rows that are equal in all of
    them is an error."""
    rank = F.struct(order, *ties)
    last = df.select(rank.alias("_o")).orderBy(F.desc("_o")).limit(n_test)
    first_test, found = last.agg(F.min("_o")).scalar(), last.agg(F.count("*")).scalar()
    reached = df.select(rank.alias("_o")).where(F.col("_o") >= first_test).agg(F.count("*")).scalar()
    return df.withColumn(
        "split",
        F.when(found < n_test, F.raise_error(F.lit("the test size is larger than the table")))
        .when(reached > n_test, F.raise_error(F.lit(
            f"the cut falls between rows that are equal in {', '.join([order, *ties])}: name columns that tell them apart in ties")))
        .when(rank >= first_test, "test").otherwise("train"),
    )


def split_leakage(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur in more than one split, per pair of splits."""
    has = {s: F.max(F.when(F.col("split") == s, 1).otherwise(0)) for s in ("train", "val", "test")}
    per_key = df.groupBy(key.alias("_k")).agg(*[e.alias(s) for s, e in has.items()])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    return per_key.agg(
        F.count("*").alias("n_keys"),
        *[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0)).alias(f"{x}_{y}") for x, y in pairs],
    )
