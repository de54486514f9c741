"""Exact quantiles without gathering a group in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textjobs.sources.files import save_and_reread


def value_table(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct values ``_v`` per key with their number of rows ``_c``."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    )


#: Distinct values of a range that one task may order.
MOST_VALUES = 100_000


def exact_quantiles(counted: DataFrame, probs: list[float], keys: list[str], parts: int = 64, most: int = MOST_VALUES) -> DataFrame:
    """Exact quantiles of a value table with linear interpolation, one row per
    key and probability.

    Spark's own exact percentile keeps every distinct value of a group in one
    buffer.  Here a group is a range to begin with.  A pass cuts every range
    that holds a wanted rank into ``parts`` by a bounded sketch, counts the
    pieces, and keeps those with a wanted rank; passes go on until no range
    has more than ``most`` distinct values.  Only then are ranges ordered, a
    range in a task.  Every pass is written, and read by the next, so a plan
    is as long as one pass; the driver learns one number from each.
    """
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    position = (F.col("_n") - 1) * F.col("p")
    each = totals.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    ranks = F.array_distinct(F.array(F.floor(position).cast("bigint"), F.ceil(position).cast("bigint")))
    targets = each.select(*keys, "p", position.alias("_position"), F.explode(ranks).alias("_rank")).groupBy(*keys).agg(
        F.collect_list(F.struct("p", "_rank", "_position")).alias("_targets"))
    # a range: its number, the rows before it, and the wanted ranks in it (two per probability at most)
    wanted = targets.select(*keys, F.lit("").alias("_range"), F.lit(0).cast("bigint").alias("_before"), "_targets")
    rows, left = counted.withColumn("_range", F.lit("")), None
    while True:
        rows, wanted, largest = _refined(rows, wanted, keys, parts)
        if largest <= most or largest == left:
            break
        left = largest
    inside = rows.join(_nullsafe(wanted, keys), _same(keys, rows), "inner").drop(*[f"_k{i}" for i in range(len(keys))], "_r")
    order = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        inside.withColumn("_end", F.col("_before") + F.sum("_c").over(order))
        .select(*keys, "_v", "_c", "_end", F.explode("_targets").alias("_t"))
        .where((F.col("_t._rank") < F.col("_end")) & (F.col("_t._rank") >= F.col("_end") - F.col("_c")))
    )
    low, high = F.min("_v"), F.max("_v")
    share = F.max("_t._position") - F.floor(F.max("_t._position"))
    return picked.groupBy(*keys, F.col("_t.p").alias("p")).agg((low + (high - low) * share).alias("quantile"))


def _nullsafe(wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges with their keys under other names: a null key is a group as well."""
    return wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before", "_targets")


def _same(keys: list[str], rows: DataFrame) -> Column:
    same = rows["_range"] == F.col("_r")
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(F.col(f"_k{i}"))
    return same


def _refined(rows: DataFrame, wanted: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame, int]:
    """One pass: (the rows of the pieces with a wanted rank, those pieces, the
    most distinct values of one of them)."""
    extra = [f"_k{i}" for i in range(len(keys))] + ["_r"]
    cuts = [i / parts for i in range(1, parts)]
    bounds = rows.groupBy(*keys, "_range").agg(F.percentile_approx("_v", cuts, parts * 50).alias("_bounds"))
    bounds = bounds.join(_nullsafe(wanted, keys), _same(keys, bounds)).select(*extra, "_before", "_targets", "_bounds")
    piece = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    cut = rows.join(bounds, _same(keys, rows)).select(*keys, "_v", "_c", "_range", piece.alias("_piece"), "_before", "_targets")
    sizes = cut.groupBy(*keys, "_range", "_piece").agg(
        F.sum("_c").alias("_size"), F.count("*").alias("_values"), F.first("_before").alias("_before"), F.first("_targets").alias("_targets"))
    # at most `parts` rows per range reach this window
    upto = Window.partitionBy(*keys, "_range").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("_begin", F.col("_before") + F.sum("_size").over(upto) - F.col("_size"))
    here = F.filter("_targets", lambda t: (t["_rank"] >= F.col("_begin")) & (t["_rank"] < F.col("_begin") + F.col("_size")))
    number = F.concat(F.col("_range"), F.lit("/"), F.col("_piece").cast("string"))
    pieces = save_and_reread(placed.select(
        *keys, number.alias("_range"), F.col("_begin").alias("_before"), here.alias("_targets"), "_values").where(F.size("_targets") > 0), "ranges")
    kept = cut.select(*keys, "_v", "_c", number.alias("_range"))
    kept = save_and_reread(kept.join(_nullsafe(pieces, keys).select(*extra), _same(keys, kept), "left_semi"), "range-values")
    return kept, pieces.drop("_values"), pieces.agg(F.max("_values")).first()[0] or 0
