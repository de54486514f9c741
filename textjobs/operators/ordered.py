"""Order-dependent steps that stay parallel inside one key.

A window over a key sends all its rows to one task.  These helpers cut each
key into buckets, work inside a bucket, and carry one summary row per bucket
across.  A bucket is a column of the caller's (an hour, a block of steps), or
without one a segment that is cut by counts (``segmented``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textjobs.sources.files import save_and_reread


def segmented(df: DataFrame, keys: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """``df`` with ``_segment``, which ascends along (keys, order): the table
    is dealt out by ranges of both with about equal numbers of rows, so a key
    that holds most rows is cut into most segments, wherever in its order they
    lie.  ``segments`` is the number of ranges, else that of shuffle
    partitions.  Rows equal in all these columns share a segment.  The number
    is stored with the row, once."""
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return save_and_reread(ranged.withColumn("_segment", F.spark_partition_id()), "segments")


def carry_forward(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], values: list[Column],
                  names: list[str], include_current: bool) -> DataFrame:
    """Adds the last non-null value before each row (or up to it) in key order.

    ``values`` are columns over ``df``; ``bucket`` must not decrease along
    ``order``; without it segments are cut by counts.
    """
    if bucket is None:
        named = df.select("*", *[v.alias(f"_x{i}") for i, v in enumerate(values)])
        placed = [F.col(f"_x{i}") for i in range(len(values))]
        carried = carry_forward(segmented(named, keys, order), keys, "_segment", order, placed, names, include_current)
        return carried.select(*df.columns, *names)
    # a struct is never null and compares its null fields as equal, so one
    # partitioning serves the window, the aggregate and the join
    group = F.struct(*keys, bucket).alias("_g")
    rows = df.select("*", group, *[
        F.when(v.isNotNull(), F.struct(v.alias("v"))).alias(f"_s{i}") for i, v in enumerate(values)])
    end = 0 if include_current else -1
    here = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    ends = rows.groupBy("_g").agg(*[
        F.max_by(f"_s{i}", F.when(F.col(f"_s{i}").isNotNull(), F.struct(*order))).alias(f"_e{i}")
        for i in range(len(values))
    ])
    earlier = Window.partitionBy(*[f"_g.{k}" for k in keys]).orderBy(f"_g.{bucket}").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = ends.select("_g", *[
        F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_c{i}") for i in range(len(values))
    ])
    inside = rows.withColumns({
        f"_w{i}": F.last(f"_s{i}", ignorenulls=True).over(here) for i in range(len(values))
    })
    return inside.join(carried, "_g").select(*df.columns, *[
        F.coalesce(F.col(f"_w{i}"), F.col(f"_c{i}"))["v"].alias(name) for i, name in enumerate(names)
    ])


def latest_per_key(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], n: int, rank: str) -> DataFrame:
    """The last ``n`` rows per key, newest first; each bucket is cut to ``n``
    rows before the key is ranked.  Without ``bucket``, segments are cut by counts."""
    if bucket is None:
        return latest_per_key(segmented(df, keys, order), keys, "_segment", order, n, rank).drop("_segment")
    newest = [F.desc(c) for c in order]
    cut = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*newest)))
    cut = cut.where(F.col("_r") <= n).drop("_r")
    ranked = cut.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.where(F.col(rank) <= n)


def row_places(df: DataFrame, keys: list[str], order: list[str], name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row in its key, from zero, whatever the size of
    the key: rows are numbered inside segments cut by counts, and the numbers
    of the segments before are added to them.  ``ties`` order rows that are
    equal in ``order`` and do not cut segments, so they may be long texts.
    Equal rows get different places in no fixed order; null keys are a key."""
    cut = segmented(df, keys, order)
    group = F.struct(*keys, "_segment")
    rows = cut.withColumn("_g", group)
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))  # one row per key and segment
    before = Window.partitionBy(*[f"_g.{k}" for k in keys]).orderBy("_g._segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_g").orderBy(*order, *ties)
    numbered = rows.withColumn("_i", F.row_number().over(here) - 1)
    return numbered.join(starts, "_g").select(*df.columns, (F.col("_i") + F.col("_before")).alias(name))
