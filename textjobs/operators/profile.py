"""Profiles and audits: one pass over the table wherever possible."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textjobs.functions.text import is_blank, not_blank, r4, word_count, wstrip
from textjobs.operators.quantiles import exact_quantiles, value_table
from textjobs.sources.files import save_and_reread


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """256-bit digest of a row in which null differs from empty text and the
    borders between columns count.  Shuffling it is cheaper than shuffling
    the row."""
    parts = []
    for name in columns or df.columns:
        text = F.col(f"`{name}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, columns, nulls, null share, non-null count."""
    names = df.columns
    counts = df.agg(F.count("*").alias("n_rows"), *[
        F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)
    ])
    long = counts.select("n_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_filled")) for i, c in enumerate(names)
    ])).alias("x"))
    n, filled = F.col("n_rows"), F.col("x.n_filled")
    return long.select(
        F.col("x.column_name"), "n_rows", F.lit(len(names)).alias("n_columns"),
        (n - filled).alias("n_null"), filled.alias("n_filled"),
        F.bround(F.try_divide((n - filled) * 100.0, n), 1).alias("null_pct"),
        F.bround(F.try_divide(filled * 100.0, n), 1).alias("coverage_pct"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeats; null equals null."""
    per_row = df.select(row_digest(df).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def value_counts(df: DataFrame, column: str, keep_null: bool = False, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; ties are broken by the value."""
    if not keep_null:
        df = df.where(F.col(column).isNotNull())
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return ordered.limit(top) if top is not None else ordered


def keyword_tag(df: DataFrame, column: str, keywords: list[str], name: str = "tagged") -> DataFrame:
    """True when any keyword is contained in the lower-case label; a null label
    is not tagged."""
    words = F.array(*[F.lit(k) for k in keywords])
    label = F.coalesce(F.lower(column), F.lit(""))
    return df.withColumn(name, F.exists(words, lambda k: F.contains(label, k)))


def length_profile(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Word-count minimum, median, mean, maximum and 95th percentile."""
    words = df.where(F.col(text).isNotNull()).select(*keys, word_count(text).alias("words"))
    return _number_profile(words, "words", keys, [
        F.sum("_c").alias("n_texts"), F.min("_v").cast("int").alias("min_words"),
        r4(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_words"),
        F.max("_v").cast("int").alias("max_words"),
    ], {"median_words": 0.5, "p95_words": 0.95})


def numeric_profile(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Minimum, median, mean, maximum and number of zeros of the numbers."""
    return _number_profile(df, column, keys, [
        F.sum("_c").alias("n_values"), F.min("_v").alias("min_value"), F.max("_v").alias("max_value"),
        F.bround(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), 2).alias("mean_value"),
        F.coalesce(F.sum(F.when(F.col("_v") == 0, F.col("_c"))), F.lit(0)).alias("n_zero"),
    ], {"median_value": 0.5})


def _number_profile(df: DataFrame, column: str, keys: list[str], totals: list[Column], wanted: dict[str, float]) -> DataFrame:
    """Totals and quantiles from counts of the distinct values, which are
    stored, so the table itself is read once.  The keys travel as one struct,
    in which null is a key like any other."""
    group = ["_k"] if keys else []
    values = df.select(*[F.struct(*keys).alias(g) for g in group], F.col(column).alias("_value"))
    counted = save_and_reread(value_table(values, "_value", group), "values")
    base = counted.groupBy(*group).agg(*totals)
    quantiles = exact_quantiles(counted, list(wanted.values()), group)
    wide = quantiles.groupBy(*group).agg(*[
        r4(F.max(F.when(F.col("p") == p, F.col("quantile")))).alias(name) for name, p in wanted.items()
    ])
    if not keys:
        return base.withColumns({name: wide.select(name).scalar() for name in wanted})
    return base.join(wide, group, "left").select("_k.*", *[c for c in base.columns if c != "_k"], *wanted)


def filter_audit(df: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """Rows before and after an allowlist, share kept, labels kept and dropped."""
    ok = F.coalesce(F.col(label).isin(allowed), F.lit(False))
    return (
        df.select(F.col(label).alias("label"), ok.alias("ok"))
        .groupBy("label", "ok").agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n_after"),
            F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("n_dropped"),
            F.bround(F.try_divide(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) * 100.0, F.sum("n")), 1)
            .alias("kept_pct"),
            F.count_if(F.col("ok")).alias("labels_kept"),
            F.count_if(~F.col("ok") & F.col("label").isNotNull()).alias("labels_dropped"),
        )
    )


def pair_audit(df: DataFrame, user: str, assistant: str, label: str) -> DataFrame:
    """Blank user and assistant texts and rows that have a label."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(is_blank(user)).alias("empty_user"),
        F.count_if(is_blank(assistant)).alias("empty_assistant"),
        F.count(label).alias("with_label"),
    )


def length_budget(df: DataFrame, text: str, budgets: list[int], keys: list[str]) -> DataFrame:
    """Share of texts within each budget of white-space tokens."""
    words = df.select(*keys, word_count(text).alias("words"))
    return words.groupBy(*keys).agg(F.count("*").alias("n_texts"), *[
        r4(F.avg(F.when(F.col("words") <= b, 1.0).otherwise(0.0))).alias(f"within_{b}") for b in budgets
    ])


def required_fields_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows dropped at each of the ordered non-blank checks, in one pass."""
    step = F.lit(len(columns))
    for i in reversed(range(len(columns))):
        step = F.when(is_blank(columns[i]), i).otherwise(step)
    return df.select(step.alias("step")).agg(
        F.count("*").alias("n_before"),
        *[F.count_if(F.col("step") == i).alias(f"dropped_{c}") for i, c in enumerate(columns)],
        F.count_if(F.col("step") == len(columns)).alias("n_after"),
    )


def head_sample(df: DataFrame, order: str, columns: dict[str, int | None]) -> DataFrame:
    """First row in the given order, with texts cut to a number of characters."""
    first = df.orderBy(order).limit(1)
    return first.select(order, *[
        F.col(c) if n is None else F.substring(c, 1, n).alias(c) for c, n in columns.items()
    ])


def require_text(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(not_blank(c))
    return df


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip every string column; other types stay untouched."""
    return df.withColumns({c: wstrip(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})
