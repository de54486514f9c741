"""Corpus preparation: labels, keys, enrichment, union, cleaning."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textjobs.functions.fixed import ALLOWED_CUISINES, ENRICHMENT_COLUMNS, KEPT_COLUMNS, MERGED_COLUMNS
from textjobs.functions.text import empty_to_null, normalise_label, prefix_key
from textjobs.operators.profile import require_text, strip_strings


def ingest_nulls(df: DataFrame) -> DataFrame:
    """Empty strings become null once, where the data enters."""
    return df.withColumns({c: empty_to_null(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})


def allowlist_filter(df: DataFrame, label: str, allowed: list[str] = ALLOWED_CUISINES) -> DataFrame:
    """Rows whose normalised label is in the list; a null label drops out."""
    return df.withColumn(label, normalise_label(label)).where(F.col(label).isin(allowed))


def allowlist_table_filter(df: DataFrame, label: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """The same with the allowed values in a table; Spark picks the strategy."""
    keys = allowed.select(F.col(allowed_column).alias("_allowed"))
    named = df.withColumn(label, normalise_label(label))
    return named.join(keys, F.col(label) == F.col("_allowed"), "left_semi")


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each key in the given order; null is a key as well.

    An aggregate rather than a window: each task reduces its own rows first,
    so a key that holds a third of the table costs one row per task.
    """
    picked = df.groupBy(key).agg(F.min_by(F.struct(*[f"`{c}`" for c in columns]), order).alias("_row"))
    return picked.select(key, "_row.*")


def enrich_left_join(a: DataFrame, b: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A with columns of the first row of B that has the same key (null = null).

    B is reduced to one row per key before the join, so rows never multiply;
    adaptive execution splits a key that is frequent in A.
    """
    right = first_per_key(b, key, order, columns).withColumnRenamed(key, "_key")
    return a.join(right, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def anti_join_rows(b: DataFrame, a: DataFrame, key: str) -> DataFrame:
    """Rows of B whose key does not occur in A; a null key of A covers null."""
    known = a.select(F.col(key).alias("_key")).distinct()
    return b.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def reindex(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly these columns in this order; missing ones are null."""
    types = types or {}
    have = set(df.columns)
    return df.select(*[
        F.col(f"`{c}`") if c in have else F.lit(None).cast(types.get(c, "string")).alias(c) for c in columns
    ])


def merge_sources(a: DataFrame, b: DataFrame, text: str = "TranslatedInstructions", order: str = "ord",
                  columns: list[str] = MERGED_COLUMNS, enrichment: list[str] = ENRICHMENT_COLUMNS,
                  key_length: int = 80) -> DataFrame:
    """Left-join the enrichment of B onto A, then append the rows only B has.

    The appended rows have no value in the columns that B lacks; a later
    filter on such a column removes the branch from the plan.
    """
    types = {c: kind for df in (b, a) for c, kind in df.dtypes}
    a = a.withColumn("_k", prefix_key(text, length=key_length))
    b = b.withColumn("_k", prefix_key(text, length=key_length))
    enriched = enrich_left_join(a.drop(*enrichment), b, "_k", order, enrichment)
    new_rows = anti_join_rows(b, a, "_k")
    return reindex(enriched, columns, types).unionByName(reindex(new_rows, columns, types))


def join_audit(a: DataFrame, b: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Rows of A, rows that received a value, the rest, and rows only in B."""
    joined = enrich_left_join(a.select(key), b, key, order, [column])
    only_b = anti_join_rows(b.select(key), a, key)
    counts = joined.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_enriched"))
    return counts.select(
        "n_rows", "n_enriched", (F.col("n_rows") - F.col("n_enriched")).alias("n_unmatched"),
        only_b.agg(F.count("*")).scalar().alias("n_only_b"),
    )


def key_flags(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables with flags for the sides that have them;
    one shuffle of keys that are already combined per task."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("k").agg(F.max("a").alias("in_a"), F.max("b").alias("in_b"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each side, in both, on one side only, and in all."""
    in_a, in_b = F.col("in_a") == 1, F.col("in_b") == 1
    return key_flags(a, b, key).agg(
        F.count_if(in_a).alias("keys_a"), F.count_if(in_b).alias("keys_b"),
        F.count_if(in_a & in_b).alias("both"), F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(in_b & ~in_a).alias("only_b"), F.count("*").alias("keys_all"),
    )


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the set it belongs to: both, only_a or only_b."""
    return key_flags(a, b, key).select(
        F.col("k").alias("key"),
        F.when(F.col("in_a") + F.col("in_b") == 2, "both")
        .when(F.col("in_a") == 1, "only_a").otherwise("only_b").alias("part"),
    )


#: What reads as a number; a cast alone would also take suffixes such as ``12d``.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def coerce_number(df: DataFrame, column: str) -> DataFrame:
    """Text to number (null when it is none), zero to null."""
    text = F.col(f"`{column}`").cast("string")
    number = F.when(F.regexp_like(text, F.lit(NUMBER)), text.try_cast("double"))
    return df.withColumn(column, F.nullif(number, F.lit(0.0)))


def clean_dataset(df: DataFrame, keep: list[str] = KEPT_COLUMNS, name: str = "TranslatedRecipeName",
                  required: tuple[str, ...] = ("TranslatedIngredients", "TranslatedInstructions"),
                  number: str = "TotalTimeInMins") -> DataFrame:
    """Drop columns, require a name, drop equal rows, require the other texts,
    coerce the time, strip.  Rows that are equal only after stripping stay."""
    named = require_text(df.select(*[f"`{c}`" for c in keep]), [name])
    complete = require_text(named.dropDuplicates(), list(required))
    return strip_strings(coerce_number(complete, number))


def _digested(df: DataFrame, columns: list[str], required: list[str], text: str, key_length: int) -> DataFrame:
    """Rows that have the required texts, empty strings as null, with their key
    ``_k`` and ``_d``, a digest of all ``columns``; 0.0 and -0.0 are one value."""
    kinds = dict(df.dtypes)
    keyed = require_text(df, required).select(*[f"`{c}`" for c in columns], prefix_key(text, length=key_length).alias("_k"))
    values = [F.col(f"`{c}`") + 0.0 if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in columns]
    rows = keyed.withColumns({c: empty_to_null(F.col(f"`{c}`")) for c in columns if kinds[c] == "string"})
    digest = F.unhex(F.sha2(F.to_json(F.struct(*[v.alias(c) for v, c in zip(values, columns)])), 256))
    # it is never null; said so, no filter in front of the join computes it again
    return rows.withColumn("_d", F.coalesce(digest, F.lit(b"")))


def merge_and_clean(a: DataFrame, b: DataFrame, text: str = "TranslatedInstructions", order: str = "ord",
                    keep: list[str] = KEPT_COLUMNS, enrichment: list[str] = ENRICHMENT_COLUMNS, name: str = "TranslatedRecipeName",
                    required: tuple[str, ...] = ("TranslatedIngredients", "TranslatedInstructions"),
                    number: str = "TotalTimeInMins", key_length: int = 80) -> DataFrame:
    """What ``clean_dataset(ingest_nulls(merge_sources(a, b)))`` gives, with
    every text in one shuffle instead of two.

    Equal rows of A have equal keys and so the same enrichment: they can be
    dropped before it is joined.  Keys and digests alone go through the join
    with B, where adaptive execution splits a key that holds much of the table;
    the rows themselves are shuffled once, by their digest, and equal rows
    are reduced inside each task before.  A second pass over A costs a scan.
    ``text`` must be among ``keep`` and ``required``.  Rows without a name or a
    required text go, as do rows only B has where B has no name column.
    """
    if text not in keep or text not in required:
        raise ValueError(f"{text} must be kept and required")
    types = {c: kind for df in (b, a) for c, kind in df.dtypes}
    own = [c for c in keep if c in a.columns and c not in enrichment]
    added = [c for c in enrichment if c in keep]
    wide = _digested(a, own, [name, *required], text, key_length)
    keyed_b = b.withColumn("_key", prefix_key(text, length=key_length))
    first = first_per_key(keyed_b, "_key", order, added)
    keys = wide.select("_d", "_k").distinct()
    facts = ingest_nulls(keys.join(first, F.col("_k").eqNullSafe(F.col("_key")), "left").select("_d", *[f"`{c}`" for c in added]))
    rows = reindex(wide.dropDuplicates(["_d"]).join(facts, "_d"), keep, types)
    if name in b.columns and set(required) <= set(b.columns):
        have = [c for c in keep if c in b.columns]
        others = _digested(b, have, [name, *required], text, key_length)
        known = a.select(prefix_key(text, length=key_length).alias("_key")).distinct()
        new = others.select("_d", "_k").distinct().join(known, F.col("_k").eqNullSafe(F.col("_key")), "left_anti")
        rows = rows.unionByName(reindex(others.dropDuplicates(["_d"]).join(new.select("_d"), "_d", "left_semi"), keep, types))
    return strip_strings(coerce_number(rows, number))
