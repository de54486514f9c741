"""The preparation chain as one job: from two raw tables to split folders."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from textjobs.functions.fixed import ALLOWED_CUISINES, TAG_KEYWORDS
from textjobs.operators.formatting import build_pairs
from textjobs.operators.prep import allowlist_filter, clean_dataset, ingest_nulls, merge_sources
from textjobs.operators.profile import keyword_tag
from textjobs.operators.split import holdout_split
from textjobs.sources.files import save_and_reread


def prepare_corpus(a: DataFrame, b: DataFrame, target: str, n_test: int, n_val: int, seed: int = 42,
                   allowed: list[str] = ALLOWED_CUISINES, keywords: list[str] = TAG_KEYWORDS,
                   audit: dict[str, int] | None = None) -> DataFrame:
    """Filters both tables by label, merges and cleans them, writes prompt and
    response of every row, tags its label, and stores the rows in one folder
    per split under ``target``; returns what is read back from there.

    The formatted rows are stored once before they are split, so the merge is
    not repeated for every pass of the split.  Names tell rows apart; where
    they repeat, the texts do.

    ``audit`` is filled with counts that the two writes observe on their way,
    without a job of their own: rows with an allowed label in each table, rows
    with a prompt and a response, rows without a name, tagged rows, and rows
    written per split.
    """
    seen = {n: Observation() for n in ("a", "b", "pairs", "splits")}
    kept = [allowlist_filter(df, "Cuisine", allowed).observe(seen[n], F.count("*").alias("n")) for df, n in ((a, "a"), (b, "b"))]
    cleaned = clean_dataset(ingest_nulls(merge_sources(*kept)))
    pairs = keyword_tag(build_pairs(cleaned, ["TranslatedRecipeName"]), "cuisine", keywords)
    pairs = pairs.withColumnRenamed("TranslatedRecipeName", "name").observe(
        seen["pairs"], F.count("*").alias("n"), F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("unnamed"),
        F.count_if("tagged").alias("tagged"))
    stored = save_and_reread(pairs, "pairs")
    parts = holdout_split(stored, "name", n_test, n_val, seed, ties=("user_message", "assistant_response"))
    parts.observe(seen["splits"], *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test", "val")]).write.mode(
        "overwrite").partitionBy("split").parquet(target)
    if audit is not None:
        audit.update({"allowed_a": seen["a"].get["n"], "allowed_b": seen["b"].get["n"]})
        audit.update({f"pairs_{k}": v for k, v in seen["pairs"].get.items()} | seen["splits"].get)
    return a.sparkSession.read.schema(parts.schema).parquet(target)
