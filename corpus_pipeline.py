"""The corpus pipeline: documents from raw rows to packed sequences of ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.  Empty tables pass through every stage; further
columns are dropped by the first.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textjobs.llm import decontam, langid, secrets
from textjobs.llm.columns import stored
from textjobs.llm.nearjoin import near_join
from textjobs.llm.packing import pack_documents
from textjobs.sources.files import save_and_reread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Characters from which on an ambiguous language is not for want of text.
LONG = 1000
KEPT, NO_LETTER, AMBIGUOUS = "kept", "no letter", "ambiguous"
#: No SQL for classifiers, byte-pair ids and packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def language_decisions(docs: DataFrame, long: int | None = LONG, least_score: float = langid.AMBIGUOUS) -> DataFrame:
    """``docs`` with lang_pred, score and ``decision``: kept, no letter, or
    ambiguous, which is a text of ``long`` characters or more (None: none is)
    whose score is below ``least_score``.  Counted by it, they say what goes."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    known = langid.predict(docs, model)
    if model is None:  # nothing to learn from: only texts without a letter are known to be no language
        letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
        return known.withColumn("decision", F.when(letter, KEPT).otherwise(NO_LETTER))
    unclear = F.lit(False) if long is None else (F.col("score") < least_score) & (F.length("text") >= long)
    return known.withColumn("decision", F.when(F.col("lang_pred") == langid.UNDETERMINED, NO_LETTER).when(unclear, AMBIGUOUS).otherwise(KEPT))


def language_id(
    spark: SparkSession, docs: DataFrame, sf_dir: str, long: int | None = LONG, least_score: float = langid.AMBIGUOUS,
) -> DataFrame:
    """Documents without a letter (null, empty) go, and long ones whose
    language stays ambiguous; a missing lang is filled in."""
    known = language_decisions(docs, long, least_score)
    lang = F.coalesce("lang", F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred")))
    return known.filter(F.col("decision") == KEPT).withColumn("lang", lang).select(*COLUMNS)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a number of every row's own.  The number is
    stored with the row, so every later read has the same."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def by_row(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) that go by their number instead of a doc_id, which may be null or repeated."""
    return rows.select(F.col("row").alias("doc_id"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates one row stays, one with the least
    doc_id; a null doc_id is never the least unless all of a class are null."""
    rows = with_rows(docs)
    classes = near_join(by_row(rows).withColumn("row", F.col("doc_id")), row="row").select("row", "class_id").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    stay = classes.groupBy("class_id").agg(first.alias("first")).select("first.row")
    gone = save_and_reread(rows.select("row").join(stay, "row", "left_anti"), "near-duplicates")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = with_rows(docs)
    found = decontam.search(decontam.build_index(by_row(rows)), items)
    gone = save_and_reread(found.filter("n_hit > 0").select(F.col("doc_id").alias("row")), "contaminated")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars of a changed text is counted again."""
    found = secrets.redact(secrets.find_secrets(docs))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, one row per piece of a document."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024, special_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_and_reread(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
