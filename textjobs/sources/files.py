"""Readers and writers.  Schemas are always declared, never inferred."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.text import wstrip

SCORE_COLUMNS = (
    "ingredient_f1 DOUBLE, ingredient_precision DOUBLE, ingredient_recall DOUBLE, "
    "rouge_l DOUBLE, bleu_sentence DOUBLE"
)
ROW_RESULT_SCHEMA = (
    "model_id STRING, row_index BIGINT, user_message STRING, reference_text STRING, "
    "generated_text STRING, ref_name STRING, ref_ingredients ARRAY<STRING>, "
    "ref_instructions STRING, gen_name STRING, gen_ingredients ARRAY<STRING>, "
    "gen_instructions STRING, " + SCORE_COLUMNS
)
AGGREGATE_SCHEMA = (
    "model_id STRING, n_samples BIGINT, ingredient_f1_mean DOUBLE, ingredient_f1_ci_lower DOUBLE, "
    "ingredient_f1_ci_upper DOUBLE, rouge_l_mean DOUBLE, rouge_l_ci_lower DOUBLE, "
    "rouge_l_ci_upper DOUBLE, bleu_corpus DOUBLE, bertscore_mean_f1 DOUBLE, "
    "bertscore_mean_precision DOUBLE, bertscore_mean_recall DOUBLE, bertscore_ci_lower DOUBLE, "
    "bertscore_ci_upper DOUBLE"
)
TRAINER_LOG_SCHEMA = (
    "best_global_step BIGINT, best_metric DOUBLE, global_step BIGINT, log_history ARRAY<STRUCT<"
    "step: BIGINT, epoch: DOUBLE, loss: DOUBLE, learning_rate: DOUBLE, grad_norm: DOUBLE, "
    "entropy: DOUBLE, mean_token_accuracy: DOUBLE, num_tokens: DOUBLE, eval_loss: DOUBLE, "
    "eval_entropy: DOUBLE, eval_mean_token_accuracy: DOUBLE, eval_num_tokens: DOUBLE, "
    "eval_runtime: DOUBLE, eval_samples_per_second: DOUBLE, eval_steps_per_second: DOUBLE>>"
)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared folder that the session names.

    Without ``spark.checkpoint.dir`` only a local session gets a folder of its
    own: on a cluster a machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="textjobs-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Deals the rows of a scan out to all cores when the scan has fewer
    splits than there are cores, as with one small file of long texts.  A
    large table has many splits and is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def save_and_reread(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a stage once and go on from the files: the lineage ends here, and
    a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, null_literals: list[str] | None = None,
             multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted text.  Empty cells are null; further literals
    become null only when they are listed.  Text with line breaks needs
    ``multi_line``, which makes a file one task: such data is ingested to
    Parquet once (``ingest_once``).  Without line breaks, say so, and files are
    split."""
    df = (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"')
        .csv(path)
    )
    if null_literals:
        df = df.withColumns({
            name: F.when(~F.col(f"`{name}`").isin(null_literals), F.col(f"`{name}`"))
            for name, kind in df.dtypes if kind == "string"
        })
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON Lines (splittable), or whole-file JSON arrays with ``lines=False``."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_metrics_files(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """One row per metrics record, with the name of its file."""
    df = read_json(spark, pattern, AGGREGATE_SCHEMA, lines)
    return df.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_trainer_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The log history of trainer state files, one row per record."""
    state = read_json(spark, path, TRAINER_LOG_SCHEMA, lines)
    return state.select(F.inline("log_history"))


def ingest_once(df: DataFrame, path: str) -> DataFrame:
    """Write only when the target does not exist, and read what is there."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_value_parts(text: Column, marker: str = r"###\s*") -> Column:
    """``### Key: value`` text as an array of (key, value), in text order."""
    parts = F.filter(F.split(text, marker), lambda p: F.contains(p, F.lit(":")))
    return F.transform(parts, lambda p: F.struct(
        wstrip(F.substring_index(p, ":", 1)).alias("key"),
        wstrip(F.substr(p, F.locate(":", p) + 1)).alias("value"),
    ))


def parse_key_values(df: DataFrame, text: str, keys: list[str], keep: list[str]) -> DataFrame:
    """One column per declared key; the last value of a repeated key wins."""
    parsed = df.select(*keep, key_value_parts(F.col(text)).alias("_parts"))
    return parsed.select(*keep, *[
        F.try_element_at(F.filter("_parts", lambda p: p["key"] == k), F.lit(-1))["value"].alias(k)
        for k in keys
    ])


def key_inventory(df: DataFrame, text: str) -> DataFrame:
    """Every key in the table with the number of parts and of rows that have it."""
    parts = df.select(key_value_parts(F.col(text)).alias("parts"))
    per_row = parts.select(F.explode(F.array_distinct(F.transform("parts", lambda p: p["key"]))).alias("key"))
    rows = per_row.groupBy("key").agg(F.count("*").alias("n_rows"))
    every = parts.select(F.explode("parts").alias("part")).groupBy(F.col("part.key").alias("key"))
    return every.agg(F.count("*").alias("n_parts")).join(rows, "key")
