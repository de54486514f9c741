"""Registry of the queries, each with the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textjobs.functions.text import WS, WS_CHARS
from textjobs.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the name of its function or another one."""
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLE[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are long texts, dealt out to all cores."""
    return spread(table(spark, sf_dir, name))


# SQL fragments used by the checks

def sql_strip(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: t <> '')"


def sql_parts(x: str, separator: str = ",") -> str:
    """Split at a literal, strip, drop blanks."""
    return f"list_filter(list_transform(string_split({x}, {separator!r}), lambda t: {sql_strip('t')}), lambda t: t <> '')"


def sql_key(x: str) -> str:
    return f"substr({sql_strip(x)}, 1, 80)"


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda t: {sql_strip('t')}), lambda t: t <> '')"
