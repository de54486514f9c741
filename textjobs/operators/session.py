"""Jobs behind the interactive view: history, step cursor, pickers, lookups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textjobs.functions.fixed import DEFAULT_DISH
from textjobs.functions.hashing import hash_pick
from textjobs.functions.text import split_trim, wstrip
from textjobs.operators.ordered import carry_forward, latest_per_key


def recent_history(df: DataFrame, session: list[str], bucket: str | None, order: list[str], name: str, n: int = 5,
                   steps: str | None = None) -> DataFrame:
    """Last ``n`` entries per session, newest first, consecutive repeats
    dropped.  Entries need a name and, where ``steps`` names an array column,
    at least one step."""
    known = df.where(F.col(name).isNotNull() & (F.col(name) != ""))
    if steps:
        known = known.where(F.size(F.coalesce(steps, F.array().cast(known.schema[steps].dataType))) > 0)
    previous = carry_forward(known, session, bucket, order, [F.col(name)], ["_prev"], include_current=False)
    changed = previous.where(~F.col(name).eqNullSafe(F.col("_prev"))).drop("_prev")
    return latest_per_key(changed, session, bucket, order, n, "position")


def step_cursor(df: DataFrame, steps: str, keep: list[str]) -> DataFrame:
    """One row per step with its number, progress and clamped neighbours."""
    rows = df.select(*keep, F.size(steps).alias("n_steps"), F.posexplode(steps).alias("step_idx", "step"))
    i, n = F.col("step_idx"), F.col("n_steps")
    return rows.select(
        *keep, "step_idx", "n_steps", "step", F.floor((i + 1) / n * 100).cast("int").alias("progress_pct"),
        F.least(i + 1, n - 1).alias("next_idx"), F.greatest(i - 1, F.lit(0)).alias("prev_idx"),
    )


def step_at(steps: Column, index: Column) -> Column:
    """The step at an index; out of range shows the first."""
    return F.coalesce(F.when(index >= 0, F.get(steps, index)), F.get(steps, F.lit(0)))


def list_union(groups: Column, custom: Column) -> Column:
    """Chosen items of all groups, then the typed comma list; the first
    occurrence wins and case matters."""
    return F.array_distinct(F.concat(
        F.flatten(F.filter(groups, lambda g: g.isNotNull())),
        F.coalesce(split_trim(custom, ","), F.array().cast("array<string>"))))


def category_flatten(df: DataFrame, category: str, items: str) -> DataFrame:
    """One row per category item, repeats kept, with the number of its uses."""
    flat = df.select(category, F.explode(items).alias("item"))
    uses = flat.groupBy("item").agg(F.count("*").alias("n_uses"))
    return flat.join(uses, "item").select(category, "item", "n_uses")


def keyword_lookup(df: DataFrame, text: str, dictionary: list[tuple[str, str]], template: str, slot: str,
                   keep: list[str]) -> DataFrame:
    """Text of the first dictionary key contained in the message, else the
    template with the dish that the message asks for.

    The dictionary is a short list in order of priority, so each row looks it
    up in place; nothing is joined.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in dictionary])
    low = F.lower(F.col(text))
    hit = F.get(F.filter(entries, lambda e: F.contains(low, e["k"])), F.lit(0))
    asked = r"(?is)recipe for ([^\n]+?)\n?\z"
    dish = F.when(F.regexp_like(F.col(text), F.lit(asked)),
                  title_case(wstrip(F.regexp_extract(text, asked, 1)))).otherwise(DEFAULT_DISH)
    return df.select(
        *keep, hit["k"].alias("matched"),
        F.coalesce(hit["v"], F.replace(F.lit(template), F.lit(slot), dish)).alias("answer"),
    )


def title_case(text: Column) -> Column:
    """Upper case for the first letter of each run of letters, else lower."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def seeded_choice(df: DataFrame, key: str, options: list[list[str]], seed: int, keep: list[str]) -> DataFrame:
    """A reproducible choice of one option per row."""
    table = F.array(*[F.array(*[F.lit(i) for i in o]) for o in options])
    picked = hash_pick(seed, F.col(key), len(options))
    return df.select(*keep, picked.alias("choice"), F.get(table, picked).alias("items"))


def dictionary_audit(df: DataFrame, items: Column, dictionary: DataFrame, column: str) -> DataFrame:
    """Items that are in no dictionary category, with their number of uses.
    Uses are counted first, so a frequent item joins once."""
    used = df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n_uses"))
    known = dictionary.select(F.col(column).alias("item")).distinct()
    return used.join(known, "item", "left_anti")
