"""Scores of generated against reference texts, per row and per model."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textjobs.functions.hashing import MAX_DRAW_SIZE, DrawnUnits, draw_positions
from textjobs.functions.sections import normal_items, sections, split_items
from textjobs.functions.stem import gram_matches, worker_words
from textjobs.functions.text import exact_units, is_blank, r4, score_units, tokens
from textjobs.operators.parse import normalise_items

SCORES = ["ingredient_f1", "ingredient_precision", "ingredient_recall", "rouge_l", "bleu_sentence"]


# ---- item precision, recall and F1 --------------------------------------

def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def item_scores(df: DataFrame, generated: str, reference: str, prefix: str = "ingredient_") -> DataFrame:
    """Set precision, recall and F1 of two item lists; an empty side gives 0."""
    sets = df.withColumns({
        "_g": F.coalesce(normalise_items(F.col(generated)), F.array().cast("array<string>")),
        "_r": F.coalesce(normalise_items(F.col(reference)), F.array().cast("array<string>")),
    }).withColumn("_both", F.size(F.array_intersect("_g", "_r")))
    return _prf(sets, F.size("_g"), F.size("_r"), prefix).drop("_g", "_r", "_both")


def _prf(df: DataFrame, n_generated: Column, n_reference: Column, prefix: str) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("_both"), n_generated), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("_both"), n_reference), F.lit(0.0))
    return df.withColumns({
        prefix + "precision": r4(p), prefix + "recall": r4(r), prefix + "f1": r4(_harmonic(p, r)),
    })


def item_table_scores(items: DataFrame, pair: list[str], item: str, is_generated: str) -> DataFrame:
    """The same scores for items kept one per row; no list is ever gathered,
    and both aggregates reduce within each task before they shuffle."""
    per_item = items.groupBy(*pair, item).agg(
        F.max(F.col(is_generated).cast("int")).alias("_g"), F.max((~F.col(is_generated)).cast("int")).alias("_r"))
    named = (F.col(item) != "").cast("int")  # a blank item counts on neither side
    per_pair = per_item.groupBy(*pair).agg(
        F.sum(F.col("_g") * named).alias("n_generated"), F.sum(F.col("_r") * named).alias("n_reference"),
        F.sum(F.col("_g") * F.col("_r") * named).alias("_both"))
    return _prf(per_pair, F.col("n_generated"), F.col("n_reference"), "").drop("_both")


def legacy_scores(df: DataFrame, generated: str, reference: str) -> DataFrame:
    """Overlap of the sets over the length of the lists, repeats included; an
    empty list gives null instead of an error."""
    both = F.size(F.array_intersect(generated, reference))
    return df.withColumns({
        "precision": r4(F.try_divide(both, F.size(generated))),
        "recall": r4(F.try_divide(both, F.size(reference))),
    })


# ---- ROUGE-L ------------------------------------------------------------

TextBatches = Iterator[tuple[pd.Series, pd.Series]]

#: Rows and bytes of an Arrow batch of texts, where the session has Spark's defaults.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
              "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after making the Arrow batches of its session smaller where they
    are at their defaults: ten thousand pairs of whole texts, as Arrow, as
    strings and as tokens, are far more than a task needs in memory."""
    conf = df.sparkSession.conf
    for key, (default, wanted) in TEXT_BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, wanted)
    return df


def _lcs_lengths(stem: bool):
    """Sizes of both token lists and of their longest common subsequence;
    tokens are lower-case runs of ASCII letters and digits."""
    def lengths(batches: TextBatches) -> Iterator[pd.DataFrame]:
        for generated, reference in batches:  # words of a block of pairs at a time
            pairs = worker_words(stem).pairs(zip(generated, reference))
            yield pd.DataFrame([lengths for lengths, _ in pairs], columns=["lcs", "n_gen", "n_ref"])

    return F.pandas_udf(lengths, "lcs bigint, n_gen bigint, n_ref bigint")


def rouge_l(df: DataFrame, generated: str, reference: str, stem: bool = True, name: str = "rouge_l") -> DataFrame:
    """F1 of the longest common subsequence of the two token lists.

    A text pair stays on its row: no shuffle, one Arrow batch after the other.
    """
    empty = F.lit("")
    measured = text_batches(df).withColumn("_l", _lcs_lengths(stem)(F.coalesce(F.col(generated), empty), F.coalesce(F.col(reference), empty)))
    return measured.withColumn(name, _rouge(F.col("_l"))).drop("_l")


def _rouge(measured: Column) -> Column:
    p = F.coalesce(F.try_divide(measured["lcs"], measured["n_gen"]), F.lit(0.0))
    r = F.coalesce(F.try_divide(measured["lcs"], measured["n_ref"]), F.lit(0.0))
    return r4(_harmonic(p, r))


# ---- BLEU ---------------------------------------------------------------

def _gram_counts(order: int):
    def counts(batches: TextBatches) -> Iterator[pd.DataFrame]:
        for generated, reference in batches:
            yield _grams(((g.split(), r.split()) for g, r in zip(generated, reference)), order)

    return F.pandas_udf(counts, ", ".join(f"{c} bigint" for c in _gram_names(order)))


def _gram_names(order: int) -> list[str]:
    return ["gen_len", "ref_len", *[f"m{n}" for n in range(1, order + 1)]]


def _grams(pairs: Iterable[tuple[list[str], list[str]] | list[np.ndarray]], order: int) -> pd.DataFrame:
    names = _gram_names(order)
    return pd.DataFrame(np.concatenate([np.empty((0, len(names)), "int64"), *gram_matches(pairs, order)]), columns=names)


def _candidates(gen_len: Column, order: int) -> dict[str, Column]:
    return {f"t{n}": F.greatest(gen_len - (n - 1), F.lit(0)) for n in range(1, order + 1)}


def ngram_matches(df: DataFrame, generated: str, reference: str, order: int = 4) -> DataFrame:
    """Adds token counts of both sides and, for n = 1..order, clipped matches
    ``m<n>`` and candidate grams ``t<n>``.

    Grams are counted inside their row.  Exploding and grouping them gives the
    same numbers, but moves many times the texts through hash tables: it took
    seven times as long on the 0.1 tables.
    """
    empty = F.lit("")
    counted = text_batches(df).withColumn("_n", _gram_counts(order)(
        F.coalesce(F.col(generated), empty), F.coalesce(F.col(reference), empty)))
    return counted.select(*df.columns, "_n.*").withColumns(_candidates(F.col("gen_len"), order))


def _brevity(gen_len: Column, ref_len: Column) -> Column:
    return F.when(gen_len == 0, 0.0).when(gen_len > ref_len, 1.0).otherwise(
        F.exp(1 - F.try_divide(ref_len, gen_len)))


def sentence_bleu(counts: DataFrame, order: int = 4) -> DataFrame:
    """Adds BLEU per pair to its counts; a precision without matches counts
    0.1 of a match."""
    logs = sum(
        F.ln(F.when(F.col(f"m{n}") == 0, 0.1).otherwise(F.col(f"m{n}")) / F.greatest(F.col(f"t{n}"), F.lit(1)))
        for n in range(1, order + 1)
    )
    score = _brevity(F.col("gen_len"), F.col("ref_len")) * F.exp(logs / order)
    empty = (F.col("m1") == 0) | (F.col("gen_len") == 0) | (F.col("ref_len") == 0)
    return counts.withColumn("bleu_sentence", F.when(empty, 0.0).otherwise(r4(score)))


def corpus_bleu(counts: DataFrame, keys: list[str], order: int = 4) -> DataFrame:
    """BLEU of a whole corpus from the counts of its pairs.  A pair that is
    shorter than n still adds one to the denominator; without any unigram
    match the score is 0; another precision of 0 makes the score vanish."""
    totals = counts.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.sum("gen_len").alias("gen_len"), F.sum("ref_len").alias("ref_len"),
        *[e for n in range(1, order + 1) for e in (
            F.sum(f"m{n}").alias(f"m{n}"), F.sum(F.greatest(F.col(f"t{n}"), F.lit(1))).alias(f"t{n}"))],
    )
    logs = sum(
        F.when(F.col(f"m{n}") == 0, float(np.log(np.finfo(float).tiny))).otherwise(F.ln(F.col(f"m{n}") / F.col(f"t{n}")))
        for n in range(1, order + 1)
    )
    score = _brevity(F.col("gen_len"), F.col("ref_len")) * F.exp(logs / order)
    return totals.select(
        *keys, "n_samples", F.when(F.col("m1") == 0, 0.0).otherwise(r4(score)).alias("bleu_corpus"))


# ---- embedding greedy match ---------------------------------------------

def _match_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def unit(rows) -> np.ndarray:
        m = np.stack([np.asarray(v, dtype="float64") for v in rows])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def best(rows: np.ndarray, others: np.ndarray) -> float:
        # a block of rows at a time, so that long texts need no full matrix
        tops = [(rows[i:i + 512] @ others.T).max(axis=1) for i in range(0, len(rows), 512)]
        return float(np.concatenate(tops).mean())

    for generated, reference in batches:
        out = []
        for g, r in zip(generated, reference):
            if g is None or r is None or len(g) == 0 or len(r) == 0:
                out.append((0.0, 0.0, None))
                continue
            try:
                gm, rm = unit(g), unit(r)
                out.append((best(gm, rm), best(rm, gm), None))
            except (ValueError, TypeError) as e:  # vectors of different widths, or holes: this row only
                out.append((0.0, 0.0, str(e)[:200]))
        yield pd.DataFrame(out, columns=["precision", "recall", "error"])


def greedy_match(df: DataFrame, generated: str, reference: str, prefix: str = "bertscore_") -> DataFrame:
    """Greedy-match precision, recall and F1 of two token-vector lists.

    A text holds at most as many vectors as its encoder takes tokens.  Each
    pair is a few matrix products on its own row; no token pair becomes a row.
    A missing or empty side gives 0; a pair that cannot be compared gives 0 and
    says why in ``<prefix>error``.
    """
    match = F.pandas_udf(_match_batches, "precision double, recall double, error string")
    scored = df.withColumn("_m", match(generated, reference))
    p, r = F.col("_m.precision"), F.col("_m.recall")
    return scored.withColumns({
        prefix + "precision": p, prefix + "recall": r, prefix + "f1": _harmonic(p, r), prefix + "error": F.col("_m.error"),
    }).drop("_m")


def pair_vectors(generated: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Both sides' ``vectors`` by key as ``g`` and ``r``; a text without its
    partner stays, with null on the other side."""
    return generated.select(key, F.col("vectors").alias("g")).join(
        reference.select(key, F.col("vectors").alias("r")), key, "full")


def embedding_tokens(text: Column, placeholder: str = "[empty]") -> Column:
    """Tokens to embed; blank text is embedded as a placeholder."""
    return tokens(F.when(is_blank(text), placeholder).otherwise(text))


def gather_vectors(vectors: DataFrame, text: str, position: str, vector: str, most: int = 4096) -> DataFrame:
    """Token vectors of each text in order; more than ``most``, the encoder's
    length, are an error.  They are counted before any are gathered."""
    sizes = vectors.groupBy(text).agg(F.count("*").alias("_n"))
    over = sizes.where(F.col("_n") > most).agg(F.count("*")).scalar()
    checked = vectors.where(F.when(over > 0, F.raise_error(F.lit(f"a text has more than {most} vectors")).cast("boolean")).otherwise(F.lit(True)))
    rows = checked.groupBy(text).agg(F.array_sort(F.collect_list(F.struct(position, vector))).alias("_v"))
    return rows.select(text, F.transform("_v", lambda x: x[vector]).alias("vectors"))


# ---- means and bootstrap intervals --------------------------------------

def score_means(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Means of row scores that are already rounded; null on no rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_samples"), *[
        r4(F.try_divide(F.sum(score_units(s)), F.count(s)) / 10000).alias(f"{s}_mean") for s in scores
    ])


#: Draws of one replicate that one task makes at a time.
DRAWS = 100_000
#: Draws whose arrays stay in a processor's cache.
CACHED = 25_000


def bootstrap_ci(df: DataFrame, keys: list[str], scores: list[str], n_bootstrap: int = 1000, ci: float = 0.95,
                 seed: int = 42, method: str = "draws") -> DataFrame:
    """Percentile interval of the mean under resampling with replacement.

    A score of four decimals in [-1, 1] (others are an error) has at most 20001
    values, so the value counts hold all there is to know about a group of any
    size.  They go to blocks of replicates and ranges of draws; every draw is a
    hash of replicate and draw number, and the sums of the ranges are added
    up, so no task depends on the size of a group and every cut of the work
    gives the same interval.  ``method="multinomial"`` makes one multinomial
    draw per replicate instead: the same distribution, not the same draws, at a
    cost that does not grow with the group; groups of 2^32 rows or more need
    it.  Nulls are left out; a group without a score gives null.
    """
    if method not in ("draws", "multinomial"):
        raise ValueError(f"unknown method: {method}")
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("score"), exact_units(s).alias("u")) for s in scores])))
    group = [*keys, "score"]
    counts = long.where(F.col("u").isNotNull()).groupBy(*group, "u").agg(F.count("*").alias("c"))
    means = _resampled_means(counts, group, n_bootstrap, seed, method)
    low, high = (1 - ci) / 2, (1 + ci) / 2
    bounds = means.groupBy(*group).agg(  # n_bootstrap values per group
        r4(F.percentile("mean", F.lit(low))).alias("lower"), r4(F.percentile("mean", F.lit(high))).alias("upper"))
    return bounds.groupBy(*keys).agg(*[
        F.max(F.when(F.col("score") == s, F.col(side))).alias(f"{s}_ci_{side}")
        for s in scores for side in ("lower", "upper")
    ])


def _resampled_means(counts: DataFrame, group: list[str], n_bootstrap: int, seed: int, method: str, block: int = 50) -> DataFrame:
    packed = counts.groupBy(*group).agg(  # at most 20001 values
        F.array_sort(F.collect_list(F.struct("u", "c"))).alias("v"), F.sum("c").alias("n"))
    if method == "draws":
        fits = F.when(F.col("n") < MAX_DRAW_SIZE, F.col("n")).otherwise(
            F.raise_error(F.lit("a group is too large for hash draws: use method='multinomial'")).cast("bigint"))
        packed = packed.withColumn("n", fits)
    ranges = F.floor((F.col("n") - 1) / DRAWS) if method == "draws" else F.lit(0).cast("bigint")
    blocks = packed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), ranges))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit((n_bootstrap - 1) // block)))).select(
        *group, F.col("v.u").alias("u"), F.col("v.c").alias("c"), "n", "k", "b")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units, times, n, k, b = (batch.column(c)[i].as_py() for c in ("u", "c", "n", "k", "b"))
                units, times = np.array(units, "int64"), np.array(times, "int64")
                replicates = np.arange(b * block, min((b + 1) * block, n_bootstrap))
                if method == "draws":
                    drawn_units, end = DrawnUnits(units, np.cumsum(times)), min(n, (k + 1) * DRAWS)
                    sums = np.array([
                        sum(drawn_units.sum(draw_positions(seed, r, n, at, min(end, at + CACHED))[0]) for at in range(k * DRAWS, end, CACHED))
                        for r in replicates[:, None]], "int64")
                else:
                    rng = np.random.default_rng([seed, b])
                    sums = rng.multinomial(n, times / n, size=len(replicates)) @ units
                same = pa.array(np.full(len(replicates), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(g).take(same) for g in group), pa.array(replicates, pa.int32()), pa.array(sums, pa.int64()), batch.column("n").take(same)],
                    names=[*group, "r", "s", "n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*group).schema.fields)
    # a fixed number of tasks: the rows are few, the work on them is not
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = blocks.repartition(tasks, *group, "b", "k").mapInArrow(draw, f"{kinds}, r int, s bigint, n bigint")
    return drawn.groupBy(*group, "r").agg((F.sum("s") / F.max("n") / 10000).alias("mean"))


# ---- rows and scorecard -------------------------------------------------

PARTS = ("name", "ingredients", "instructions")


def _row_measures(stem: bool, with_parts: bool, order: int):
    """What ``score_rows`` needs of each pair: section parse of both sides,
    sizes of the item sets, subsequence and gram counts, in one pass."""
    def measures(batches: TextBatches) -> Iterator[pd.DataFrame]:
        def bodies(generated: str, reference: str) -> tuple[str, str]:
            """Adds what the sections give; both bodies."""
            (g_name, g_lines, g_body), (r_name, r_lines, r_body) = sections(generated), sections(reference)
            g_items, r_items = normal_items(g_lines), normal_items(r_lines)
            parts = (r_name, split_items(r_lines), r_body, g_name, split_items(g_lines), g_body) if with_parts else (r_name, g_name)
            rows.append((*parts, len(g_items & r_items), len(g_items), len(r_items)))
            return g_body, r_body

        def tokens(pairs: Iterable[tuple[str, str]]) -> Iterator[list[np.ndarray]]:
            for lengths, both in worker_words(stem).pairs(pairs):
                words.append(lengths)
                yield both

        for generated, reference in batches:  # items of one pair, tokens of a block of pairs at a time
            rows, words = [], []
            grams = _grams(tokens(map(bodies, generated, reference)), order)
            yield pd.concat([pd.DataFrame([(*r, *w) for r, w in zip(rows, words)], columns=names), grams], axis=1)

    sides = [f"{side}_{part}" for side in ("ref", "gen") for part in (PARTS if with_parts else PARTS[:1])]
    names = [*sides, "both", "n_g", "n_r", "lcs", "n_gen", "n_ref"]
    kinds = [f"{c} {'array<string>' if c.endswith('ingredients') else 'string'}" for c in sides]
    kinds += [f"{c} bigint" for c in [*names[len(sides):], *_gram_names(order)]]
    return F.pandas_udf(measures, ", ".join(kinds)), sides


def score_rows(df: DataFrame, generated: str = "generated_text", reference: str = "reference_text",
               stem: bool = True, with_counts: bool = False, with_parts: bool = True) -> DataFrame:
    """Parses both texts and adds the five row scores, all without a shuffle.

    A row without a text keeps empty fields and zero scores.  ``with_counts``
    keeps the gram counts for a later corpus score.  Without ``with_parts`` the
    titles and scores are added, not the item lists and bodies they are of.

    The same as ``parse_sections`` of either text, ``item_scores``, ``rouge_l``
    and ``ngram_matches`` one after the other; in one pass over the texts they
    take a third of the time, as no list of items is built in the JVM.
    """
    stale = [f"{side}_{f}" for side in ("ref", "gen") for f in PARTS] + SCORES
    empty, order = F.lit(""), 4
    measures, parts = _row_measures(stem, with_parts, order)
    rows = text_batches(df.drop(*stale)).withColumn("_m", measures(F.coalesce(F.col(generated), empty), F.coalesce(F.col(reference), empty)))
    kept = [c for c in df.columns if c not in stale]
    rows = rows.select(*kept, *[F.col(f"_m.{c}") for c in parts], F.col("_m.both").alias("_both"), "_m")
    rows = _prf(rows, F.col("_m.n_g"), F.col("_m.n_r"), "ingredient_").withColumn("rouge_l", _rouge(F.col("_m")))
    scored = [*kept, *parts, *[f"ingredient_{s}" for s in ("precision", "recall", "f1")], "rouge_l"]
    rows = rows.select(*scored, *[F.col(f"_m.{c}") for c in _gram_names(order)])
    counted = sentence_bleu(rows.withColumns(_candidates(F.col("gen_len"), order)))
    return counted if with_counts else counted.select(*scored, "bleu_sentence")


def scorecard(rows: DataFrame, model: str = "model_id", embedding: DataFrame | None = None,
              n_bootstrap: int = 1000) -> DataFrame:
    """One row per model: means, intervals and corpus BLEU of scored rows.

    Several branches read the rows, so give it rows that are stored.
    ``embedding`` holds the model, bertscore_f1, bertscore_precision and
    bertscore_recall of each pair; without it those columns are null.
    """
    counts = rows if "m1" in rows.columns else ngram_matches(rows, "gen_instructions", "ref_instructions")
    parts = ["ingredient_f1", "rouge_l"]
    card = score_means(rows, [model], parts)
    card = card.join(bootstrap_ci(rows, [model], parts, n_bootstrap), model, "left")
    card = card.join(corpus_bleu(counts, [model]).drop("n_samples"), model, "left")
    names = ["bertscore_mean_f1", "bertscore_mean_precision", "bertscore_mean_recall",
             "bertscore_ci_lower", "bertscore_ci_upper"]
    if embedding is None:
        card = card.withColumns({n: F.lit(None).cast("double") for n in names})
    else:
        embedding = embedding.withColumns({f"bertscore_{m}": r4(F.col(f"bertscore_{m}")) for m in ("f1", "precision", "recall")})
        means = score_means(embedding, [model], [f"bertscore_{m}" for m in ("f1", "precision", "recall")]).select(
            model, *[F.col(f"bertscore_{m}_mean").alias(f"bertscore_mean_{m}") for m in ("f1", "precision", "recall")])
        ci = bootstrap_ci(embedding, [model], ["bertscore_f1"], n_bootstrap).withColumnsRenamed(
            {"bertscore_f1_ci_lower": names[3], "bertscore_f1_ci_upper": names[4]})
        card = card.join(means, model, "left").join(ci, model, "left")
    return card.select(
        model, "n_samples", "ingredient_f1_mean", "ingredient_f1_ci_lower", "ingredient_f1_ci_upper",
        "rouge_l_mean", "rouge_l_ci_lower", "rouge_l_ci_upper", "bleu_corpus", *names)


def score_with(df: DataFrame, scorer: Callable[[dict], dict], schema: str, defaults: dict) -> DataFrame:
    """Runs a caller's scorer or generator on every row: it takes the row as a
    dict and returns the new columns.  A row on which it raises gets the
    defaults; ``error`` says what went wrong and is null otherwise."""
    added = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(added)
    out = T.StructType([*df.schema.fields, *added.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for row in batch.to_pylist():
                try:
                    rows.append(pa.RecordBatch.from_pylist([{**defaults, **scorer(row)}], schema=kinds).to_pylist()[0])
                    errors.append(None)
                except Exception as e:  # whatever a caller's code raises ends this row only
                    rows.append(defaults)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            made = pa.RecordBatch.from_pylist(rows, schema=kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made.columns, pa.array(errors, pa.string())], names=[*batch.schema.names, *kinds.names, "error"])

    return df.mapInArrow(run, out)


def score_batches(df: DataFrame, scorer: Callable[[list[dict]], list[dict]], schema: str, defaults: dict, batch_rows: int = 256) -> DataFrame:
    """The same for a scorer or generator that takes many rows at a time, as
    models do: a list of rows in, a list of dicts of the new columns out, in
    order and one each.

    A batch on which it raises, or whose answers do not fit, is halved until
    the rows that it fails on stand alone: those get the defaults and the
    error.  One bad row in ``batch_rows`` costs about 2 log2(batch_rows) more
    calls.  So the scorer must give a row the same answer in any company.
    """
    if batch_rows < 1:
        raise ValueError("a batch has at least one row")
    added = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(added)
    out = T.StructType([*df.schema.fields, *added.fields, T.StructField("error", T.StringType())])

    def scored(rows: list[dict]) -> list[tuple[pa.RecordBatch, list[str | None]]]:
        """Pieces of the answer, left to right; no recursion deeper than log2 of a batch."""
        try:
            answers = list(scorer(rows))
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} answers to {len(rows)} rows")
            return [(pa.RecordBatch.from_pylist([{**defaults, **a} for a in answers], schema=kinds), [None] * len(rows))]
        except Exception as e:  # whatever a caller's code raises ends the rows it cannot do
            if len(rows) > 1:
                half = len(rows) // 2
                return scored(rows[:half]) + scored(rows[half:])
            return [(pa.RecordBatch.from_pylist([defaults], schema=kinds), [f"{type(e).__name__}: {e}"[:200]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                pieces = scored(part.to_pylist())
                made = pa.Table.from_batches([p for p, _ in pieces], kinds).combine_chunks().to_batches()[0]
                errors = pa.array([e for _, es in pieces for e in es], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *made.columns, errors], names=[*part.schema.names, *kinds.names, "error"])

    return df.mapInArrow(run, out)


def line_bleu(df: DataFrame, generated: str, reference: str, name: str = "bleu") -> DataFrame:
    """Sentence BLEU of two lists of lines, each list scored as one text."""
    joined = df.withColumns({"_g": F.array_join(generated, " "), "_r": F.array_join(reference, " ")})
    scored = sentence_bleu(ngram_matches(joined, "_g", "_r"))
    return scored.select(*df.columns, F.col("bleu_sentence").alias(name))


def prompt_means(df: DataFrame, prompt: str, scores: list[str]) -> DataFrame:
    """Average of each score per prompt template; undefined scores are left
    out.  Scores have four decimals, so their sums are whole numbers."""
    return df.groupBy(prompt).agg(F.count("*").alias("n_rows"), *[
        r4(F.try_divide(F.sum(score_units(s)), F.count(s)) / 10000).alias(f"avg_{s}") for s in scores])
