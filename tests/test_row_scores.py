"""Row scores in one pass: against the operators they stand for, and what the scorecard over documents stores."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textjobs.functions import sections, stem
from textjobs.functions.text import wstrip, wstrip_long
from textjobs.operators import parse, score
from textjobs.plans import inputs, scores

BITS = [
    "**", "***", "****", "*", "**Ingredients:**", "**ingredient**", "** Instructions", "**Instructions:**", "### Ingredients", "Ingredients",
    "INGREDIENTS:", "Instruction:\n", "ingredients: \n", "İngredients", "\n", "\n", "\n", " ", "\t", "　", "\x1c", "\x85", " ", "\r\n",
    "- 2 cups rice", "* oil", "• salt", "-", "- ", "a, b,, c", ",", "1 tbsp sugar, 2 tbsp Sugar", "1½ cups flour", "3/4 l milk", "cup", "١ cup x",
    "**Rice**", "**a** b", "_ingredients_", "*instructions*", "Cooking RICE wells", "Straße", "Kelvin", "İa", "relational conditional", "ß,ſ",
    "- - dash", "2 cloves", "2 clovess garlic", "10g butter", "#", "_",
]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return [None if rng.random() < 0.03 else "".join(rng.choice(BITS) + rng.choice(["", "\n", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def rows_of(spark, n=600):
    texts = odd_texts(2 * n, 11)
    return spark.createDataFrame([(i, texts[i], texts[n + i]) for i in range(n)], "i int, generated_text string, reference_text string")


@pytest.mark.parametrize("stemmed, kept", [(True, 100_000), (False, 100_000), (True, 5)])
def test_one_pass_equals_the_operators(spark, monkeypatch, stemmed, kept):
    monkeypatch.setattr(sections, "KEPT", kept)
    for name in ("KEPT_WORDS", "BLOCK", "GRAM_TOKENS"):
        monkeypatch.setattr(stem, name, kept)
    df = rows_of(spark)
    apart = parse.parse_sections(parse.parse_sections(df, "reference_text", "ref_"), "generated_text", "gen_")
    apart = score.rouge_l(score.item_scores(apart, "gen_ingredients", "ref_ingredients"), "gen_instructions", "ref_instructions", stemmed)
    apart = score.sentence_bleu(score.ngram_matches(apart, "gen_instructions", "ref_instructions")).orderBy("i")
    whole = score.score_rows(df, stem=stemmed, with_counts=True).orderBy("i")
    assert whole.columns == apart.columns
    assert whole.collect() == apart.collect()
    short = score.score_rows(df, stem=stemmed, with_counts=True, with_parts=False).orderBy("i")
    left = [c for c in whole.columns if not c.endswith(("_ingredients", "_instructions"))]
    assert short.columns == left and short.collect() == whole.select(left).collect()


def test_strips_of_long_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*odd_texts(400, 3), "", " ", "　a", "a\x1f", "a", "﻿a"]], "t string")
    assert df.where(~wstrip("t").eqNullSafe(wstrip_long("t"))).count() == 0


def test_words_are_the_stemmed_runs_of_letters(monkeypatch):
    texts = [t or "" for t in odd_texts(200, 5)]
    pairs = list(zip(texts, texts[1:]))
    for block, kept in ((1 << 20, 10**6), (50, 3)):
        monkeypatch.setattr(stem, "BLOCK", block)
        monkeypatch.setattr(stem, "KEPT_WORDS", kept)
        got = list(stem.Words(stem=True).pairs(iter(pairs)))
        assert len(got) == len(pairs)
        for (lengths, tokens), pair in zip(got, pairs):
            wanted = [[stem.porter_stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", t.lower())] for t in pair]
            assert lengths == (stem.lcs_length(*wanted), len(wanted[0]), len(wanted[1]))
            number = dict(zip(sum((t.split() for t in pair), []), np.concatenate(tokens).tolist()))
            assert len(set(number.values())) == len(number)
            assert [t.tolist() for t in tokens] == [[number[w] for w in t.split()] for t in pair]
    assert list(stem.Words(stem=True).pairs(iter([]))) == []


def documents(spark, path):
    texts = odd_texts(60, 9)
    rows = [(None if i == 7 else i // 2 * 2 if i > 50 else i, t, ["en", "fr", "de", "es", None][i % 5], None if i == 9 else "src", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_documents_are_rendered_after_they_meet(spark, tmp_path):
    sf = documents(spark, tmp_path)
    recipes = inputs.doc_recipes(spark, sf)
    wanted = recipes.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("model_id"), F.col("recipe").alias("reference_text")).join(
        recipes.select((F.col("doc_id") - 1).alias("row_index"), F.col("recipe").alias("generated_text")), "row_index", "left")
    got = inputs.doc_eval(spark, sf)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Ingredients" in plan.split("Join")[0] and "Ingredients" not in plan.split("Join")[1]


def test_recipes_list_every_word(spark):
    df = spark.createDataFrame([(t,) for t in [*odd_texts(300, 4), "", " . , ", "a.b, c", "$1 \\1"]], "t string")
    one = inputs.recipe_text(F.lit("T"), F.col("t"), F.lit("bullet"))
    items = F.array_join(F.transform(inputs.words(F.col("t")), lambda w: F.concat(F.lit("- 2 cups "), w)), "\n")
    plain = F.concat(F.lit("**T**\n\n\n**Ingredients:**\n"), wstrip(items), F.lit("\n\n**Instructions:**\n"), wstrip("t"))
    assert df.where(~one.eqNullSafe(plain)).count() == 0


def test_stored_rows_of_the_document_scorecard_hold_no_texts(spark, tmp_path, monkeypatch):
    stored = []

    def save(df, purpose):
        stored.append(df)
        return df

    monkeypatch.setattr(scores, "save_and_reread", save)
    card = scores.scorecard_documents(spark, documents(spark, tmp_path))
    assert card.count() == 5
    assert set(score.SCORES) <= set(stored[0].columns) and {"ref_name", "gen_name", "m4", "t4", "row_index"} <= set(stored[0].columns)
    assert not [c for c, kind in stored[0].dtypes if "text" in c or "array" in kind or c.endswith("_instructions")]
