"""Scores against brute force on small inputs."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textjobs.functions.stem import clipped_matches, lcs_length, porter_stem
from textjobs.operators import score


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"),
    ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"),
    ("hopefulness", "hope"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"),
    ("probate", "probat"), ("controll", "control"), ("dying", "die"), ("cooking", "cook"), ("cooked", "cook"),
])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert lcs_length(a, b) == brute_lcs(a, b)


def test_clipped_matches():
    assert clipped_matches("a a a b".split(), "a a c".split(), 1) == 2
    assert clipped_matches("a b a b".split(), "a b a b".split(), 2) == 3
    assert clipped_matches(["a"], ["a"], 2) == 0


def pairs(spark, rows):
    return spark.createDataFrame([(i, g, r) for i, (g, r) in enumerate(rows)], "id int, g string, r string")


def test_rouge_l(spark):
    df = pairs(spark, [("the cat sat", "the cat sat"), ("Cooking rice!", "cooked, rice"), ("", "a"), (None, "a"), ("a b c d", "a x c y")])
    got = [r["rouge_l"] for r in score.rouge_l(df, "g", "r").orderBy("id").collect()]
    assert got == [1.0, 1.0, 0.0, 0.0, 0.5]
    plain = [r["rouge_l"] for r in score.rouge_l(df, "g", "r", stem=False).orderBy("id").collect()]
    assert plain[1] == 0.5


def brute_bleu(rows, smooth):
    m, t, gl, rl = [0] * 4, [0] * 4, 0, 0
    for g, r in rows:
        g, r = (g or "").split(), (r or "").split()
        gl, rl = gl + len(g), rl + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (g, r))
            m[n - 1] += sum(min(c, b[k]) for k, c in a.items())
            t[n - 1] += max(1, sum(a.values()))
    if m[0] == 0 or gl == 0 or (smooth and rl == 0):
        return 0.0
    zero = 0.1 if smooth else None
    logs = [math.log((x or zero) / y) if (x or zero) else math.log(np.finfo(float).tiny) for x, y in zip(m, t)]
    bp = 1.0 if gl > rl else math.exp(1 - rl / gl)
    return round(bp * math.exp(sum(logs) / 4), 4)


def random_rows(n, seed):
    rng = random.Random(seed)
    return [tuple(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(n)]


def test_bleu_against_brute_force(spark):
    rows = random_rows(60, 3) + [(None, "a b"), ("a b c d", "a b c d"), ("a b c", "a b c"), ("", "")]
    counts = score.ngram_matches(pairs(spark, rows), "g", "r")
    got = [r["bleu_sentence"] for r in score.sentence_bleu(counts).orderBy("id").collect()]
    assert got == pytest.approx([brute_bleu([p], True) for p in rows], abs=1e-9)
    assert got[61] == 1.0
    corpus = score.corpus_bleu(counts.withColumn("model", F.lit("m")), ["model"]).first()
    assert corpus["bleu_corpus"] == pytest.approx(brute_bleu(rows, False), abs=1e-9)


def test_item_scores(spark):
    df = spark.createDataFrame([
        (0, ["1 cup rice", "oil", "Oil"], ["rice", "2 tbsp oil", "salt"]), (1, [], ["a"]), (2, ["1"], ["a"]), (3, None, None),
    ], "id int, g array<string>, r array<string>")
    got = {r["id"]: r for r in score.item_scores(df, "g", "r").collect()}
    assert (got[0]["ingredient_precision"], got[0]["ingredient_recall"], got[0]["ingredient_f1"]) == (1.0, 0.6667, 0.8)
    assert all(got[i]["ingredient_f1"] == 0.0 for i in (1, 2, 3))


def test_item_tables_equal_item_lists(spark):
    rng = random.Random(5)
    lists = [(i, [rng.choice("abcdef") for _ in range(rng.randint(1, 6))], [rng.choice("abcdef") for _ in range(rng.randint(1, 6))])
             for i in range(40)]
    df = spark.createDataFrame(lists, "id int, g array<string>, r array<string>")
    by_list = {r["id"]: r["ingredient_f1"] for r in score.item_scores(df, "g", "r").collect()}
    rows = df.select("id", F.explode("g").alias("item"), F.lit(True).alias("gen")).union(
        df.select("id", F.explode("r").alias("item"), F.lit(False).alias("gen")))
    by_row = {r["id"]: r["f1"] for r in score.item_table_scores(rows, ["id"], "item", "gen").collect()}
    assert by_row == by_list


def test_legacy_scores_count_repeats(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"])], "g array<string>, r array<string>")
    first, second = score.legacy_scores(df, "g", "r").collect()
    assert (first["precision"], first["recall"]) == (0.3333, 0.5)
    assert second["precision"] is None and second["recall"] == 0.0


def test_greedy_match(spark):
    rng = np.random.default_rng(0)
    g, r = rng.normal(size=(700, 8)), rng.normal(size=(5, 8))
    df = spark.createDataFrame([(g.tolist(), r.tolist()), ([], r.tolist())], "g array<array<double>>, r array<array<double>>")
    got = score.greedy_match(df, "g", "r", "").collect()
    cos = (g / np.linalg.norm(g, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    p, q = cos.max(axis=1).mean(), cos.max(axis=0).mean()
    assert (got[0]["precision"], got[0]["recall"], got[0]["f1"]) == pytest.approx((p, q, 2 * p * q / (p + q)))
    assert got[1]["f1"] == 0.0 and got[1]["error"] is None
    odd = spark.createDataFrame([([[1.0, 2.0]], [[1.0]]), ([[1.0]], [[2.0]])], "g array<array<double>>, r array<array<double>>")
    bad, good = score.greedy_match(odd, "g", "r", "").collect()
    assert bad["f1"] == 0.0 and bad["error"] and good["f1"] == 1.0 and good["error"] is None


def test_too_many_vectors_are_an_error(spark):
    v = spark.createDataFrame([(1, i, [1.0]) for i in range(4)], "t int, p int, v array<double>")
    assert len(score.gather_vectors(v, "t", "p", "v", 4).first()["vectors"]) == 4
    with pytest.raises(Exception, match="more than 3"):
        score.gather_vectors(v, "t", "p", "v", 3).collect()


def test_one_interval_however_the_rows_lie(spark, monkeypatch):
    values = np.round(np.random.default_rng(7).beta(2, 5, size=3000), 4).tolist()
    df = spark.createDataFrame([("m", v) for v in values], "model string, s double")
    whole = score.bootstrap_ci(df.coalesce(1), ["model"], ["s"], 200).collect()
    monkeypatch.setattr(score, "DRAWS", 700)
    assert score.bootstrap_ci(df.repartition(7), ["model"], ["s"], 200).collect() == whole
    for wrong in (1e-5, 1.5):
        with pytest.raises(Exception, match="four decimals"):
            score.bootstrap_ci(spark.createDataFrame([("m", wrong)], "model string, s double"), ["model"], ["s"], 10).collect()


def test_a_row_that_raises_gets_defaults(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, t string")
    got = score.score_with(df, lambda row: {"n": int(row["t"])}, "n bigint", {"n": -1}).collect()
    assert [(r["n"], r["error"] is None) for r in got] == [(4, True), (-1, False), (-1, False)]


def test_bootstrap_paths_agree(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.beta(2, 5, size=400), 4)
    df = spark.createDataFrame([("m", float(v), 0.25) for v in values] + [("one", 0.5, None)], "model string, s double, c double")
    drawn = {r["model"]: r for r in score.bootstrap_ci(df, ["model"], ["s", "c"]).collect()}
    counted = {r["model"]: r for r in score.bootstrap_ci(df, ["model"], ["s", "c"], method="multinomial").collect()}
    error = values.std() / np.sqrt(len(values))
    for got in (drawn["m"], counted["m"]):
        assert got["s_ci_lower"] == pytest.approx(values.mean() - 1.96 * error, abs=0.004)
        assert got["s_ci_upper"] == pytest.approx(values.mean() + 1.96 * error, abs=0.004)
        assert (got["c_ci_lower"], got["c_ci_upper"]) == (0.25, 0.25)
    assert (drawn["one"]["s_ci_lower"], drawn["one"]["c_ci_lower"]) == (0.5, None)


def test_score_means_round_half_to_even(spark):
    df = spark.createDataFrame([("m", 0.0312), ("m", 0.0313), ("n", None)], "model string, s double")
    got = {r["model"]: r["s_mean"] for r in score.score_means(df, ["model"], ["s"]).collect()}
    assert got == {"m": 0.0312, "n": None}


def test_scored_rows_and_card(spark):
    text = "**Rice**\n\n**Ingredients:**\n1 cup rice, salt\n\n**Instructions:**\nWash the rice and cook it."
    df = spark.createDataFrame([(1, "a", text, text), (2, "a", None, text), (3, "b", "junk", text)],
                               "row_index int, model_id string, generated_text string, reference_text string")
    rows = score.score_rows(df).cache()
    got = {r["row_index"]: r for r in rows.collect()}
    assert all(got[1][s] == 1.0 for s in score.SCORES)
    assert all(got[2][s] == 0.0 for s in score.SCORES) and got[2]["gen_ingredients"] == []
    card = {r["model_id"]: r for r in score.scorecard(rows, n_bootstrap=50).collect()}
    assert (card["a"]["n_samples"], card["a"]["rouge_l_mean"], card["b"]["rouge_l_mean"]) == (2, 0.5, 0.0)
    assert card["a"]["bertscore_mean_f1"] is None and card["b"]["bleu_corpus"] == 0.0


def test_row_scores_need_no_shuffle(spark):
    df = spark.createDataFrame([("a", "b")], "generated_text string, reference_text string")
    plan = score.score_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_failing_batch_is_halved_down_to_its_bad_rows(spark, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(rows):
        with open(log, "a") as f:
            f.write("x")
        if any(r["t"] == "bad" for r in rows):
            raise KeyError("bad row")
        return [{"n": "many" if r["t"] == "odd" else len(r["t"])} for r in rows]

    texts = ["a" * (i % 5) for i in range(1000)]
    texts[137], texts[700] = "bad", "odd"
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: r for r in score.score_batches(df, scorer, "n int", {"n": -1}, 1000).collect()}
    assert [got[i]["n"] for i in range(1000)] == [-1 if i in (137, 700) else len(t) for i, t in enumerate(texts)]
    assert [i for i in got if got[i]["error"]] == [137, 700] and "bad row" in got[137]["error"]
    assert len(open(log).read()) < 50
    short = score.score_batches(df, lambda rows: [{"n": 1}], "n int", {"n": -1}).where("error IS NOT NULL").count()
    assert short == 0  # alone, every row has its one answer
    assert score.score_batches(df.where("i < 0"), scorer, "n int", {"n": -1}).count() == 0


def test_subsequences_and_grams_over_blocks(monkeypatch):
    """Blocks of positions and slices of pairs give what whole lists give, in bounded memory."""
    import random
    import tracemalloc
    from collections import Counter

    from textjobs.functions import stem

    rng = random.Random(3)
    pairs = [(rng.choices("abcdefg", k=rng.randrange(30)), rng.choices("abcdxy", k=rng.randrange(30))) for _ in range(200)]

    def brute(a, b, n):
        g, r = (Counter(zip(*[x[i:] for i in range(n)])) for x in (a, b))
        return sum((g & r).values())

    monkeypatch.setattr(stem, "LCS_BLOCK", 5)
    monkeypatch.setattr(stem, "GRAM_TOKENS", 50)
    assert [lcs_length(a, b) for a, b in pairs] == [brute_lcs(a, b) for a, b in pairs]
    for order in (1, 2, 3, 4, 6):
        got = [row for block in stem.gram_matches(iter(pairs), order) for row in block.tolist()]
        assert got == [[len(a), len(b), *[brute(a, b, n) for n in range(1, order + 1)]] for a, b in pairs]
    monkeypatch.undo()
    words = [str(i) for i in range(40000)]
    tracemalloc.start()
    assert lcs_length(words, words[:300]) == 300 and lcs_length(words[:12000], words[11500:]) == 500
    assert lcs_length(["x", *words[:20000]], words[:20000]) == 20000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # a mask of every word over the whole list took the square: 27 MB here, 100 times that ten times as long


def test_text_batches_are_small_unless_set(spark):
    from textjobs.operators.score import TEXT_BATCH, ngram_matches
    before = {k: spark.conf.get(k) for k in TEXT_BATCH}
    try:
        for k, (default, _) in TEXT_BATCH.items():
            spark.conf.set(k, default)
        rows = spark.createDataFrame([("a b", "a b")], "g string, r string")
        ngram_matches(rows, "g", "r")
        assert all(spark.conf.get(k) == wanted for k, (_, wanted) in TEXT_BATCH.items())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
        ngram_matches(rows, "g", "r")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_draws_without_divisions_are_the_same():
    from textjobs.functions.hashing import PRIME, DrawnUnits, draw_positions

    def plain(seed, r, n, j):
        x = (r * 1000003 + j * 7919 + seed * 104729) % PRIME
        for added in (12345, j * 31 + 67890, 0):
            fine, x = x, (pow(x, 5, PRIME) + added) % PRIME
        return (x * n + fine * n // PRIME) // PRIME

    for seed, n, low in ((42, 1000, 0), (-3, 2**32 - 1, 2**32 - 300), (7, 1, 0)):
        got = draw_positions(seed, np.array([0, 999]), n, low, low + 200)
        assert got.tolist() == [[plain(seed, r, n, j) for j in range(low, low + 200)] for r in (0, 999)]
    rng = np.random.default_rng(5)
    for n_values, most in ((1, 9), (3, 10**6), (20001, 40)):
        units = np.sort(rng.choice(20001, n_values, replace=False) - 10000)
        ends = np.cumsum(rng.integers(1, most + 1, n_values))
        positions = rng.integers(0, ends[-1], 5000)
        assert DrawnUnits(units, ends).sum(positions) == units[np.searchsorted(ends, positions, side="right")].sum()
