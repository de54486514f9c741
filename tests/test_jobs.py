"""Preparation, formatting, splits, logs, sessions, streams: small frames."""
import json

import time

import pytest
from pyspark.sql import Window, functions as F

from textjobs.functions.text import normalise_label, prefix_key, r4, wstrip
from textjobs.operators import compare, formatting, prep, profile, runlog, session, split
from textjobs.operators import ordered, quantiles
from textjobs.operators.quantiles import exact_quantiles, value_table
from textjobs.sources import files
from textjobs.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a ﻿",), ("\x1c b\n",), (None,)], "t string")
    got = [tuple(r) for r in df.select(wstrip("t"), normalise_label("t")).collect()]
    assert got == [("a ﻿", "a "), ("b", "b"), (None, None)]
    values = spark.createDataFrame([(0.03125,), (0.03135,)], "x double")
    assert values.select(r4(F.col("x"))).first()[0] == 0.0312


def test_prefix_key_orders(spark):
    text = "  " + "x" * 78 + " " + "y" * 10
    df = spark.createDataFrame([(text,), ("  short  ",), ("z" * 79 + "   ",)], "t string")
    got = [tuple(r) for r in df.select(prefix_key("t"), prefix_key("t", "cut_strip")).collect()]
    assert got[0] == ("x" * 78 + " y", "x" * 78)
    assert got[1] == ("short", "short")
    assert got[2] == ("z" * 79, "z" * 79)


def sources(spark):
    a = spark.createDataFrame([
        (1, "Dal", "x", "12x", "c", "same text", "u1"), (2, "", "x", "5", "c", None, "u2"), (3, "Dal", "x", "0", "c", " other ", "u3"),
        (4, "Dal", "x", "0", "c", "other", "u3"),
    ], "ord int, TranslatedRecipeName string, TranslatedIngredients string, TotalTimeInMins string, Cuisine string, "
       "TranslatedInstructions string, URL string")
    b = spark.createDataFrame([
        (1, "same text ", "Veg", "Lunch"), (2, "same text", "Late", "Late"), (3, None, "Null", "N"), (4, "new", "Veg", "D"),
    ], "ord int, TranslatedInstructions string, Diet string, Course string").withColumns({
        "PrepTimeInMins": F.lit("1"), "CookTimeInMins": F.lit("2"), "Servings": F.lit("3"), "Cuisine": F.lit("c"),
        "TranslatedIngredients": F.lit("i"), "TotalTimeInMins": F.lit("9")})
    return a, b


def test_merge_then_clean(spark):
    a, b = sources(spark)
    merged = prep.merge_sources(a, b)
    assert merged.count() == 5  # four of A, one that only B has
    got = {r["URL"]: r["Diet"] for r in merged.where("URL is not null").collect()}
    assert got == {"u1": "Veg", "u2": "Null", "u3": None}
    cleaned = prep.clean_dataset(prep.ingest_nulls(merged))
    assert cleaned.columns[0] == "TranslatedRecipeName" and len(cleaned.columns) == 8
    # "12x" and 0 become null; equal only after stripping: both stay
    assert sorted((r["TranslatedInstructions"], r["TotalTimeInMins"]) for r in cleaned.collect()) == [
        ("other", None), ("other", None), ("same text", None)]
    assert tuple(prep.join_audit(
        a.withColumn("k", prefix_key("TranslatedInstructions")), b.withColumn("k", prefix_key("TranslatedInstructions")),
        "k", "ord", "Diet").first()) == (4, 2, 2, 1)


def test_cleaning_drops_the_rows_only_b_has_from_the_plan(spark):
    a, b = sources(spark)
    plan = prep.clean_dataset(prep.merge_sources(a, b))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_key_overlap_counts_null_once(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert tuple(prep.key_overlap(a, b, "k").first()) == (2, 3, 2, 0, 1, 3)


def test_allowlist_and_audit(spark):
    df = spark.createDataFrame([("Goan Recipes﻿",), (" Andhra",), ("Thai",), (None,)], "label string")
    assert rows(prep.allowlist_filter(df, "label"), "label") == [("Andhra",), ("Goan Recipes",)]
    clean = df.withColumn("label", normalise_label("label"))
    assert tuple(profile.filter_audit(clean, "label", ["Andhra"]).first()) == (4, 1, 3, 25.0, 1, 2)


def test_profiles(spark):
    df = spark.createDataFrame([("a b", 1.0), ("a b", 1.0), (None, None), ("", 0.0)], "t string, v double")
    assert tuple(profile.duplicate_rows(df).first()) == (4, 3, 1)
    assert tuple(profile.duplicate_rows(df.where("v > 5")).first()) == (0, 0, 0)
    assert rows(profile.null_profile(df), "column_name")[0][:4] == ("t", 4, 2, 1)
    assert rows(profile.value_counts(df, "t"), "value") == [("", 1), ("a b", 2)]
    assert profile.value_counts(df, "t", keep_null=True).count() == 3
    assert tuple(profile.numeric_profile(df, "v", []).first()) == (3, 0.0, 1.0, 0.67, 1, 1.0)
    assert tuple(profile.required_fields_audit(df.withColumn("u", F.lit("x")), ["t", "u"]).first()) == (4, 2, 0, 2)


def test_exact_quantiles_against_percentile(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("k"), (F.pow(F.col("id") % 977, 2) + F.when(F.col("id") % 2 == 0, 0.5).otherwise(0)).alias("v"))
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect()}
    got = exact_quantiles(value_table(df, "v", ["k"]), probs, ["k"]).collect()
    assert len(got) == 15
    for r in got:
        assert r["quantile"] == pytest.approx(want[r["k"]][probs.index(r["p"])])


def test_exact_quantiles_cut_ranges_until_they_are_small(spark):
    """Null keys, ties and skew; no range over the bound is ordered."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit(7.0)).otherwise(F.exp(F.col("id") % 9973 / 500)).alias("v"))
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect()}
    for most in (5, 300):
        got = exact_quantiles(value_table(df, "v", ["k"]), probs, ["k"], parts=8, most=most)
        assert "Window" in got._jdf.queryExecution().toString()
        rows_ = got.collect()
        assert len(rows_) == 20
        for r in rows_:
            assert r["quantile"] == pytest.approx(want[r["k"]][probs.index(r["p"])])
    counted = value_table(df, "v", [])
    rows_, wanted = counted.withColumn("_range", F.lit("")), spark.range(1).select(
        F.lit("").alias("_range"), F.lit(0).cast("long").alias("_before"),
        F.array(F.struct(F.lit(0.5).alias("p"), F.lit(20_000).cast("long").alias("_rank"), F.lit(20_000.0).alias("_position"))).alias("_targets"))
    sizes = []
    for _ in range(4):
        rows_, wanted, largest = quantiles._refined(rows_, wanted, [], 8)
        sizes.append(largest)
        assert rows_.count() == largest and wanted.count() == 1
    assert sizes[0] < 9973 / 4 and sizes[-1] <= 5


def test_segments_are_cut_by_counts(spark):
    """One key with nearly all rows is spread, and carries over its cuts."""
    df = spark.range(20_000).select(
        F.when(F.col("id") < 50, F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 20_000).alias("t"),
        F.when(F.col("id") % 3000 == 1, F.col("id")).alias("v"))
    cut = ordered.segmented(df, ["k"], ["t"], 16)
    sizes = [r["count"] for r in cut.where("k IS NULL").groupBy("_segment").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 4000
    for current, frame in ((True, 0), (False, -1)):
        got = ordered.carry_forward(df, ["k"], None, ["t"], [F.col("v")], ["last"], include_current=current)
        want = df.withColumn("last", F.last("v", True).over(Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, frame)))
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 20_000
    newest = ordered.latest_per_key(df, ["k"], None, ["t"], 3, "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).where("rank <= 3")
    assert newest.exceptAll(want).count() == 0 and newest.count() == want.count()


def test_prepare_corpus_counts_on_the_way(spark, tmp_path):
    from textjobs.operators import corpus
    from textjobs.plans import QUERIES
    from unittest import mock

    audit = {}
    real = corpus.prepare_corpus
    with mock.patch.object(corpus, "prepare_corpus", lambda *a, **k: real(*a, **k, audit=audit)):
        out = QUERIES["prepare_corpus"](spark, "/root/testdata/sf0.001")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert {k: audit[k] for k in sizes} == sizes and audit["pairs_n"] == sum(sizes.values())
    assert audit["pairs_tagged"] == out.where("tagged").count() and audit["allowed_a"] > 0 and audit["pairs_unnamed"] == 0


def test_requests(spark):
    df = spark.createDataFrame([("Dal ", "Andhra", "Vegan", "Side Dish"), ("Dal", "Goan", None, " ")],
                               "n string, c string, d string, k string")
    got = [r[0] for r in df.select(formatting.request_text(F.col("n"), F.col("c"), F.col("d"), F.col("k"))).collect()]
    assert got == ["Generate a Vegan Andhra side dish recipe for Dal", "Generate a Goan recipe for Dal"]
    form = spark.createDataFrame([
        ("", [], "Any Diet", "Any Region", "1+ hours"), ("Dal", ["x"], "Any Diet", "Any Region", "Under 15 min"),
        (" ", ["x", "y"], "Vegan", "Andhra", "Under 15 min"),
    ], "n string, i array<string>, d string, r string, t string")
    got = [x[0] for x in form.select(formatting.form_request_text(*[F.col(c) for c in "nidrt"])).collect()]
    assert got == [
        "Generate a recipe ready in under 1+ hours minutes using these ingredients: paneer, spinach, tomato",
        "Generate an Indian recipe for Dal",
        "Generate a Vegan Andhra recipe ready in under 15 minutes using these ingredients: x, y"]


def test_chat_and_span(spark):
    df = spark.createDataFrame([("be kind", " hi ", " yo ")], "s string, u string, a string")
    chat = df.select(formatting.render_chat(formatting.messages("s", "u", "a")).alias("t"))
    text = chat.first()["t"]
    assert text.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\n"
                           "Today Date: 26 Jul 2024\n\nbe kind<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>")
    span = formatting.completion_span(chat, "t").first()
    assert text[span["target_start"]:] == "yo<|eot_id|>" and not span["skipped"]
    none = formatting.completion_span(spark.createDataFrame([("x",)], "t string"), "t").first()
    assert none["skipped"] and none["target_start"] is None


def test_conversation_fragments_hold_every_turn(spark):
    turns = [("long", i, ("system", "user", "assistant")[i % 3] if i else "system", f" text {i} ") for i in range(25)]
    turns += [("short", 5, "user", "u"), ("short", 9, None, "x"), ("short", 9, "assistant", None), ("short", 9, "assistant", None), (None, None, "user", "n")]
    df = spark.createDataFrame(turns, "c string, t int, role string, text string").repartition(3)
    parts = formatting.conversation_fragments(df, "c", ["t"], "role", "text", 4)
    rows = parts.where("c = 'long'").orderBy("fragment").collect()
    assert [(r["fragment"], r["first_message"], len(r["messages"])) for r in rows] == [(i, 4 * i, 4 if i < 6 else 1) for i in range(7)]
    assert [m["content"] for r in rows for m in r["messages"]] == [f" text {i} " for i in range(25)]
    whole = formatting.whole_conversations(parts, "c").withColumn("again", formatting.render_chat(F.col("messages"))).collect()
    assert {r["c"]: len(r["messages"]) for r in whole} == {"long": 25, "short": 4, None: 1}
    assert all(r["chat"] == r["again"] for r in whole)
    short = next(r for r in whole if r["c"] == "short")
    assert [tuple(m) for m in short["messages"]] == [("user", "u"), ("", "x"), ("assistant", ""), ("assistant", "")]
    assert formatting.conversation_fragments(df.limit(0), "c", ["t"], "role", "text").count() == 0


def test_turn_messages_keep_every_turn_in_its_context(spark):
    turns = [("a", 0, "system", "be kind"), ("a", 1, "user", "q1"), ("a", 2, "assistant", "r1"), ("a", 3, "assistant", "r2"),
             ("a", 4, "system", None), ("a", 5, "system", "be brief"), ("a", 6, "user", "q2"), ("b", 0, "assistant", "alone"),
             ("b", 1, None, "who"), ("b", 2, "assistant", None), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "c string, t int, role string, text string").withColumn("messages_of", F.lit(1)).repartition(3)
    rows = formatting.turn_messages(df, "c", ["t"], "role", "text").collect()
    got = {(r["c"], r["t"]): "; ".join(f"{m['role']}={m['content']}" for m in r["messages"]) for r in rows}
    assert got == {
        ("a", 0): "system=be kind", ("a", 1): "system=be kind; user=q1", ("a", 2): "system=be kind; user=q1; assistant=r1",
        ("a", 3): "system=be kind; assistant=r2", ("a", 4): "system=", ("a", 5): "system=be brief", ("a", 6): "system=be brief; user=q2",
        ("b", 0): "assistant=alone", ("b", 1): "=who", ("b", 2): "assistant=", (None, 0): "user=n"}
    assert {(r["c"], r["t"]): r["before"] for r in rows}[("a", 3)] == "r1"
    long = spark.range(3000).select(F.lit("k").alias("c"), "id", F.when(F.col("id") == 0, "system").otherwise("user").alias("role"), F.lit("x").alias("text"))
    assert formatting.turn_messages(long, "c", ["id"], "role", "text").where(F.size("messages") == 2).count() == 2999
    assert formatting.turn_messages(df.limit(0), "c", ["t"], "role", "text").count() == 0


def test_merge_and_clean_is_merge_then_clean(spark):
    a, b = sources(spark)
    a = a.unionByName(a).unionByName(spark.createDataFrame([(9, "Dal", "x", "0", "", "", "u9"), (10, "Dal", "x", "7", "", "same text", "u1")], a.schema))
    named = b.withColumn("TranslatedRecipeName", F.when(F.col("ord") > 2, "Own")).unionByName(
        b.withColumns({"TranslatedRecipeName": F.lit("Own"), "ord": F.lit(8)}))
    for left, right in ((a, b), (a, named), (a.limit(0), named), (a, named.limit(0)), (a.limit(0), b.limit(0))):
        plain = prep.clean_dataset(prep.ingest_nulls(prep.merge_sources(left, right)))
        late = prep.merge_and_clean(left, right)
        assert late.columns == plain.columns
        assert sorted(map(str, late.collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError, match="must be kept"):
        prep.merge_and_clean(a, b, text="URL")


def test_merge_and_clean_shuffles_texts_once(spark):
    def text_shuffles(df):
        """Shuffles of the text column under its name, and those of texts reduced by an aggregate."""
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        nodes = df._jdf.queryExecution().explainString(mode).split("\n\n")
        named = sum(n.split("\n", 1)[0].strip().endswith(") Exchange") and "TranslatedInstructions" in n for n in nodes)
        return named, sum("partial_first(TranslatedInstructions" in n for n in nodes)

    frames = [df.repartition(3).where("ord > 0") for df in sources(spark)]
    assert [text_shuffles(df) for df in frames] == [(1, 0), (1, 0)]  # the repartition of the frame itself
    path = files.shared_dir(spark, "sources")
    for df, n in zip(frames, "ab"):
        df.write.parquet(f"{path}/{n}")
    a, b = (spark.read.parquet(f"{path}/{n}") for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert text_shuffles(prep.merge_and_clean(a, b)) == (0, 1)
        assert sum(text_shuffles(prep.clean_dataset(prep.ingest_nulls(prep.merge_sources(a, b))))) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_of_one_key_are_counted_over_segments(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 2000).alias("o"))
    placed = ordered.row_places(df, ["k"], ["o"], "place")
    assert placed.where("place <> o").count() == 0
    assert ordered.segmented(df, ["k"], ["o"]).select("_segment").distinct().count() > 1


def test_round_trip_of_response_and_parse(spark):
    from textjobs.operators.parse import parse_sections
    df = spark.createDataFrame([("Dal", "1 cup dal, salt", "Boil.\nEat.")], "n string, i string, b string")
    text = df.select(formatting.response_text(F.col("n"), F.col("i"), F.col("b")).alias("t"))
    r = parse_sections(text, "t").first()
    assert (r["name"], r["ingredients"], r["instructions"]) == ("Dal", ["1 cup dal", "salt"], "Boil.\nEat.")


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = split.holdout_split(df, "k", 100, 50)
    first = {r["k"]: r["split"] for r in parts.collect()}
    assert {s: list(first.values()).count(s) for s in ("test", "val", "train")} == {"test": 100, "val": 50, "train": 850}
    again = {r["k"]: r["split"] for r in split.holdout_split(df.repartition(7), "k", 100, 50).collect()}
    assert again == first
    assert tuple(split.split_leakage(parts, F.col("k")).first()) == (1000, 0, 0, 0)
    leak = spark.createDataFrame([("x", "train"), ("x", "test"), (None, "val"), (None, "test")], "t string, split string")
    assert tuple(split.split_leakage(leak, F.col("t")).first()) == (2, 0, 1, 1)
    with pytest.raises(Exception, match="larger than the table"):
        split.holdout_split(df, "k", 990, 50).collect()
    twice = spark.createDataFrame([(i // 4, i) for i in range(1000)], "k int, i int")
    for ties, sizes in ((("i",), {"test": 101, "val": 50, "train": 849}), ((), None)):
        if sizes:
            got = split.holdout_split(twice, "k", 101, 50, ties=ties).groupBy("split").count().collect()
            assert {r["split"]: r["count"] for r in got} == sizes
            assert split.tail_holdout(twice, "k", 10, ties=ties).where("split = 'test'").count() == 10
        else:
            with pytest.raises(Exception, match="equal in k"):
                split.holdout_split(twice, "k", 101, 50).collect()
            with pytest.raises(Exception, match="equal in k"):
                split.tail_holdout(twice, "k", 10).collect()
    tail = {r["k"]: r["split"] for r in split.tail_holdout(df, "k", 10).collect()}
    assert [k for k, s in sorted(tail.items()) if s == "test"] == list(range(990, 1000))
    with pytest.raises(Exception, match="larger than the table"):
        split.tail_holdout(df, "k", 1001).collect()


def test_splits_never_rank_or_join_the_table(spark):
    plan = split.holdout_split(spark.range(10), "id", 2, 1)._jdf.queryExecution().sparkPlan().toString()
    top = "".join(line for line in plan.splitlines() if not line.lstrip().startswith(":"))
    assert "Join" not in top and "Window" not in top and "Exchange" not in top


def test_upsert_and_lift(spark):
    old = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 9.0)], "model_id string, x double, y double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "model_id string, x double")
    assert rows(compare.upsert(old, new, "model_id"), "model_id") == [("a", 1.0, 9.0), ("b", 3.0, None), ("c", 4.0, None)]
    # published figures: item F1, BLEU, embedding F1 of the baseline and the tuned model
    card = spark.createDataFrame([("base", 0.0308, 0.0195, 0.8455), ("tuned", 0.0992, 0.0262, 0.8514)],
                                 "model_id string, f1 double, bleu double, bert double")
    lift = {r["model_id"]: r for r in compare.model_lift(card, "model_id", "base", ["f1", "bleu", "bert"]).collect()}["tuned"]
    assert (lift["f1_ratio"], lift["bleu_pct"], lift["bert_pct"]) == (3.22, 34.4, 0.7)


def test_badges(spark):
    df = spark.createDataFrame([("Vegan",), ("Non Veg",), ("Jain",), (None,)], "d string")
    assert [r[0] for r in df.select(compare.badge(F.col("d"))).collect()] == [
        "badge-diet-vegan", "badge-diet-nonveg", "badge-diet-veg", "badge-diet-veg"]


def test_trainer_log(spark, tmp_path):
    log = {"best_metric": 1.0, "log_history": [
        {"step": 10, "epoch": 0.5, "loss": 2.0}, {"step": 20, "epoch": 1.0, "loss": 1.5}, {"step": 20, "epoch": 1.0, "eval_loss": 1.4},
        {"step": 30, "epoch": 1.5, "loss": 1.2}, {"step": 40, "epoch": 2.0, "eval_loss": 1.4}]}
    path = tmp_path / "state.json"
    path.write_text(json.dumps(log, indent=1))
    df = files.read_trainer_log(spark, str(path)).withColumns({"run": F.lit("r"), "bucket": F.floor(F.col("step") / 20)})
    train, evaluation = runlog.split_log(df)
    assert (train.count(), evaluation.count()) == (3, 2)
    gaps = runlog.asof_gap(df, ["run"], "bucket", ["step"], "loss", "eval_loss")
    assert [(r["step"], r["train_value"], r["train_position"], r["gap"]) for r in gaps.orderBy("step").collect()] == [
        (20, 1.5, 20, -0.1), (40, 1.2, 30, 0.2)]
    assert tuple(runlog.best_checkpoint(df, ["run"], "step", "eval_loss").first()) == ("r", 20, 1.4)


def test_history_across_buckets(spark):
    names = ["a", "a", "b", "b", "a", "c", "c", None, "c", "d", "d", "e", "a"]
    df = spark.createDataFrame([("s", i, i // 3, n) for i, n in enumerate(names)], "s string, t int, b int, name string")
    got = session.recent_history(df, ["s"], "b", ["t"], "name", 4)
    assert [(r["position"], r["t"], r["name"]) for r in got.orderBy("position").collect()] == [
        (1, 12, "a"), (2, 11, "e"), (3, 9, "d"), (4, 5, "c")]


def test_session_helpers(spark):
    df = spark.createDataFrame([(1, ["x", "y", "z"])], "id int, steps array<string>")
    assert rows(session.step_cursor(df, "steps", ["id"]), "step_idx") == [
        (1, 0, 3, "x", 33, 1, 0), (1, 1, 3, "y", 66, 2, 0), (1, 2, 3, "z", 100, 2, 1)]
    at = [df.select(session.step_at(F.col("steps"), F.lit(i))).first()[0] for i in (1, 5, -1)]
    assert at == ["y", "x", "x"]
    union = df.select(session.list_union(F.array(F.array(F.lit("b"), F.lit("a"))), F.lit("a, c ,, b"))).first()[0]
    assert union == ["b", "a", "c"]
    asked = spark.createDataFrame([(1, "a dal recipe"), (2, "Recipe for aunt's 2nd soup\n"), (3, "hello")], "id int, m string")
    got = session.keyword_lookup(asked, "m", [("dal", "D"), ("recipe", "R")], "<{d}>", "{d}", ["id"])
    assert [r["answer"] for r in got.orderBy("id").collect()] == ["D", "R", "<Indian Dish>"]
    got = session.keyword_lookup(asked, "m", [("dal", "D")], "<{d}>", "{d}", ["id"])
    assert [r["answer"] for r in got.orderBy("id").collect()] == ["D", "<Aunt'S 2Nd Soup>", "<Indian Dish>"]


def test_item_dictionary(spark):
    from textjobs.functions.fixed import CATEGORY_CLASSES, ITEM_CATEGORIES, SEED_SETS
    assert len(CATEGORY_CLASSES) == len(ITEM_CATEGORIES)
    dictionary = spark.createDataFrame(list(ITEM_CATEGORIES.items()), "category string, items array<string>")
    flat = session.category_flatten(dictionary, "category", "items")
    assert {r["item"] for r in flat.where("n_uses > 1").collect()} == {"Curry Leaves"}
    sets = spark.createDataFrame([(s,) for s in SEED_SETS], "items array<string>")
    missing = session.dictionary_audit(sets, F.col("items"), flat, "item")
    assert [tuple(r) for r in missing.collect()] == [("Saffron", 1)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb, c', "NA"), (2, "", "x")], "id int, t string, u string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), "id INT, t STRING, u STRING", null_literals=["NA"])
    assert rows(back, "id") == [(1, 'a "q"\nb, c', None), (2, None, "x")]
    kv = spark.createDataFrame([(1, "x ### A: 1 ###B:2:3### A : 4 ### none")], "id int, t string")
    assert tuple(files.parse_key_values(kv, "t", ["A", "B", "C"], ["id"]).first()) == (1, "4", "2:3", None)
    assert rows(files.key_inventory(kv, "t"), "key") == [("A", 2, 1), ("B", 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    chunks = [(1, 0, "He"), (1, 2, "o"), (2, 0, "Hi"), (1, 1, "ll")]
    for i, c in enumerate(chunks):
        spark.createDataFrame([c], "gen_id long, seq int, chunk string").withColumn(
            "started_at", F.timestamp_seconds(F.lit(1000))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = jobs.whole_texts(spark.read.parquet(str(tmp_path / "in")))
    assert rows(batch, "gen_id") == [(1, 3, "Hello"), (2, 1, "Hi")]
    stream = jobs.accumulate(jobs.read_stream(spark, str(tmp_path / "in"), jobs.CHUNK_SCHEMA))
    grown = jobs.run_to_table(stream, "t", "update")
    final = grown.groupBy("gen_id").agg(F.max("n_chunks").alias("n"), F.max_by("text", "n_chunks").alias("text"))
    assert rows(final, "gen_id") == [(1, 3, "Hello"), (2, 1, "Hi")] and {r["status"] for r in grown.collect()} == {"open"}
    # every text on the way is a beginning of the final one
    last = {r["gen_id"]: r["text"] for r in final.collect()}
    assert all(last[r["gen_id"]].startswith(r["text"]) for r in grown.collect())


def test_no_chunk_is_lost(spark, tmp_path):
    """Generations that began days apart, a run in between, a missing chunk."""
    def put(*chunks):
        spark.createDataFrame([(g, s, c) for g, s, c, _ in chunks], "gen_id long, seq int, chunk string").withColumn(
            "started_at", F.timestamp_seconds(F.lit(86400) * F.col("gen_id"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(idle="1 hour"):
        stream = jobs.accumulate(jobs.read_stream(spark, str(tmp_path / "in"), jobs.CHUNK_SCHEMA), idle)
        return jobs.run_to_table(stream, "t", "update", root=str(tmp_path / "out"))

    put((1, 0, "He", 0), (1, 1, "l", 0))
    put((90, 0, "later", 0), (2, 1, "b", 0))
    run()
    put((1, 2, "lo", 0), (1, 2, "lo", 0))
    last = run().groupBy("gen_id").agg(F.max_by("text", "n_chunks").alias("text"))
    assert rows(last, "gen_id") == [(1, "Hello"), (2, ""), (90, "later")]
    put((5, 0, "x", 0))
    run("1 second")
    time.sleep(2)
    put((6, 0, "y", 0))
    ended = {(r["gen_id"], r["n_chunks"], r["text"], r["status"]) for r in run("1 second").collect() if r["status"] != "open"}
    assert (5, 1, "x", "ended") in ended


def test_a_run_without_new_files(spark, tmp_path):
    schema = "s string, t int, b int, name string, steps array<string>"

    def run():
        stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
        return [r["name"] for r in jobs.stream_history(
            stream, ["s"], "b", ["t"], "name", 3, root=str(tmp_path / "out"), steps="steps").orderBy("position").collect()]

    (tmp_path / "in").mkdir()
    assert run() == []
    spark.createDataFrame([("s", 1, 0, "a", ["x"]), ("s", 2, 0, "b", []), ("s", 3, 0, "c", ["y"])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == ["c", "a"] and run() == ["c", "a"]


def test_history_goes_on_after_a_restart(spark, tmp_path):
    names = ["a", "b", "b", "c", "c", "d"]
    rows_in = [("s", i, i // 2, n) for i, n in enumerate(names)]
    schema = "s string, t int, b int, name string"

    def run():
        stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
        return jobs.stream_history(stream, ["s"], "b", ["t"], "name", 3, root=str(tmp_path / "out")).orderBy("position").collect()

    spark.createDataFrame(rows_in[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert [r["name"] for r in run()] == ["b", "a"]
    spark.createDataFrame(rows_in[3:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r["name"] for r in run()] == ["d", "c", "b"]


def test_null_group_keeps_its_profile(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["median_value"] for r in profile.numeric_profile(df, "v", ["k"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_shared_dir_follows_the_session(spark):
    assert files.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
