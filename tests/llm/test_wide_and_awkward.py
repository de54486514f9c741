"""Cases that once ended a job or were left out."""
import json
import random

from pyspark.sql import functions as F

from textjobs.llm import nearjoin, toolcalls, topk

CALLS = "conv_id long, seq long, call_id string, name string, arguments string, depends_on array<string>"


def linked(spark, calls, **more):
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    return toolcalls.link_calls(spark.createDataFrame(calls, CALLS), results, {"t": {"type": "object"}}, **more)


def test_numbers_and_halves_of_characters(spark):
    texts = ['{"n": 1e400}', '{"n": "\\ud800"}', '{"n": ' + "9" * 4301 + "}", "[" * 100_000, '{"\\udfff": 1}', '{"n": -1e999}', '{"n": 1e308}']
    got = {r["call_id"]: r for r in linked(spark, [(1, i, f"c{i}", "t", t, []) for i, t in enumerate(texts)]).collect()}
    assert len(got) == len(texts)
    for i in (0, 2, 5):
        assert "number out of range" in got[f"c{i}"]["error"] and got[f"c{i}"]["canonical"] is None
    assert "nested too deep" in got["c3"]["error"]
    for i in (1, 4, 6):
        assert json.loads(got[f"c{i}"]["canonical"])["arguments"] == json.loads(texts[i])


def test_chain_of_calls_that_wait_for_later_ones(spark):
    n = 2000
    calls = [(1, i, f"c{i}", "t", "{}", [f"c{i + 1}"] if i + 1 < n else []) for i in range(n)]
    got = linked(spark, calls).collect()
    assert {r["call_id"]: r["position"] for r in got} == {f"c{i}": n - 1 - i for i in range(n)}


def test_components_in_a_task_are_ordered_as_over_all_tasks(spark):
    rng = random.Random(3)
    calls = []
    for conv in range(12):
        for i in range(15):
            wanted = [f"c{rng.randrange(17)}" for _ in range(rng.choice([0, 0, 1, 2]))]
            calls.append((conv, i, f"c{i}", "t", "{}", wanted))
    one = sorted(map(tuple, linked(spark, calls).collect()))
    assert one == sorted(map(tuple, linked(spark, calls, in_task=0).collect()))


def test_any_finite_component(spark):
    rng = random.Random(5)
    rows = [(0, [1e5, 1.0]), (2, [7e4, 3.0]), (50, [1.0, 1.0]), (1, [2.0, 1.0]), (3, []), (100, []), (4, [1e300, 0.0]), (150, [0.0, 1.0]),
            (5, [-1e18, 4e17]), (200, [1e19, -3.0]), (250, [1e300, 1e-300]), (6, [float("nan"), 1.0]), (7, None), (8, [float("inf"), 1.0])]
    rows += [(300 + i, [rng.uniform(-1e16, 1e16), rng.uniform(-9, 9)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("id") % 50 == 0, k=5).collect())
    q = {i: [topk.scaled(v, 256) for v in x] for i, x in rows if x is not None and all(abs(v) < float("inf") for v in x)}
    want = []
    for a in q:
        if a % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a and len(q[b]) == len(q[a]))[:5]
            want += [(a, r + 1, b, min(max(-s, topk.LONG_MIN), topk.LONG_MAX)) for r, (s, b) in enumerate(scores)]
    exact = {w[:1] + w[3:] for w in want}
    assert {g[:1] + g[3:] for g in got} == exact and len(got) == len(want)
    clear = [w for w in want if w[3] not in (topk.LONG_MIN, topk.LONG_MAX)]
    assert set(clear) <= set(got)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefghijklmnop") * 3 for _ in range(120)]
    texts = [" ".join([*words[:60], f"x{i}", *words[60:]]) for i in range(60)]
    rows = [(None, t) for t in texts] + [(5, texts[0]), (5, texts[1]), (5, "one two three four five six")]
    got = [tuple(r) for r in nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 5, 61)] * 60 + [(5, 5, 61)] * 2 + [(5, 5, 0)], key=str)
