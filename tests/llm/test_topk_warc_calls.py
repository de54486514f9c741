import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textjobs.llm import toolcalls, topk, warc


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "PACK_ROWS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 9)], "x") for i in range(300)]
    rows += [(300 + i, rows[17][1], "x") for i in range(40)]  # ties
    rows += [(400, None, "x"), (401, [], "x"), (402, [0.1, None], "x"), (403, [float("nan")] * 9, "x"), (450, [float("inf")] * 9, "x")]
    rows += [(500, [1.0, 2.0], "x"), (501, [3.0, -1.0], "x"), (550, [0.5], "x"), (120, rows[3][1], "x"), (None, rows[4][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(5)
    got = sorted(map(tuple, topk.top_k(frame, F.col("id") % 50 == 0, k=5).collect()))
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if usable(v) and i is not None]
    want = []
    for i, v in q:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") >= 0).collect() == []


def test_non_adjacent_form():
    for n in range(2000):
        parts = topk.digits(n)
        assert sum(d << p for p, d in parts) == n and all(b - a > 1 for (a, _), (b, _) in zip(parts, parts[1:]))
        assert topk.digits(-n) == [(p, -d) for p, d in parts]


def pages():
    rnd = random.Random(6)
    rows = [(i, f"http://h/{i}?a=b", rnd.choice(["a" * 99, "b" * 100, "é" * 50, "", None, f"own {i} " * 40])) for i in range(60)]
    return rows + [(70, None, "c" * 500), (71, "http://x\r\nWARC-Type: revisit", "c" * 500), (72, "u", "d" * 200_000), (72, "u", "d" * 200_000), (None, "n", "c" * 500)]


def test_archive(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.read_archive(spark, warc.archive(frame)).collect()
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        owner = min(p for p, _, h in rows if (h or "").encode() == body and p is not None)
        again = len(body) >= 100 and page != owner
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", owner if again else None))
    key = str
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and len(body) - 4 == int(lines["Content-Length"])
        assert lines["WARC-Type"] == r.record_type and r.verified
        if r.record_type == "response":
            assert body[:-4] == bytes(r.payload)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.archive(empty)).collect() == []


SCHEMAS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}}
CALLS = "conv_id long, seq long, call_id string, name string, arguments string, depends_on array<string>, position string"
RESULTS = "conv_id long, call_id string, seq long, content string, name int"


def linked(spark, calls, results):
    return toolcalls.link_calls(
        spark.createDataFrame([(*c, "p") for c in calls], CALLS).repartition(3), spark.createDataFrame([(*r, 1) for r in results], RESULTS), SCHEMAS)


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "f", '{"n": 1}', ["c"]),       # waits for a later call
        (1, 1, "b", "f", '{"n": -1}', []),
        (1, 2, "c", "f", '{ "n":2 }', None),
        (1, 3, "d", "g", "{}", ["a", "b"]),
        (1, 4, "e", "f", "not json", ["nowhere"]),
        (2, 0, "a", "f", '{"n": 1, "m": "é"}', ["b"]),  # a cycle, and a call behind it
        (2, 1, "b", "f", None, ["a"]),
        (2, 2, "c", "f", '{"n": true}', ["b"]),
        (2, 3, "d", "f", '{"n": 1}', []),
        (3, 0, "x", "f", '{"n": 1}', []), (3, 0, "x", "f", '{"n": 1}', []),
        (None, 0, None, "f", '{"n": NaN}', [None]),
    ]
    results = [(1, "a", 9, "late"), (1, "a", 8, "first"), (1, "b", 1, "r\n\"é\""), (1, "c", 1, None), (2, "d", 1, "ok"), (3, "x", 1, "y"), (None, None, 1, "z")]
    got = {}
    for r in linked(spark, calls, results).collect():
        got.setdefault((r.conv_id, r.call_id), []).append(r)
    place = {k: [r.position for r in v] for k, v in got.items()}
    assert place[1, "b"] == [0] and place[1, "c"] == [1] and place[1, "a"] == [2] and place[1, "d"] == [3] and place[1, "e"] == [4]
    assert place[2, "d"] == [0] and place[2, "a"] == place[2, "b"] == place[2, "c"] == [None]
    assert sorted(place[3, "x"]) == [0, 1] and place[None, None] == [0]
    errors = {k: v[0].error for k, v in got.items()}
    assert errors[1, "a"] is None and errors[1, "b"] == "$.n: under minimum" and errors[1, "d"] == "no result; unknown tool"
    assert errors[1, "e"] == "missing dependency; no result; arguments are not JSON"
    assert errors[2, "a"] == "cycle; no result; $: unexpected m" and errors[2, "b"] == "cycle; no result; $: missing n"
    assert errors[2, "c"] == "cycle; no result; $.n: not of type integer" and errors[3, "x"] == "repeated identifier"
    assert got[1, "a"][0].canonical == '{"arguments":{"n":1},"id":"a","name":"f","result":"first"}' and got[1, "a"][0].n_results == 2
    assert json.loads(got[1, "b"][0].canonical)["result"] == 'r\n"é"' and got[1, "e"][0].canonical is None


def test_long_conversation_is_ordered_by_ranges(spark):
    rnd = random.Random(9)
    calls = [(5, i, f"c{i}", "f", '{"n": 1}', [f"c{j}" for j in rnd.sample(range(i), min(i, 2))]) for i in range(400)]
    got = {r.call_id: r.position for r in linked(spark, calls, []).collect()}
    assert got == {f"c{i}": i for i in range(400)}


def test_no_calls(spark):
    assert linked(spark, [], []).collect() == []


@pytest.mark.parametrize("value,schema,n", [
    ([1, "a"], {"type": "array", "items": {"type": "integer"}}, 1), ("abc", {"type": "string", "maxLength": 2}, 1),
    (3.5, {"type": ["number", "null"], "maximum": 3}, 1), (None, {"type": ["number", "null"]}, 0), ("x", {"enum": ["y"]}, 1),
])
def test_schema_errors(value, schema, n):
    assert len(toolcalls.schema_errors(value, schema)) == n
