"""Results that no call has, and schemas that cannot be checked in full."""
import pytest

from textjobs.llm import queries, toolcalls

CALLS = "conv_id long, seq long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, seq long, content string"


def test_every_result_has_a_row(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", "{}", []), (1, 1, "b", "f", "{}", []), (None, 0, None, "f", "{}", [])], CALLS)
    results = [
        (1, "a", 3, "first"), (1, "a", 4, "sec\"ond"), (1, "a", 3, "first"), (1, "z", 1, None), (1, "z", 2, "é"), (2, "a", 1, "other"),
        (None, None, 1, "n"), (None, None, 1, "m"),
    ]
    got = toolcalls.link_calls(calls, spark.createDataFrame(results, RESULTS).repartition(3), {"f": {}}, every_result=True).collect()
    rows = [(r.conv_id, r.call_id, r.error, r.n_results, r.canonical) for r in got if r.position is None]
    assert sorted(rows, key=str) == sorted([
        (1, "a", "repeated result", 3, '{"id":"a","result":"first"}'), (1, "a", "repeated result", 3, '{"id":"a","result":"sec\\"ond"}'),
        (1, "z", "no call", 2, '{"id":"z","result":null}'), (1, "z", "no call", 2, '{"id":"z","result":"é"}'),
        (2, "a", "no call", 1, '{"id":"a","result":"other"}'),
        (None, None, "no call", 2, '{"id":null,"result":"n"}'), (None, None, "no call", 2, '{"id":null,"result":"m"}'),
    ], key=str)
    assert not any(r.valid for r in got if r.position is None)
    assert sorted((str(r.call_id), r.error, r.n_results) for r in got if r.position is not None) == [
        ("None", "no result", 0), ("a", None, 3), ("b", "no result", 0)]


def test_op5_keeps_every_reply(spark, tmp_path):
    turns = [
        (1, 0, "assistant", "opens"), (1, 1, "user", "asks"), (1, 2, "assistant", "replies"), (1, 3, "assistant", "goes on"),
        (1, 6, "assistant", "after a gap"), (2, 0, "user", "asks"), (2, 1, "assistant", "one"), (2, 1, "assistant", "two"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op5_tool_calls(spark, str(tmp_path)).collect()
    errors = {(r.call_id, r.canonical): r.error for r in got}
    assert len(got) == 6 and sum('"result":"replies"' in c for _, c in errors) == 1 and sum('"result":"one"' in c for _, c in errors) == 1
    assert {k: e for k, e in errors.items() if e} == {
        ("c1--1", '{"id":"c1--1","result":"opens"}'): "no call", ("c1-2", '{"id":"c1-2","result":"goes on"}'): "no call",
        ("c1-5", '{"id":"c1-5","result":"after a gap"}'): "no call", ("c2-0", '{"id":"c2-0","result":"two"}'): "repeated result",
    }


@pytest.mark.parametrize("schema", [
    {"pattern": "a"}, {"properties": {"x": {"const": 1}}}, {"items": {"anyOf": []}}, {"additionalProperties": {"exclusiveMinimum": 0}},
    {"items": [{}]}, {"$ref": "#"}, {"minItems": 1}, {"type": "date"},
])
def test_schemas_that_are_not_supported(spark, schema):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    with pytest.raises(ValueError, match="supported|schema"):
        toolcalls.link_calls(calls, results, {"f": schema})


def test_schema_of_further_properties():
    assert toolcalls.schema_errors({"a": 1, "b": "x"}, {"additionalProperties": {"type": "integer"}}) == ["$.b: not of type integer"]
