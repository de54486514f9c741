"""Streams with keyed state: pieces of texts, changed histories, traces."""
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter, functions as F

from textjobs.streaming import jobs, stateful


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def pieces(spark, tmp_path, idle="1 hour"):
    stream = stateful.accumulate_pieces(jobs.read_stream(spark, str(tmp_path / "in"), jobs.CHUNK_SCHEMA), idle)
    return jobs.run_to_table(stream, "t", root=str(tmp_path / "out"), settings=stateful.STATE_STORE)


def test_pieces_hold_only_what_a_trigger_added(spark, tmp_path):
    t = datetime(2024, 1, 1)
    feed(spark, tmp_path / "in", [(1, 0, "a", t), (1, 1, "b", t), (1, 4, "e", t), (1, 5, "f", t), (1, 5, "x", t), (2, 1, "z", t)], jobs.CHUNK_SCHEMA)
    first = pieces(spark, tmp_path).orderBy("gen_id", "first_chunk").collect()
    assert [tuple(r) for r in first] == [(1, 0, 2, "ab", "placed")]
    feed(spark, tmp_path / "in", [(1, 2, None, t), (1, 3, "d", t), (1, 4, "late", t), (None, 0, "n", t), (1, None, "?", t), (1, -1, "!", t), (2, 3, "y", t)], jobs.CHUNK_SCHEMA)
    got = pieces(spark, tmp_path)
    assert {tuple(r) for r in got.collect()} == {
        (1, 0, 2, "ab", "placed"), (1, 2, 4, "def", "placed"), (None, 0, 1, "n", "placed"),
        (1, None, 1, "?", "unplaced"), (1, -1, 1, "!", "unplaced")}
    whole = {r["gen_id"]: (r["n_chunks"], r["text"]) for r in stateful.joined_pieces(got).collect()}
    assert whole == {1: (6, "abdef"), None: (1, "n")}
    # what is written is as long as the texts
    assert got.agg(F.sum(F.length("text"))).first()[0] == len("abdef") + len("n?!")


def test_idle_generations_end(spark, tmp_path):
    t = datetime(2024, 1, 1)
    feed(spark, tmp_path / "in", [(1, 0, "a", t), (2, 0, "b", t), (2, 2, "d", t), (2, 3, "e", t), (2, 6, "h", t)], jobs.CHUNK_SCHEMA)
    pieces(spark, tmp_path, "1 millisecond")
    feed(spark, tmp_path / "in", [(9, 0, "new", t)], jobs.CHUNK_SCHEMA)
    got = {tuple(r) for r in pieces(spark, tmp_path, "1 millisecond").collect()}
    assert got == {
        (1, 0, 1, "a", "placed"), (2, 0, 1, "b", "placed"), (9, 0, 1, "new", "placed"), (1, 1, 0, "", "ended"),
        (2, 1, 0, "", "incomplete"), (2, 2, 2, "de", "unplaced"), (2, 6, 1, "h", "unplaced")}


def test_a_batch_with_one_session_writes_one(spark, tmp_path):
    schema = "s string, t int, name string, steps array<string>, extra string"

    def run():
        stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
        changes = stateful.history_changes(stream, ["s"], ["t"], "name", ["extra"], 3, "steps")
        return jobs.run_to_table(changes, "t", "update", str(tmp_path / "out"), stateful.STATE_STORE, "batch")

    feed(spark, tmp_path / "in", [("a", i, n, ["x"], f"e{i}") for i, n in enumerate("ppqqr")] + [
        ("b", 1, "p", ["x"], None), ("b", 2, "", ["x"], None), ("b", 3, "z", [], None), ("b", 4, None, ["x"], None), (None, 1, "n", ["x"], None)], schema)
    run()
    feed(spark, tmp_path / "in", [("a", 5, "r", ["x"], "e5"), ("a", 7, "t", ["x"], "e7"), ("a", 6, "s", ["x"], "e6"), ("b", 5, "p", ["x"], None)], schema)
    stored = run()
    assert stored.where("batch = 1").select("s").collect() == [("a",)]
    got = stateful.latest_histories(stored, ["s"]).orderBy("s", "position").select("s", "position", "t", "name", "extra").collect()
    assert [tuple(r) for r in got] == [
        (None, 1, 1, "n", None), ("a", 1, 7, "t", "e7"), ("a", 2, 6, "s", "e6"), ("a", 3, 4, "r", "e4"), ("b", 1, 1, "p", None)]


def test_rows_that_cannot_be_measured_are_dead_letters(spark, tmp_path, monkeypatch):
    schema = "id int, text string"

    def measure(rows):
        return [{"n": len(r["text"])} for r in rows]  # raises on null

    feed(spark, tmp_path / "in", [(1, "ab"), (2, None), (3, "")], schema)
    feed(spark, tmp_path / "in", [(4, "abc")], schema)

    def run(root):
        stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
        return stateful.log_traces(stateful.measured_traces(stream, measure, "n int"), str(root))

    stored, failed = run(tmp_path / "log")
    assert failed == []
    assert {(r["id"], r["n"], r["kind"], r["error"] is None) for r in stored.collect()} == {
        (1, 2, "log", True), (2, None, "dead", False), (3, 0, "log", True), (4, 3, "log", True)}
    # the first batch cannot be written, the next one is
    write = DataFrameWriter.parquet

    def broken(self, path, *args, **kwargs):
        if path.endswith("batch=0"):
            raise PySparkException("disk is full")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    stored, failed = run(tmp_path / "broken")
    assert [n for n, _ in failed] == [0] and "disk is full" in failed[0][1]
    assert {r["batch"] for r in stored.collect()} == {1}


@pytest.mark.parametrize("size", [1, 3])
def test_settings_are_of_one_query(spark, tmp_path, size):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    feed(spark, tmp_path / "in", [(1, i, "x", None) for i in range(size)], jobs.CHUNK_SCHEMA)
    assert stateful.joined_pieces(pieces(spark, tmp_path)).first()["n_chunks"] == size
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_runs_of_chunks_reach_the_state_as_one_row(spark):
    from textjobs.streaming.jobs import gathered
    rows = [(1, 0, "a", None), (1, 1, None, None), (None, 0, "n", None), (None, None, "m", None), (2, 5, "b", None), (1, 2, "c", None)]
    got = gathered(spark.createDataFrame(rows, "gen_id BIGINT, seq INT, chunk STRING, started_at TIMESTAMP").coalesce(1))
    assert [(r["gen_id"], r["seqs"], r["chunks"]) for r in got.collect()] == [
        (1, [0, 1], ["a", None]), (None, [0, None], ["n", "m"]), (2, [5], ["b"]), (1, [2], ["c"])]
