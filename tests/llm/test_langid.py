import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textjobs.llm import langid
from textjobs.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall()
    out = [(d, lang) for d, lang in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, _ in out} == {d for d, r in got.items() if r.held_out} and len(got) == len(docs)
    assert np.mean([got[d].lang_pred == lang for d, lang in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !? %", "x"), (4, "漢字", "x"), (5, "the and of " * 20_000, "x"), (5, "é", "x")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, False]
    assert [r.score == 0 for r in got] == [True, True, True, False, False, False]
    assert got[4].lang_pred == "en" and not got[4].ambiguous
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert langid.predict(one, langid.fit(one, F.lit(True))).first().lang_pred == "en"


@pytest.mark.parametrize("n,least", [(2, 1), (3, 2), (4, 4), (5, 8), (12, 3)])
def test_codewords_are_apart(n, least):
    code = langid.codewords(n)
    far = (code.shape[1] - code @ code.T) / 2
    assert (far[~np.eye(n, dtype=bool)] >= least).all()
