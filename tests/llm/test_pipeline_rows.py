"""The stages that drop rows, on tables with repeated and null ids."""
import duckdb

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.text, r.source) for r in stage(spark, docs, SF).collect()), key=str)


def test_near_duplicates_by_row(spark):
    copy, near, own, nulls = "one text that stands in several rows", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "a text of its own here", "rows without any id at all"
    rows = [
        (7, copy, "a"), (7, copy, "a"), (3, copy, "b"), (3, own, "c"),  # 3 has a unique text as well
        (9, near, "d"), (8, near + "end", "e"), (8, "something else for id eight", "f"), (9, "and something else for id nine", "g"),
        (None, nulls, "h"), (None, nulls, "h"), (None, own, "i"), (None, "alone and without an id", "j"),
    ]
    want = [rows[i] for i in (2, 3, 5, 6, 7, 8, 11)]
    assert kept(spark, pipeline.near_duplicates, rows) == sorted(want, key=str)


def test_decontamination_by_row(spark):
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE length(text) > 150 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    clean = [(5, "clean although its id comes twice", "a"), (None, "clean and without an id", "b"), (6, "clean", "c")]
    rows = [*clean, (5, f"Before. {item}", "d"), (None, f"{item} After.", "e"), (5, f"Before. {item}", "d")]
    assert kept(spark, pipeline.decontamination, rows) == sorted(clean, key=str)
