"""Every stage, and all of them, against brute force on a small table."""
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_decontam import brute as windows
from test_nearjoin import brute as classes
from test_secrets import brute as secrets
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE length(text) > 150 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    odd = [None, "", "12 !? 34", "é", "token=abcdef123456 and more", f"Before it. {item} After it.", rows[3][1], rows[3][1] + " end", "same row here", "same row here"]
    return rows + [(10_000 + i, t, None, None, len(t or "")) for i, t in enumerate(odd)] + [(10_009, "same row here", None, None, 13), (None, "no id at all here", "en", "x", None)]


def items():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()


def kept_by(rows, ids):
    return [r for r in rows if r[0] in ids]


def language(rows):
    return [r for r in rows if any(map(str.isalpha, r[1] or ""))]


def deduplicated(rows):
    return kept_by(rows, {doc for doc, least, _ in classes([r[:2] for r in rows]) if doc == least})


def clean(rows):
    return kept_by(rows, {doc for doc, _, hit, _ in windows([r[:2] for r in rows], items(), 10) if not hit})


def redacted(rows):
    out = []
    for doc, text, *rest in rows:
        new, at = "", 0
        for kind, start, end in secrets(text):
            if end > at:
                new += text[at:max(start, at)] + (f"[{kind}]" if start >= at else "")
                at = end
        new += text[at:]
        out.append((doc, new, *rest[:-1], len(new) if at else rest[-1]))
    return out


def without_lang(rows):
    return sorted((r[:2] + r[3:] for r in rows), key=str)


@pytest.mark.parametrize("stage,want", [(0, language), (1, deduplicated), (2, clean), (3, redacted)])
def test_stage(spark, stage, want):
    rows = documents() if stage == 0 else language(documents())
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", spans int, node string").repartition(3)
    name, function = pipeline.STAGES[stage]
    got = function(spark, docs, SF)
    assert got.columns == pipeline.COLUMNS
    got = got.collect()
    assert without_lang([tuple(r) for r in got]) == without_lang(want(rows))
    given = {r[0]: r[2] for r in rows}
    assert all(r.lang == given[r.doc_id] or given[r.doc_id] is None for r in got)


def test_all_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    want = redacted(clean(deduplicated(language(rows))))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {r[0]: np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 0], "<u4") for r in want}
    left = {doc: np.ones(len(x), int) * sum(r[0] == doc for r in want) for doc, x in ids.items()}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        left[r.doc_id][r.start:r.start + r.length] -= 1
    assert not any(x.any() for x in left.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
