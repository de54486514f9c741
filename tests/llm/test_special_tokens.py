"""Strings of added tokens in a text: the ids of the library with nothing set."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textjobs.llm import queries, tokens

TEXTS = [
    "one text<|endoftext|> two", "a <|endoftext|>b", "a<|startoftext|> x<|endoftext|><|endoftext|>  q", "it's<|endoftext|>'s", " <|endoftext|> ",
    "<|endoftext|<|endoftext|>", "x \n<|endoftext|>\n\nB", "﹤<|endoftext|>́é　", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "|> and <|", "", None, "plain",
]


def library_ids(file, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in TEXTS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("special")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("file,drop", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder(file, drop):
    coder = tokens.PieceEncoder(public_tokenizers.path(file), drop, special_tokens=True)
    texts = [(t or "").encode() for t in TEXTS]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])  # 9 and 10 hold the string between them
    ids, before = coder.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [x[:-1].tolist() for x in library_ids(file, 0)]


def test_op2(spark, folder):
    got = sorted(map(tuple, queries.op2_token_ids(spark, folder).collect()))
    ids = library_ids("word_bpe_49k.json", 1)
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert got == [(i, starts[i], len(x), zlib.crc32(x)) for i, x in enumerate(ids)]


@pytest.mark.parametrize("pack", [
    queries.op6_packing, lambda spark, path: corpus_pipeline.packing(spark, spark.read.parquet(f"{path}/documents.parquet"), path)])
def test_packing(spark, folder, pack):
    ids, covered = library_ids("byte_bpe_50k.json", 0), [0] * len(TEXTS)
    for r in pack(spark, folder).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start:r.start + r.length]) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == [len(x) for x in ids]
