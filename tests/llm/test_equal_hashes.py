"""Texts whose polynomial hashes modulo 2^64 are equal for every odd base."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textjobs.llm import decontam, nearjoin, packing, substrings, tokens
from textjobs.llm.columns import span_hashes


def pair(bits=10):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_span_hashes():
    one, two = pair(12)
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = span_hashes(data, np.array([0, len(one)]), np.array([len(one), len(data)])).tolist()
    assert a != b


@pytest.mark.parametrize("file,drop", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids(file, drop):
    texts = [t.encode() for t in pair()]
    path = public_tokenizers.path(file)
    ids, before = tokens.PieceEncoder(path, drop).encode(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 1024, 2048]))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == want


def test_files_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(pair())), "doc_id long, text string")
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    target = tokens.token_file(docs, public_tokenizers.path("word_bpe_49k.json"), 49_408, end_id=1, drop_space=True)
    got = {r["doc_id"]: r["ids_crc32"] for r in tokens.id_digests(spark, target).collect()}
    assert got == {i: zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 1], "<u4")) for i, t in enumerate(pair())}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024).collect():
        got.setdefault(r["doc_id"], set()).add(r["doc_tokens"])
    assert got == {i: {len(own.encode(t, add_special_tokens=False).ids) + 1} for i, t in enumerate(pair())}


def test_benchmark_passages(spark):
    one, two = pair()
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    found = decontam.search(decontam.build_index(docs), spark.createDataFrame([(7, one)], "item_id long, text string"))
    assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 1, 2: 0}


def test_near_join(spark):
    docs = spark.createDataFrame(list(enumerate(pair())), "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in nearjoin.near_join(docs).collect()} == {(0, 0, 0), (1, 1, 0)}


def test_long_repeats(spark):
    one, two = pair(12)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    for r in substrings.remove_repeats(docs, length=3000).collect():
        assert r["n_removed"] == 0
        assert r["kept_sha256"] == hashlib.sha256((one, two)[r["doc_id"] - 1].encode()).hexdigest()
