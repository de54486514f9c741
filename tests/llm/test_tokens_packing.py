import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textjobs.llm import packing, tokens

SCHEMA = "doc_id long, text string, n int, packed string"
ODD = [
    "", "a  b \n\n  c\n", "It's don't x'll ' s", "  lead", "tail  ", "<|endoftext|> a<|endoftext|>", "é́ é  x  y　z",
    "1234 a1b2, c.d", "a\x1cb \x1c c\x7f d", "ẞ İ Σας ΣΑΣ ", "\n\n\nB", "x\t\ty \t z", "漢字 かな abc漢", "a ̈b , ̸c", " ", "\n", "word " * 3000,
    "x" * 20_000,
]


def rows():
    docs = [(i * 3 % 40, t, 1, "own") for i, t in enumerate(ODD)]
    return docs + [(50, None, 2, None), (51, "same text", 0, ""), (51, "same text", 0, ""), (None, "no id", 0, "")]


def library_ids(file, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("file,vocabulary,drop", [("word_bpe_49k.json", 49_408, True), ("byte_bpe_50k.json", 50_257, False)])
def test_token_files(spark, file, vocabulary, drop):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    target = tokens.token_file(docs, public_tokenizers.path(file), vocabulary, end_id=1, drop_space=drop)
    got = sorted(map(tuple, tokens.id_digests(spark, target).collect()), key=lambda r: r[1])
    want, start = [], 0
    pairs = sorted(zip(rows(), library_ids(file, [r[1] for r in rows()])), key=lambda p: (p[0][0] is not None, p[0][0] or 0))
    for (doc, *_), ids in pairs:
        ids = np.array([*ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want


def test_empty_token_file(spark):
    docs = spark.createDataFrame([], SCHEMA)
    target = tokens.token_file(docs, public_tokenizers.path("word_bpe_49k.json"), 49_408, drop_space=True)
    assert tokens.id_digests(spark, target).collect() == []


@pytest.mark.parametrize("bits", [1, 3, 7, 12, 16, 17, 24, 31])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 3 * tokens.IDS_PER_BLOCK + 17, dtype=np.uint32)
    lengths = np.array([5, 0, len(ids) - 5])
    segment = tokens.Segment(tokens.segment_image(ids, lengths, 99, bits))
    assert segment.shard_start == 99 and (segment.lengths == lengths).all()
    assert (segment.ids(0, len(ids)) == ids).all()
    for a, b in ((0, 0), (7, 9), (4090, 4100), (len(ids) - 3, len(ids))):
        assert (segment.ids(a, b) == ids[a:b]).all()
    assert len(tokens.pack(ids[:800], bits)) == 100 * bits


def test_table_of_pieces_may_overflow():
    coder = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), False, max_pieces=40)
    texts = [f"word{i} and word{i % 7}, again" for i in range(200)]
    for text, ids in zip(texts, library_ids("byte_bpe_50k.json", texts)):
        data = np.frombuffer(text.encode(), np.uint8)
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == ids


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = rows()
    got = packing.pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(2), path, end_id=0, size=64).collect()
    ids = {}
    for (doc, *_), own in zip(docs, library_ids("byte_bpe_50k.json", [r[1] for r in docs])):
        ids.setdefault(doc, np.array([*own, 0], "<u4"))
    copies = {doc: sum(d[0] == doc for d in docs) for doc in ids}
    covered = {doc: np.zeros(len(x), int) for doc, x in ids.items()}
    sequences = {}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start:r.start + r.length]) == r.ids_crc32
        covered[r.doc_id][r.start:r.start + r.length] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    assert all((c == copies[doc]).all() for doc, c in covered.items())
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and {p[2] for p in parts} == {at}
    total = sum(map(sum, ([p[1] for p in parts] for parts in sequences.values())))
    padded = sum(packing.padding(sum(p[1] for p in parts), 64) for parts in sequences.values())
    assert padded < 0.15 * total


def test_empty_packing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        size = int(rng.choice([4, 8, 16]))
        positions = np.cumsum(rng.integers(1, size // 2 + 1, 12)).tolist()
        penalties = rng.integers(0, 5, 12).astype(float).tolist()

        def cost(stops):
            low, total = 0, 0.0
            for s in stops:
                n = s - low
                total += (0 if n in (size, size // 2) else size - n) + penalties[positions.index(s)]
                low = s
            return total

        best = {0: 0.0}
        for j, p in enumerate(positions):
            best[p] = min(
                best[i] + (0 if p - i in (size, size // 2) else size - (p - i)) + penalties[j]
                for i in best if 0 < p - i <= size)
        assert cost(packing.windows(positions, penalties, size)) == pytest.approx(best[positions[-1]])


def test_ids_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        tokens.pack(np.array([70_000], np.uint32), 16)
