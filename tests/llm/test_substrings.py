import hashlib
import random
from collections import Counter

import pytest

from textjobs.llm import substrings


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[a:a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(docs, texts):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdéfgh \n") for _ in range(600)) for _ in range(3)]
    docs = []
    for i in range(120):
        if rnd.random() < 0.3:
            text = "".join(rnd.choice(["ab", "a", "é", "x y z ", "0" * 30, "abcabc"]) for _ in range(rnd.randint(0, 200)))
        else:
            at = rnd.randint(0, 500)
            text = "".join(rnd.choice("klmnop") for _ in range(rnd.randint(0, 90))) + rnd.choice(base)[at:at + rnd.randint(20, 400)]
            text += "".join(rnd.choice("qrstu") for _ in range(rnd.randint(0, 90)))
        docs.append((i, text))
    docs += [(1000, None), (1001, ""), (1002, "z" * 79), (1003, "z" * 80), (1004, "y" * 81), (1005, base[0]), (1005, base[0]), (None, base[1])]
    return docs + [(1006, base[2] * 20)]


@pytest.mark.parametrize("length,window,chunk", [(80, 32, 6000), (100, 64, 2000), (400, 128, 1 << 23), (400, 128, 3000)])
def test_removed_bytes(spark, length, window, chunk):
    docs = documents()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, chunk int").repartition(3)
    got = sorted((tuple(r) for r in substrings.remove_repeats(frame, length, window, chunk).collect()), key=str)
    assert got == brute(docs, length)


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_strings(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    docs = [(1, base), (2, "x" * 100 + base[1000:6000]), (3, base[4000:]), (4, "ab" * 6000), (5, base[:4096]), (6, base[1:4097] + "!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in substrings.remove_repeats(frame, 4096).collect()), key=str)
    assert got == brute(docs, 4096)


def test_rows_across_batches():
    """Sorted pairs are ranked alike however they are cut into batches."""
    import numpy as np
    import pyarrow as pa
    from unittest import mock
    import pyspark
    rng = np.random.default_rng(3)
    n = 300
    rows = np.column_stack([rng.integers(0, 60, n), rng.integers(0, 3, n), np.arange(n), np.arange(n), rng.integers(0, 20, n) == 0])
    rows = rows[np.lexsort((-rows[:, 4], rows[:, 1], rows[:, 0]))]
    context = mock.Mock()
    context.get.return_value.partitionId.return_value = 0
    for marks in (False, True):
        groups = {}
        for r in rows.tolist():
            groups.setdefault((r[0], r[1]), []).append(r)
        want = {r[2] for g in groups.values() for r in g if g[0][4] or (len(g) > 1 and not marks)}
        for size in (1, 2, 7, 300):
            batches = [pa.RecordBatch.from_arrays(
                [pa.array(c) for c in rows[i:i + size].T[:4]] + [pa.array(rows[i:i + size, 4] == 1)], names=["a", "b", "chunk", "place", "mark"])
                for i in range(0, n, size)]
            with mock.patch.object(pyspark, "TaskContext", context):
                out = [r for b in substrings._ranked(marks)(iter(batches)) for r in b.to_pylist()]
            assert {r["chunk"] for r in out} == want and len(out) == len(want)
            of = {r["chunk"]: r["rank"] for r in out}
            assert len({(k, of[r[2]]) for k, g in groups.items() for r in g if r[2] in of}) == len({of[x] for x in of})


def test_few_spans_cost_few_bytes():
    """Spans far apart are hashed without the text between them, and alike."""
    import numpy as np
    from unittest import mock
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 300_000).astype(np.uint8)
    starts = np.sort(rng.choice(len(data) - 600, 40, replace=False))
    ends = starts + rng.integers(1, 600, 40)
    mixed = rng.permutation(40)
    with mock.patch.object(substrings, "span_hashes", wraps=substrings.span_hashes) as hashed:
        got = substrings.names(data, starts[mixed], ends[mixed], wide=True)
    assert max(len(c.args[0]) for c in hashed.call_args_list) <= (ends - starts).sum() + 40 * 64
    for k, base in enumerate((substrings.BASE, substrings.BASE2)):
        assert (got[:, k] == substrings.mix(substrings.span_hashes(data, starts, ends, base)[mixed])).all()
    assert len(substrings.names(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 69, 1024, 1025])
def test_prefix_names_tell_bytes_apart(size):
    """Equal names for equal bytes and other names for others, every byte counted."""
    import numpy as np
    rng = np.random.default_rng(size)
    one = rng.integers(0, 256, size).astype(np.uint8)
    texts = [one, one.copy()]
    for at in range(0, size, max(1, size // 40)):
        texts.append(one.copy())
        texts[-1][at] ^= 128
    data = np.concatenate([np.zeros(3, np.uint8), *texts])
    got = substrings.prefix_names(data, 3 + size * np.arange(len(texts)), size).tolist()
    assert got[0] == got[1] and len(set(got)) == len(texts) - 1
    assert substrings.prefix_names(data, np.zeros(0, np.int64), size).tolist() == []


def test_runs_stay_in_their_rows():
    import numpy as np
    offsets = np.array([0, 0, 10, 10, 25, 40, 40])
    starts, ends = np.array([20, 0, 5, 10, 14, 30, 31]), np.array([25, 5, 10, 14, 16, 34, 33])
    low, high, row = (x.tolist() for x in substrings.runs(starts, ends, offsets))
    assert list(zip(low, high, row)) == [(0, 10, 1), (10, 16, 3), (20, 25, 3), (30, 34, 4)]
    nothing = np.zeros(0, np.int64)
    assert [len(x) for x in substrings.runs(nothing, nothing, offsets)] == [0, 0, 0]
