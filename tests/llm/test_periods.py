"""Periodic runs against a brute-force version."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textjobs.llm import periods
from textjobs.llm.queries import QUERIES, with_planted_periods


def brute(x, least=6, exponent=4):
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            own = x[i:j + q]
            if len(own) >= max(least, exponent * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, j + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        v = rng.choice([1, 2, 3, 50])
        part = [rng.randrange(v) for _ in range(rng.randint(1, 40))]
        out += part if rng.random() < 0.5 else [part[i % len(part)] for i in range(rng.randint(1, 6 * len(part)))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(100):
        x = sequence(rng)
        assert [tuple(r) for r in periods.runs(np.array(x)).tolist()] == brute(x)


def test_long_periods():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 5000, 1500)
    x = np.concatenate([rng.integers(0, 5000, 777), np.tile(part, 5)[:6400], rng.integers(0, 5000, 100)])
    assert [tuple(r) for r in periods.runs(x).tolist()] == brute(x.tolist())


@pytest.mark.parametrize("top", [3, 70_000, 1 << 22])
def test_zero_mismatches_is_exact(top):
    rng = np.random.default_rng(top)
    windows = rng.integers(0, top, (20, 64))
    blocks = np.stack([w[k:k + 32] for k, w in enumerate(windows)])
    blocks[::3, 5] += 1
    want = np.stack([[(w[d:d + 32] == b).all() for d in range(32)] for b, w in zip(blocks, windows)])
    assert (periods.zero_mismatches(blocks, windows) == want).all()


def expected(doc_id, text):
    words = (text or "").encode().split()
    found = brute(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(found), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def planted(doc_id, text):
    import zlib
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def test_query_on_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "a a a a a", "a a a a a a", "a\tb a\nb a b a b", "é x " * 9, "x" * 100_000, "\x00 \x00 " * 4]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(30_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 5), (3, "a a a a a a a"), (3, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_periods"](spark, str(tmp_path)).fillna(-1, ["doc_id"]).collect() if r["doc_id"] != 69)
    want = sorted(expected(-1 if d is None else d, planted(d, t)) for d, t in rows if d != 69)
    assert [tuple(x or 0 for x in r) for r in got] == [tuple(x or 0 for x in r) for r in want]


def test_planted_rows_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in with_planted_periods(docs).collect()}
    changed = 0
    for r in docs.collect():
        want = planted(r["doc_id"], r["text"])
        changed += want != r["text"]
        assert got[r["doc_id"]] == want
    assert changed


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, runs int, collapsed int")
    found = periods.find_runs(docs)
    assert found.count() == 0 and found.columns == ["doc_id", "text", "runs", "collapsed"]
