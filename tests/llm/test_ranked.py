"""Ranked search against a brute-force version."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from textjobs.llm import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        own = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        found = []
        for (d, c), size in zip(counts, sizes):
            score = sum(w * (10 ** 9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t, w in own.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["Ünï", "A1", "ß"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(700)]
    docs += [(None, "W1 w2 w3"), (None, "W1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (800, None), (801, "..."), (802, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30])))) for i in range(40)]
    return docs, items + [(None, "w1 w2"), (3, "w2 w2 zzz"), (90, None), (91, "w1 W1")]


@pytest.mark.parametrize("segment, pack_terms, sent", [(1 << 23, 20_000, 4), (4000, 50, 100), (4000, 100, 1)])
def test_search(spark, segment, pack_terms, sent):
    docs, items = data(1)
    index = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), segment)
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, pack_terms, sent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_row_groups_of_the_index_are_bounded(spark):
    """A reader holds a row group at once, so a file of many segments has many."""
    docs, items = data(3)
    index = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 4000, 20_000)
    segments = index.count()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert segments > 20 and sum(n for n, _ in sizes) == segments
    # the last row of a group passes the limit, so the others of a group are below it
    assert len(sizes) > 5 and max(n for n, _ in sizes) < segments // 2
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_batches_of_segments_are_small_unless_the_session_says_otherwise(spark):
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()
    own.conf.set(key, "67108864b")
    ranked.build_index(own.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert own.conf.get(key) == "8m"
    own.conf.set(key, "16m")
    ranked.build_index(own.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert own.conf.get(key) == "16m"


def test_documents_are_skipped():
    """With the places taken, documents in idle lists only are not looked at."""
    rng = np.random.default_rng(2)
    docs = np.arange(20_000)
    long_list = (10, docs, lambda p: np.full(len(p), 10))
    rare = np.sort(rng.choice(docs, 30, replace=False))
    sums = (1000, rare, lambda p: np.full(len(p), 1000))
    best = ranked.Best(5)
    assert ranked.rank_segment([long_list, sums], best, docs, np.zeros(20_000, bool)) < 5000
    assert best.scores.tolist() == [1010] * 5 and best.ids.tolist() == rare[:5].tolist()


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string, terms int"), spark.createDataFrame([], "item_id long, text string")
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((no_docs, no_items), (no_docs, items), (docs, no_items)):
        assert ranked.search(ranked.build_index(d), i).count() == 0
    assert ranked.search(ranked.build_index(docs), items).count() == 1


def test_norms_beyond_64_bits():
    assert ranked.length_norms(np.array([1 << 40]), 1 << 40, 1 << 60).tolist() == [10 + 90 * (1 << 20)]
