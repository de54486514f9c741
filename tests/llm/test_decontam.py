import random
import re

import pytest

from textjobs.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[a:a + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in wins:
                    hit[a:a + size] = [True] * size
                    found |= wins[tuple(w[a:a + size])]
        out.append((doc, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(8)
    vocabulary = ["the", "Of", "to", "é", "x1", "word", "wörd", "a", "b", "c"]

    def text(n):
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))

    items = [(i, text(rnd.randint(1, 20))) for i in range(30)] + [(90, None), (91, ""), (92, "!!"), (93, "the"), (3, text(12))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(80)]
    docs += [(100 + i, text(15) + " " + t + " " + text(9)) for i, t in items[:20] if t]
    return docs + [(200, None), (201, ""), (202, "of " * 5000), (203, docs[0][1]), (203, docs[0][1])], items


@pytest.mark.parametrize("window,pack,sent", [(10, 100_000, 4), (4, 60, 4), (4, 60, 1000)])
def test_exact_matches(spark, window, pack, sent):
    docs, items = tables()
    frame = spark.createDataFrame([(*d, "s", 5) for d in docs], "doc_id long, text string, segment string, item_id int").repartition(3)
    index = decontam.build_index(frame)
    got = decontam.search(index, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"), window, 0, pack, sent).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=str) == brute(docs, items, window)
    assert all(r.n_hit == sum(s.end - s.start for s in r.intervals) for r in got)


def test_near_matches(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "alpha beta new gamma delta"), (3, "alpha beta x y z gamma delta")]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")

    def found(slack):
        return {r.doc_id for r in decontam.search(index, items, 10, slack).collect() if r.n_hit}

    assert found(0) == {1} and found(1) == {1, 2} and found(3) == {1, 2, 3}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.search(decontam.build_index(empty), items).collect() == []
    assert [(r.n_words, r.n_hit) for r in decontam.search(decontam.build_index(docs), items).collect()] == [(2, 0)]
