import random
import re

from textjobs.llm import nearjoin
from textjobs.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, threshold=0.8):
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset())
    links, label = [0] * len(docs), list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    members = {}
    for i, (doc, _) in enumerate(docs):
        members.setdefault(root(i), []).append(doc)
    least = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(((doc, least[root(i)], links[i]) for i, (doc, _) in enumerate(docs)), key=str)


def documents():
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]

    def text(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    docs = [(i, " ".join(text(rnd.randint(3, 120)))) for i in range(60)]
    base = text(80)
    for i in range(70):  # a large group of near copies, all different
        own = list(base)
        for _ in range(rnd.randint(0, 1)):
            own[rnd.randrange(80)] = f"new{i}"
        docs.append((100 + i, " ".join(own)))
    docs += [(200 + i, docs[3][1]) for i in range(20)] + [(300, docs[4][1].upper() + "!"), (400, None), (401, ""), (402, "?!"), (403, "one")]
    return docs + [(404, "One"), (405, "one two"), (406, " ".join(text(9000))), (407, docs[5][1]), (407, docs[5][1]), (None, docs[6][1])]


def test_classes_and_links(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", 16)  # several blocks in a class
    docs = documents()
    frame = spark.createDataFrame([(*d, "n", 3) for d in docs], "doc_id long, text string, node string, weight int").repartition(4)
    got = sorted((tuple(r) for r in nearjoin.near_join(frame).collect()), key=str)
    assert got == brute(docs)


def test_no_rows(spark):
    assert nearjoin.near_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_bound():
    least = nearjoin.least_matches(0.8, 1e-4)
    assert least[0] == 0 and (least[1:] <= range(1, len(least))).all() and (least[1:] >= least[:-1]).all()
    assert least[192] < 0.8 * 192 and least[192] > 0.6 * 192


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100, 500: 500}
