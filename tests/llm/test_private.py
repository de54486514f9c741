"""Personal data: base spans against plain patterns, the field against enumeration."""
import itertools
import random
import re

import numpy as np

from textjobs.llm import private
from textjobs.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if least <= len(digits) <= most and (kind == 3 or doubled % 10 == 0):
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(3)
    for i in range(20_000):
        text = "".join(rng.choice("1234 .-@+()a0\n") for _ in range(rng.randint(0, 30)))
        if i % 4 == 0:
            text = "+" + "".join(rng.choice("0123456789 -") for _ in range(24))
        assert private.base_spans(text.encode()) == brute(text)


def test_long_texts_take_linear_time():
    for text in (b"a" * 3_000_000, b"1" * 3_000_000, b"+1" + b" " * 3_000_000, b"@a" * 200_000, b"1.2.3 " * 300_000):
        private.base_spans(text)


def test_marginals_of_a_tree_are_exact():
    rng = np.random.default_rng(1)
    n = len(private.LABELS)
    model = private.Model(rng.normal(size=(private.N_FEATURES, n)), rng.normal(size=(n, n)), (lambda a: a + a.T)(rng.normal(size=(n, n))))
    chain, skip = np.array([[0, 1], [2, 3]]), np.array([[1, 3]])
    features = np.array([1, 3, 5, 9])
    label = np.array([-1, -1, 2, -1])
    zero = np.zeros(4, np.int64)
    got = private.marginals(private.Graph(zero, zero, zero, features, label, chain, skip), model)
    node = private._bits(features) @ model.node
    want = np.zeros((4, n))
    for y in itertools.product(range(n), repeat=4):
        if y[2] != 2:
            continue
        p = np.exp(sum(node[i, y[i]] for i in (0, 1, 3)) + model.chain[y[0], y[1]] + model.chain[y[2], y[3]] + model.skip[y[1], y[3]])
        for i in range(4):
            want[i, y[i]] += p
    assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = [rng.choice(["at", "of", "call", "see", "3.", "2024", "x9", "note"]) for _ in range(40)]
        phone = f"+1 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        words[5] = rng.choice([phone, f"u{i}@mail.example.com", "10.0.3.7", "4111111111111111", "plain"])
        if words[5] == phone and i % 3 == 0:
            words[30] = phone
        if i % 2:
            words[20] = f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"  # of an order, say
        rows.append((i, " ".join(words)))
    return rows


def test_a_label_spreads_to_what_repeats_it(spark):
    """A number that stands in full in one place is found in another without
    its prefix; the same number alone in a text is not."""
    rows = corpus() + [(1000, "call +1 (201) 555-7713 of note or see 555-7713 at"), (1001, "call of note see 555-7713 at"),
                       (1002, "at +1 (826) 555-4081 190.137.223.204 note")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in private.find_private(docs, private.fit(docs)).collect()}
    text = dict(rows)
    assert [text[1000][s["start"]:s["end"]] for s in found[1000] if not s["base"]] == ["555-7713"]
    assert found[1001] == []
    assert "+1 (826) 555-4081" in [text[1002][s["start"]:s["end"]] for s in found[1002]]
    assert not [s for i in range(600) for s in found[i] if not s["base"] and text[i][s["start"]:s["end"]] in ("2024", "x9", "3", "3.")]


def test_query_on_awkward_rows(spark, tmp_path):
    texts = [None, "", "é a@b.c ü 1.2.3.4", "x" * 50_000 + "@y.z", "+49 30 1234567", "4111 1111 1111 1111 4111", "\x00@a.b", "@@ 300.1.1.1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q@r.s"), (2, texts[2]), (2, texts[2])]
    for number, own in enumerate((rows, [])):
        folder = f"{tmp_path}/{number}"
        spark.createDataFrame([(*r, 0) for r in own], "doc_id long, text string, spans int").write.parquet(f"{folder}/documents.parquet")
        got = QUERIES["op11_personal_data"](spark, folder).collect()
        assert len(got) == len(own)
        want = {(d, tuple(sum(k == i for k, _, _ in brute(t or "")) for i in range(4))) for d, t in own}
        assert {(r["doc_id"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])) for r in got} == want
        for r in got:
            text = dict(own)[r["doc_id"]]
            for kind, s, e in brute(text or ""):
                assert f"{private.KINDS[kind]}:{s}:{e}" in r["spans"].split(",")
