"""Personal data in whole texts: fixed patterns, and a skip-chain conditional
random field that carries their labels to what repeats them in other forms.

The patterns give the base spans.  The field has a node for every token
(between white space) that holds a digit or an at sign; other tokens have no
label but "none".  Potentials are

* of a node: weights of its shape (counts of digits, letters, dots, signs, and
  whether its neighbours are nodes);
* of two nodes side by side: a weight per pair of labels;
* of two nodes far apart with the same key (its digits, or its letters and
  digits): a weight per pair of labels.  Every node is tied to the next one with
  its key, so a token that is everywhere has as many ties as places.

Tokens of base spans are evidence.  Weights are learned from a bounded sample
by pseudo-likelihood: a node's label given its neighbours'.  Nodes outside base
spans that repeat a token inside one are left out there, as nothing says what
they are; in inference they are what the ties decide.  Marginals come from loopy
sum-product message passing over all texts of a slice at once.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textjobs.llm.columns import code_points, held, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none",) + KINDS
#: Texts the weights are learned from, about; distinct instances kept of them.
FIT_ROWS, FIT_INSTANCES = 20_000, 50_000
#: A span is added from this marginal probability on.
SURE = 0.5
#: At most so many rounds of messages, fewer when none changes by more than ``CALM``.
ROUNDS, CALM, DAMPING = 50, 1e-4, 0.3

SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()),
]))

_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_HOST = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = np.zeros(256, bool)
_HOT[48:58] = _HOT[64] = True
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_NO_DIGIT, _NO_LETTER = re.compile(rb"[^0-9]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of all base matches of one text: leftmost,
    not overlapping inside a kind, by kind and then start.  Time is linear in
    the text: a match starts at the first character its run allows."""
    out = []
    used = 0
    if b"@" in raw:
        stop = np.flatnonzero(~_LOCAL[np.frombuffer(raw, np.uint8)])
        for m in _HOST.finditer(raw):
            before = int(np.searchsorted(stop, m.start()))
            start = max(used, int(stop[before - 1]) + 1 if before else 0)
            if start < m.start():
                out.append((0, start, m.end()))
                used = m.end()
    for m in _IP.finditer(raw):
        parts = [p.lstrip(b"0") for p in m.group().split(b".")]
        if all(len(p) < 3 or len(p) == 3 and int(p) <= 255 for p in parts):
            out.append((1, *m.span()))
    for kind, pattern, least, most in ((2, _CARD, 16, 19), (3, _PHONE, 8, 15)):
        for m in pattern.finditer(raw):
            digits = _NO_DIGIT.sub(b"", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, *m.span()))
    return out


N_FEATURES = 48
#: The bits that tell of nodes at the side.
_SIDES = 7 << 37


def _step(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def shape(token: bytes, left: bool, right: bool) -> int:
    """The features of a token as bits of a number."""
    digits = len(_NO_DIGIT.sub(b"", token))
    letters = len(_NO_LETTER.sub(b"", token)) - digits
    dots, signs = token.count(b"."), token.count(b"@")
    bits = 1
    for base, value in (
        (1, _step(digits, 1, 3, 4, 7, 8, 12, 16, 20)), (10, _step(letters, 1, 3, 8)), (14, _step(dots, 1, 2, 3, 4)),
        (19, _step(signs, 1, 2)), (22, _step(token.count(b"-"), 1, 2)),
    ):
        bits |= 1 << (base + value)
    for at, yes in enumerate((
        token[:1] == b"+", token[:1] == b"(", b")" in token, b"/" in token, b":" in token, b"_" in token or b"=" in token,
        digits == len(token), digits > 0 and letters > 0, dots > 0 and token.rstrip(b".,;!?").count(b".") == 0,
        signs == 1 and b"." in token.partition(b"@")[2].rstrip(b".,;!?"), signs == 1 and token.partition(b"@")[0] == b"",
        digits in (16, 17, 18, 19), left, right, left and right, len(token) > 40,
    )):
        bits |= yes << (25 + at)
    return bits


def key(token: bytes) -> bytes | None:
    """What two forms of one thing share: the digits of a token without
    letters, or its letters (in lower case) and digits; None if that is short."""
    plain = _NO_LETTER.sub(b"", token).lower()
    digits = _NO_DIGIT.sub(b"", token)
    if len(digits) == len(plain):
        return digits if len(digits) >= 6 else None
    return plain if len(plain) >= 8 else None


@dataclass
class Graph:
    """Nodes of all texts of a slice: row, start and end (bytes of the slice),
    features, evidence (-1: none), nodes side by side, nodes tied by a key."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(raw: bytes, offsets: np.ndarray, base: list[list[tuple[int, int, int]]]) -> Graph:
    data = np.frombuffer(raw, np.uint8)
    hot = np.concatenate(([0], np.cumsum(_HOT[data])))
    nodes, chain, skip = [], [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if hot[a] == hot[b]:
            continue
        text = raw[a:b]
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        live = [hot[a + s] < hot[a + e] for s, e in tokens]
        evidence = np.full(len(text) + 1, 0, np.int8)
        for kind, s, e in reversed(base[row]):
            evidence[s:e] = kind + 1
        seen: dict[bytes, int] = {}
        for i, (s, e) in enumerate(tokens):
            if not live[i]:
                continue
            token, n = text[s:e], len(nodes)
            before, after = i > 0 and live[i - 1], i + 1 < len(live) and live[i + 1]
            label = int(evidence[s:e].max())
            nodes.append((row, a + s, a + e, shape(token, before, after), label or -1))
            if before:
                chain.append((n - 1, n))
            k = key(token)
            if k is not None:
                if k in seen:
                    skip.append((seen[k], n))
                seen[k] = n
    table = np.array(nodes, np.int64).reshape(-1, 5)
    return Graph(*table.T, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


def instances(g: Graph) -> np.ndarray:
    """Rows (features, label left, label right, label of the tie before, of
    the tie behind, label), -1 where there is no neighbour.  Nodes without
    evidence that are tied to evidence are left out.  Those with both are
    there a second time as if they stood alone: of a thing that is written in
    another form elsewhere, the tie is all there is."""
    label = np.where(g.label < 0, 0, g.label)
    sides = np.full((len(label), 4), -1, np.int64)
    for k, pairs in ((0, g.chain), (2, g.skip)):
        sides[pairs[:, 1], k] = label[pairs[:, 0]]
        sides[pairs[:, 0], k + 1] = label[pairs[:, 1]]
    tied = (sides[:, 2:] > 0).any(axis=1)
    rows = np.column_stack([g.features, sides, label])
    alone = rows[(label > 0) & tied]
    alone[:, 0] &= ~_SIDES
    alone[:, 1:3] = -1
    return np.concatenate([rows[(label > 0) | ~tied], alone])


@dataclass(frozen=True)
class Model:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # label left x label right
    skip: np.ndarray  # symmetric


def _bits(features: np.ndarray) -> np.ndarray:
    return (features[:, None] >> np.arange(N_FEATURES) & 1).astype(np.float64)


def learn(rows: np.ndarray, counts: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights by penalised pseudo-likelihood (Adam on the whole set)."""
    n, x, weight = len(LABELS), _bits(rows[:, 0]), counts / counts.sum()
    sides = [np.eye(n + 1)[rows[:, 1 + k]][:, :n] for k in range(4)]  # no neighbour: all zero
    y = np.eye(n)[rows[:, 5]]
    theta = [np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, steps + 1):
        node, chain, skip = theta
        z = x @ node + sides[0] @ chain + sides[1] @ chain.T + (sides[2] + sides[3]) @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) * weight[:, None]
        tied = (sides[2] + sides[3]).T @ d
        grads = [x.T @ d, sides[0].T @ d + d.T @ sides[1], (tied + tied.T) / 2]
        for i, g in enumerate(grads):
            g = g + decay * theta[i] * 0.1
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-9)
    return Model(*theta)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(g: Graph, model: Model) -> np.ndarray:
    """(node, label) probabilities by loopy sum-product."""
    n = len(LABELS)
    unary = _bits(g.features) @ model.node
    known = np.flatnonzero(g.label >= 0)
    unary[known] = -60.0
    unary[known, g.label[known]] = 0.0
    pairs = np.concatenate([g.chain, g.skip])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    weights = np.stack([model.chain, model.chain.T, model.skip])
    which = np.concatenate([np.zeros(len(g.chain), int), np.full(len(g.skip), 2), np.ones(len(g.chain), int), np.full(len(g.skip), 2)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), n))
    belief = unary.copy()
    for _ in range(ROUNDS if len(source) else 0):
        new = _log_sum((belief[source] - message[back])[:, :, None] + weights[which], 1)
        new -= _log_sum(new, 1)[:, None]
        new = DAMPING * message + (1 - DAMPING) * new
        change = np.abs(new - message).max()
        message = new
        belief = unary.copy()
        for k in range(n):
            belief[:, k] += np.bincount(target, message[:, k], len(unary))
        if change < CALM:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(g: Graph, p: np.ndarray, raw: bytes, sure: float) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) of runs of nodes without evidence whose label is
    sure, without the punctuation around them."""
    label = np.where((g.label < 0) & (p.max(axis=1) >= sure), p.argmax(axis=1), 0) if len(p) else np.zeros(0, np.int64)
    joined = np.zeros(len(label), bool)
    joined[g.chain[:, 1]] = True
    out: list[tuple[int, int, int, int]] = []
    last = -2
    for i in np.flatnonzero(label).tolist():
        if last == i - 1 and joined[i] and label[i] == label[last]:
            out[-1] = (*out[-1][:3], int(g.end[i]))
        else:
            out.append((int(g.row[i]), int(label[i]) - 1, int(g.start[i]), int(g.end[i])))
        last = i
    spans = []
    for row, kind, s, e in out:
        text = raw[s:e]
        s += len(text) - len(text.lstrip(b"\"'<[{,;:!?.=/"))
        e -= len(text) - len(text.rstrip(b"\"'>]},;:!?.=/"))
        if s < e:
            spans.append((row, kind, s, e))
    return spans


def _rows_of(raw: bytes, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    hot = np.concatenate(([0], np.cumsum(_HOT[np.frombuffer(raw, np.uint8)])))
    return [base_spans(raw[a:b]) if hot[a] < hot[b] else [] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("private")
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            raw = data.tobytes()
            rows = instances(graph(raw, offsets, _rows_of(raw, offsets)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["f", "l", "r", "s", "t", "y"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_instances: int = FIT_INSTANCES) -> Model | None:
    """Weights from about ``fit_rows`` of the rows of ``docs`` (text), chosen
    by a hash of the text, and from the ``fit_instances`` most frequent
    distinct instances in them.  Equal texts are chosen together, and counted
    together.  None without any labelled token: then only base spans exist."""
    texts = small_batches(docs).select("text")
    n = texts.count()
    if n > fit_rows:
        texts = texts.filter(F.xxhash64(F.lit("fit"), "text") < F.lit(int((fit_rows / n - 0.5) * 2 ** 64)))
    counted = texts.mapInArrow(_instances, "f long, l long, r long, s long, t long, y long").groupBy("f", "l", "r", "s", "t", "y").count()
    rows = counted.orderBy(F.col("count").desc(), "f", "l", "r", "s", "t", "y").limit(fit_instances).collect()
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 7)
    if not (table[:, 5] > 0).any():
        return None
    return learn(table[:, :6], table[:, 6].astype(np.float64))


def find_private(docs: DataFrame, model: Model | None, text: str = "text", out: str = "spans", sure: float = SURE) -> DataFrame:
    """``docs`` with an array of (kind, start, end, base) in code points, end
    exclusive, by kind as in ``KINDS`` and then start.  Base spans are all
    there, whatever the model says.  Null and empty texts have none; repeated
    rows get equal spans; a column ``out`` is replaced.  Every text is looked
    at alone; a task holds a slice of 2 MB, or one longer text."""
    docs = small_batches(docs.drop(out))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, SPAN)])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("private")
        for batch in batches:
            spans: list[list[dict]] = []
            for low, high, data, offsets in slices(batch.column(batch.schema.get_field_index(text))):
                raw = data.tobytes()
                base = _rows_of(raw, offsets)
                every = [[(k, s, e, True) for k, s, e in row] for row in base]
                if model is not None:
                    g = graph(raw, offsets, base)
                    for row, k, s, e in added_spans(g, marginals(g, model), raw, sure):
                        every[row].append((k, s - int(offsets[row]), e - int(offsets[row]), False))
                for row, found in enumerate(every):
                    if not found:
                        spans.append([])
                        continue
                    found = sorted(found)
                    points = code_points(data[offsets[row]:offsets[row + 1]], np.array([f[1:3] for f in found])).tolist()
                    spans.append([{"kind": KINDS[f[0]], "start": s, "end": e, "base": f[3]} for f, (s, e) in zip(found, points)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind_type)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)
