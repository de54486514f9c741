"""Similarity self-join of documents on word shingles, with Bayesian pruning.

1. Every document becomes its set of five-word shingles (64-bit hashes), a
   MinHash signature of ``BANDS * ROWS`` values, and a digest of the set.
   Documents with equal sets are one node from here on.
2. Nodes that agree in all values of a band are candidates.  They are linked
   to the least node of their band value, never to each other, and the links'
   connected components say which nodes need to be compared at all.
3. Components are cut into blocks of about ``BLOCK`` nodes.  Every block meets
   itself and every other block of its component in one task each.  There, pairs
   that share a band are compared ``STEP`` signature values at a time; a pair
   is dropped once the posterior probability that its similarity reaches the
   threshold (uniform prior, binomial matches) is below ``tolerance``.  The
   rest are verified exactly on their sets.  A task returns a row per node,
   not per pair.

A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS,
6e-5 at 0.8, and is pruned with a probability of the order of ``tolerance``;
more similar pairs are lost far less often.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textjobs.llm.columns import held, mix, slices, small_batches, stored, strings, strong_hashes, words
from textjobs.llm.graph import components
from textjobs.sources.files import save_and_reread

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
BANDS, ROWS, STEP, BLOCK = 32, 6, 16, 256

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLACE = _rng.integers(0, 1 << 63, max(ROWS, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, ascending inside a row; shingles
    before each row).  A row of fewer words, but not none, is one shingle."""
    text, starts, ends, before = words(data, offsets)
    h = strong_hashes(strings(text, starts, ends))
    counts = np.diff(before)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(before[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < before[1:][row]
        total += np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))] * _PLACE[k], np.uint64(k + 1))
    total = mix(total)
    order = np.argsort(total)
    order = order[np.argsort(row[order], kind="stable")]
    total, row = total[order], row[order]
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[first], np.searchsorted(row[first], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """MinHash values of every row with a shingle, in order."""
    full = np.flatnonzero(np.diff(before))
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    value = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(x, _XOR[k], out=value)
        np.multiply(value, _MUL[k], out=value)
        out[:, k] = np.minimum.reduceat(value, before[:-1][full]) if len(full) else 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of every band's values, different from band to band."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return mix((parts * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def set_digests(sets: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128 bits in two numbers, size) of every row's set; 0 for an empty set."""
    full, n = np.flatnonzero(np.diff(before)), np.diff(before)
    out = np.zeros((2, len(n)), np.uint64)
    for half, salt in zip(out, (0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(full):
            half[full] = np.add.reduceat(mix(sets ^ np.uint64(salt)), before[:-1][full])
    return out[0].view(np.int64), out[1].view(np.int64), n


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("nearjoin")
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            sets, before = shingle_sets(data, offsets)
            hi, lo, n = set_digests(sets, before)
            keys = band_keys(signatures(sets, before)).view(np.int64)
            at = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), pa.array(hi), pa.array(lo), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())),
            ], names=["row", "doc_id", "hi", "lo", "n", "bands"])


def _detailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and signatures of the rows whose text is the node's."""
    held("nearjoin")
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            part = batch.slice(low, high - low)
            sets, before = shingle_sets(data, offsets)
            hi, lo, n = set_digests(sets, before)
            own = np.flatnonzero((hi == part.column("hi").to_numpy()) & (lo == part.column("lo").to_numpy()) & (n > 0))
            sig = signatures(sets, before)[np.cumsum(n > 0)[own] - 1]
            part = part.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([
                *(part.column(c) for c in ("component", "block", "blocks", "node", "weight")),
                pa.array([s.astype("<u4").tobytes() for s in sig], pa.binary()),
                pa.array([sets[a:b].astype("<u8").tobytes() for a, b in zip(before[own].tolist(), before[own + 1].tolist())], pa.binary()),
            ], names=["component", "block", "blocks", "node", "weight", "sig", "set"])


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values, the fewest matches with which the similarity may
    still reach the threshold: P(J >= t | m of n) is a binomial tail."""
    out = [0]
    for n in range(1, BANDS * ROWS + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


class _Side:
    """The nodes of one block."""

    def __init__(self, members: list[dict]):
        members = list({m["node"]: m for m in members}.values())
        self.node = np.array([m["node"] for m in members], np.int64)
        self.weight = np.array([m["weight"] for m in members], np.int64)
        self.sig = np.frombuffer(b"".join(m["sig"] for m in members), "<u4").reshape(len(members), -1)
        self.sets = [np.frombuffer(m["set"], "<u8") for m in members]
        self.n = np.array([len(s) for s in self.sets])
        self.keys = band_keys(self.sig)


def linked_pairs(a: _Side, b: _Side, same: bool, threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (index in a, index in b) whose similarity reaches the threshold."""
    shared = np.zeros((len(a.node), len(b.node)), bool)
    for t in range(BANDS):
        shared |= a.keys[:, t, None] == b.keys[None, :, t]
    if same:
        shared = np.triu(shared, 1)
    shared &= np.minimum(a.n[:, None], b.n[None, :]) >= threshold * np.maximum(a.n[:, None], b.n[None, :]) - 1e-9
    p, q = np.nonzero(shared)
    matches = np.zeros(len(p), np.int64)
    for k in range(0, BANDS * ROWS, STEP):
        matches += (a.sig[p, k:k + STEP] == b.sig[q, k:k + STEP]).sum(axis=1)
        keep = matches >= least[min(k + STEP, BANDS * ROWS)]
        p, q, matches = p[keep], q[keep], matches[keep]
    if not len(p):
        return p, q
    common = common_shingles(a, b, p, q)
    keep = common >= threshold * (a.n[p] + b.n[q] - common) - 1e-9
    return p[keep], q[keep]


def common_shingles(a: _Side, b: _Side, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets."""
    if len(p) <= 2 * (len(a.node) + len(b.node)):
        return np.array([len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True)) for i, j in zip(p.tolist(), q.tolist())], np.int64)
    terms, where = np.unique(np.concatenate(a.sets + b.sets), return_inverse=True)
    who = np.repeat(np.arange(len(a.node) + len(b.node)), np.concatenate([a.n, b.n]))
    order = np.argsort(where, kind="stable")
    where, who = where[order], who[order]
    out = np.zeros((len(a.node), len(b.node)), np.float64)
    width = 8192
    for low in range(0, len(terms), width):  # products of incidence matrices, some shingles at a time
        i, j = np.searchsorted(where, [low, low + width])
        grid = np.zeros((len(a.node) + len(b.node), width), np.float32)
        grid[who[i:j], where[i:j] - low] = 1
        out += grid[:len(a.node)] @ grid[len(a.node):].T
    return out[p, q].astype(np.int64)


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member of every member's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):  # a pair of blocks at a time
                right = right.as_py()
                a = _Side(left.as_py())
                b = a if right is None else _Side(right)
                p, q = linked_pairs(a, b, right is None, threshold, least)
                if right is None:
                    node, weight = a.node, a.weight
                else:
                    node, weight, q = np.concatenate([a.node, b.node]), np.concatenate([a.weight, b.weight]), q + len(a.node)
                order = np.argsort(node)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                p, q, node, weight = place[p], place[q], node[order], weight[order]
                links = np.bincount(p, weight[q], len(node)) + np.bincount(q, weight[p], len(node))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[_roots(len(node), p, q)[some]]),
                ], names=["node", "links", "root"])

    return run


def near_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, row: str | None = None) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text),
    and its ``row`` if that is given.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of ``threshold`` or more, copies included; ``class_id`` is the
    least doc_id of the rows that such links connect, its own without links.
    A text without words (null, empty, no word) has no links.  Rows with equal
    doc_ids are rows like others; null doc_ids are never the least unless all
    of a class are null.  An empty table gives an empty one.

    ``row`` names a column with a number of every row's own that is stored with
    the rows; without it, rows are numbered and stored here first.
    """
    if row is None:
        docs = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    docs = small_batches(docs).select("doc_id", "text", F.col(row or "row").alias("row"))
    rows = save_and_reread(docs.mapInArrow(_described, "row long, doc_id long, hi long, lo long, n long, bands array<long>"), "shingles")
    some = rows.filter("n > 0")
    nodes = save_and_reread(
        some.groupBy("hi", "lo", "n").agg(
            F.min("doc_id").alias("rep"), F.min("row").alias("rep_row"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    edges = save_and_reread(keys.join(leaders, "key").filter("node <> leader").select("node", "leader").distinct(), "candidates")
    parts = components(edges, "node", "leader")
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    placed = parts.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    wanted = placed.join(nodes.drop("bands"), "node")
    texts = docs.select("row", "text").join(wanted, F.col("row") == F.col("rep_row"))
    members = texts.select("text", "hi", "lo", "component", "block", "blocks", "node", "weight").mapInArrow(
        _detailed, "component long, block long, blocks long, node long, weight long, sig binary, set binary")
    blocks = stored(
        members.groupBy("component", "block", "blocks").agg(F.collect_list(F.struct("node", "weight", "sig", "set")).alias("members")),
        "blocks")

    alone = blocks.select(F.col("members").alias("left"), F.lit(None).cast(blocks.schema["members"].dataType).alias("right"))
    several = blocks.filter("blocks > 1")
    left = several.select("component", F.col("block").alias("i"), "blocks", F.col("members").alias("left"))
    left = left.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j > F.col("i"))))
    right = several.select("component", F.col("block").alias("j"), F.col("members").alias("right"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j"))))
    crossed = left.join(right, ["component", "i", "j"]).select("left", "right")
    found = save_and_reread(
        alone.unionByName(crossed).mapInArrow(_compared(threshold, tolerance), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("node <> root"), "node", "root")
    named = joined.join(nodes.select("node", "rep"), "node")
    ids = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = links.join(joined, "node").join(ids, "component").select("node", "links", "class_id")
    with_class = nodes.select("node", "hi", "lo", "n", "rep", "weight").join(classes, "node", "left").select(
        "hi", "lo", "n", F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = ["doc_id"] if row is None else ["doc_id", F.col("row").alias(row)]
    return some.join(with_class, ["hi", "lo", "n"]).select(*own, "class_id", "n_links").unionByName(
        rows.filter("n = 0").select(*own, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
