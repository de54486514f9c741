"""Ranked lexical search: every item against all documents, in whole numbers.

``build_index`` stores, for segments of documents, the distinct terms, and for
each the list of its documents with their counts, the largest count and the
shortest document of the list: with these two no contribution of the list is
above a known bound.

``search`` ranks hybridly.  In a segment, an item's short lists are added up
term at a time into an accumulator per document.  The accumulators, in the
order of documents, are from there on one iterator among those of the long
lists; its bound is the largest sum.  Documents then come at a time: as long
as the bounds of some iterators together cannot reach the score of the current
last place, documents that stand in those only are skipped, and of the others
a document is given up as soon as its sum and the bounds still open stay below.
Last places carry over from segment to segment inside a task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from textjobs.llm.columns import SENT_PACKS, few_bytes, held, slices, small_batches, stored, strings, with_every_pack, words

K = 10
#: Bytes of text in a segment (or one longer text).
SEGMENT = 1 << 23
#: Bytes of segments in a row group of the index, which a reader holds at once.
GROUP = 1 << 23
#: Lists of at most this share of a segment's documents are short.
SHORT = 16
#: Terms of items that travel together.
PACK_TERMS = 20_000
#: Documents that are looked at together.
STEP = 256

INDEX = (
    "segment long, doc_ids array<long>, n_terms binary, with_terms long, all_terms long, terms array<string>, "
    "df array<int>, docs binary, counts binary, most binary, shortest binary"
)
_FIELDS = [
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_terms", pa.binary()), ("with_terms", pa.int64()),
    ("all_terms", pa.int64()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("docs", pa.binary()),
    ("counts", pa.binary()), ("most", pa.binary()), ("shortest", pa.binary()),
]
_PACKED = "items array<struct<row: long, item_id: long, terms: array<string>, weights: array<long>>>"


def term_column(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all terms of all rows in order, terms before each row)."""
    low, starts, ends, before = words(data, offsets)
    return strings(low, starts, ends), before


def _segment(number: int, doc_ids: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns, sizes = zip(*[term_column(d, o) for d, o in texts])
    every = pa.chunked_array(columns, pa.string()).combine_chunks().dictionary_encode()
    if isinstance(every, pa.ChunkedArray):
        every = every.combine_chunks()
    term = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.concatenate([np.diff(s) for s in sizes])
    doc = np.repeat(np.arange(len(n)), n)
    pair, counts = np.unique(term * len(n) + doc, return_counts=True)
    doc, term = pair % max(len(n), 1), pair // max(len(n), 1)
    first = np.searchsorted(term, np.arange(len(every.dictionary)))
    df = np.diff(np.append(first, len(term)))
    some = len(first) > 0
    values = [
        number, doc_ids, n.astype("<i8").tobytes(), int((n > 0).sum()), int(n.sum()), every.dictionary, df.astype(np.int32),
        doc.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
        (np.maximum.reduceat(counts, first) if some else first).astype("<u4").tobytes(),
        (np.minimum.reduceat(n[doc], first) if some else first).astype("<i8").tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS)], names=[f for f, _ in _FIELDS])


def _indexed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held("ranked")
        number, doc_ids, texts, have = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), size):
                if texts and have + len(data) > size:
                    yield _segment(number, doc_ids, texts)
                    number, doc_ids, texts, have = number + 1, [], [], 0
                doc_ids += batch.column("doc_id").slice(low, high - low).to_pylist()
                texts.append((data.copy(), offsets.copy()))
                have += len(data)
        if texts:
            yield _segment(number, doc_ids, texts)

    return run


def build_index(docs: DataFrame, segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """The index of every term of ``docs`` (doc_id, text), written to the
    shared folder in row groups of about ``group`` bytes, so that no task holds
    more than a few segments, however many a file has; no shuffle.  Terms are runs of digits, letters and
    characters beyond ASCII, A-Z in lower case.  A null or empty text has no
    terms; an empty table gives an index without segments."""
    return stored(few_bytes(small_batches(docs)).select("doc_id", "text").mapInArrow(_indexed(segment), INDEX), "ranked-index", group)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            terms, before = term_column(data, offsets)
            at = before.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("item_id").slice(low, high - low),
                pa.array([terms.slice(a, b - a).unique().to_pylist() for a, b in zip(at[:-1], at[1:])], pa.list_(pa.string())),
            ], names=["row", "item_id", "terms"])


def item_packs(index: DataFrame, items: DataFrame, n: int, pack_terms: int) -> tuple[DataFrame, int]:
    """(pack, items) with the weights of all terms that occur, about
    ``pack_terms`` terms a pack, and the number of packs."""
    named = stored(small_batches(items).select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "ranked-items")
    asked = named.mapInArrow(_item_terms, "row long, item_id long, terms array<string>").select(
        "row", "item_id", F.explode("terms").alias("term"))
    asked = stored(asked, "ranked-terms")
    lists = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    wanted = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(wanted.select("term", weight.alias("weight")), "term")
    packs = max(1, -(-asked.count() // pack_terms))
    per_item = weighed.groupBy("row", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    per_item = per_item.select("row", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    pack = F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int")
    packed = per_item.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct("row", "item_id", "terms", "weights")).alias("items"))
    return stored(packed, "ranked-packs"), packs


def damped(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term contributes per unit of its weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """10 + (90 n N) div L, in integers of any size where 64 bits do not do."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + (90 * n * documents) // max(terms, 1)
    return np.array([10 + (90 * x * documents) // terms for x in n.tolist()], np.int64)


class Best:
    """The best ``k`` (score, document) of an item so far: highest scores,
    equal ones by ascending doc_id, a null one last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.missing = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """No document with a lower score gets a place."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.missing, missing)))
        order = np.lexsort((ids, missing, -scores))[:self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def accumulators(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: (documents in order, sums of the lists' contributions)."""
    docs, back = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    total = np.zeros(len(docs), np.int64)
    np.add.at(total, back, np.concatenate([c for _, c in lists]))
    return docs, total


def _at(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the wanted documents are in a list, their places in it)."""
    place = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    inside = np.flatnonzero(docs[place] == wanted)
    return inside, place[inside]


def rank_segment(iterators: list[tuple[int, np.ndarray, object]], best: Best, ids: np.ndarray, missing: np.ndarray) -> int:
    """Document at a time over iterators (bound, documents in order, a map
    from places to contributions); the number of documents scored."""
    iterators = sorted(iterators, key=lambda it: it[0])
    reach = np.cumsum([it[0] for it in iterators])  # what the first iterators together can give
    scored, done, step = 0, -1, STEP
    while True:
        idle = int(np.searchsorted(reach, best.least))  # these alone cannot reach a place
        if idle == len(iterators):
            return scored
        rest = [it[1][np.searchsorted(it[1], done, "right"):] for it in iterators[idle:]]
        wanted = np.unique(np.concatenate([r[:step] for r in rest]))
        if not len(wanted):
            return scored
        # complete up to the last document that every cut list has shown
        upto = min((int(r[step - 1]) for r in rest if len(r) > step), default=int(wanted[-1]))
        wanted = wanted[:np.searchsorted(wanted, upto, "right")]
        done, scored, step = upto, scored + len(wanted), min(2 * step, 16 * STEP)
        total = np.zeros(len(wanted), np.int64)
        for i in range(len(iterators) - 1, -1, -1):
            inside, place = _at(iterators[i][1], wanted)
            total[inside] += iterators[i][2](place)
            if i <= idle:
                keep = total + (reach[i - 1] if i else 0) >= best.least
                wanted, total = wanted[keep], total[keep]
                if not len(wanted):
                    break
        if len(wanted):
            best.add(total, ids[wanted], missing[wanted])


def _searched(k: int, documents: int, terms: int):
    """A map over segments with packs: the best documents of every item in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ranked")
        found: dict[tuple, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                n, docs, counts, most, shortest = (
                    np.frombuffer(r[c].as_buffer(), t).astype(np.int64)
                    for c, t in (("n_terms", "<i8"), ("docs", "<u4"), ("counts", "<u4"), ("most", "<u4"), ("shortest", "<i8")))
                df = r["df"].values.to_numpy().astype(np.int64)
                if not len(df):
                    continue
                ends = np.cumsum(df)
                norm, least_norm = length_norms(n, documents, terms), length_norms(shortest, documents, terms)
                ids = r["doc_ids"].values
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(ids, 0).to_numpy()
                pack = r["items"].values
                terms_of, weights_of = pack.field("terms"), pack.field("weights").flatten().to_numpy().astype(np.int64)
                cut = np.concatenate(([0], np.cumsum(pc.list_value_length(terms_of).to_numpy())))
                places = pc.fill_null(pc.index_in(terms_of.flatten(), r["terms"].values), -1).to_numpy()
                keys = zip(pack.field("row").to_pylist(), pack.field("item_id").to_pylist())
                for key, x, y in zip(keys, cut[:-1].tolist(), cut[1:].tolist()):
                    use = np.flatnonzero((places[x:y] >= 0) & (weights_of[x:y] > 0)) + x
                    if not len(use):
                        continue
                    at, weight = places[use], weights_of[use]
                    short, iterators = [], []
                    for a, b, w, t in zip((ends - df)[at].tolist(), ends[at].tolist(), weight.tolist(), at.tolist()):
                        if b - a <= max(1, len(n) // SHORT):
                            short.append((docs[a:b], w * damped(counts[a:b], norm[docs[a:b]])))
                        else:
                            bound = w * int(damped(most[t:t + 1], least_norm[t:t + 1])[0])
                            iterators.append((bound, docs[a:b], lambda p, a=a, w=w: w * damped(counts[a + p], norm[docs[a + p]])))
                    if short:
                        own, sums = accumulators(short)
                        iterators.append((int(sums.max()), own, sums.__getitem__))
                    rank_segment(iterators, found.setdefault(key, Best(k)), ids, missing)
        for (row, item), best in found.items():
            size = len(best.scores)
            yield pa.RecordBatch.from_arrays([
                pa.array([row] * size, pa.int64()), pa.array([item] * size, pa.int64()),
                pa.array(best.ids, mask=best.missing), pa.array(best.scores),
            ], names=["row", "item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = K, pack_terms: int = PACK_TERMS, sent_packs: int = SENT_PACKS) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's (item_id, text) ``k``
    documents with the highest scores above 0, equal ones by ascending doc_id
    (null last), ranks from 1.

    Rows with equal ids are items, or documents, of their own; a null or empty
    text has no terms and no results; no documents, no results.  A task holds
    a segment, a pack, and ``k`` places per item.
    """
    size = index.agg(F.sum("with_terms").alias("documents"), F.sum("all_terms").alias("terms")).first()
    documents, terms = size["documents"] or 0, size["terms"] or 0
    packs, n_packs = item_packs(index, items, documents, pack_terms)
    met = with_every_pack(index, packs, n_packs, sent_packs)
    best = few_bytes(met).select("doc_ids", "n_terms", "terms", "df", "docs", "counts", "most", "shortest", "items").mapInArrow(
        _searched(k, documents, terms), "row long, item_id long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
