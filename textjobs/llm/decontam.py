"""Benchmark passages in training documents, by a positional inverted index.

``build_index`` stores, for segments of documents, the positions of every
word: one row per segment with its distinct words, the list of ascending
positions of each, and its documents.  Positions run through a segment with a
gap between documents, so no match crosses one.

``search`` takes the test texts in packs of bounded size, a stored table that
meets the segments by key.  For every window of a pack it starts from the rarest word's list in a segment, shifts it to
the window's start, and intersects it with the lists of the other words from
rare to frequent; ``slack`` positions of tolerance make it a proximity match.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textjobs.llm.columns import SENT_PACKS, distinct, held, slices, small_batches, stored, strings, with_every_pack, words

WINDOW = 10
#: Words of test texts in one pack, about.
PACK_WORDS = 100_000
#: Places that are intersected at a time.
CANDIDATES = 100_000
#: Bytes of text in a segment of the index.
SEGMENT = 1 << 20
#: Positions between two documents of a segment; windows are shorter.
GAP = 1024
INDEX_SCHEMA = (
    "segment string, doc_ids array<long>, first binary, n_words binary, terms array<string>, ends binary, postings binary"
)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a task's documents: as many rows as make up ``SEGMENT`` bytes of text."""
    held("decontam")
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text"), SEGMENT):
            text, starts, ends, before = words(data, offsets)
            counts = np.diff(before)
            first = before[:-1] + GAP * np.arange(len(counts))
            position = np.arange(len(starts)) + GAP * np.repeat(np.arange(len(counts)), counts)
            number, terms = distinct(strings(text, starts, ends))
            order = np.argsort(number, kind="stable")
            yield pa.RecordBatch.from_pydict({
                "segment": [uuid.uuid4().hex], "doc_ids": [batch.column("doc_id").slice(low, high - low)],
                "first": [first.astype("<i8").tobytes()], "n_words": [counts.astype("<i8").tobytes()],
                "terms": [terms], "ends": [np.cumsum(np.bincount(number, minlength=len(terms))).astype("<u4").tobytes()],
                "postings": [position[order].astype("<u4").tobytes()],
            }, schema=pa.schema([
                ("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.binary()), ("n_words", pa.binary()),
                ("terms", pa.list_(pa.string())), ("ends", pa.binary()), ("postings", pa.binary()),
            ]))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of every word of ``docs`` (doc_id, text), written
    to the shared folder.  No shuffle.  A null or empty text has no words; an
    empty table gives an index without segments."""
    return stored(small_batches(docs).select("doc_id", "text").mapInArrow(_indexed, INDEX_SCHEMA), "positional-index")


def _test_words(window: int, most: int) -> Callable:
    """Texts of test items as chunks of words; a long item is several chunks
    that share ``window - 1`` words, so every window is in one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                text, starts, ends, before = words(data, offsets)
                every = strings(text, starts, ends)
                own, chunks = [], []
                for item, a, b in zip(batch.column("item_id").slice(low, high - low).to_pylist(), before[:-1].tolist(), before[1:].tolist()):
                    for at in range(a, max(b - window + 1, a + 1) if b > a else a, most - window):
                        own.append(item)
                        chunks.append(every[at:min(b, at + most - 1)].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(chunks, pa.list_(pa.string()))], names=["item_id", "words"])

    return run


def test_packs(items: DataFrame, window: int, pack_words: int) -> tuple[DataFrame, int]:
    """(pack, chunks): the test items in packs of about ``pack_words`` words,
    written to the shared folder, and the number of packs."""
    chunks = stored(
        small_batches(items).select("item_id", "text").mapInArrow(_test_words(window, pack_words), "item_id long, words array<string>")
        .withColumn("row", F.monotonically_increasing_id()), "test-words")
    total = chunks.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    packs = max(1, -(-total // pack_words))
    pack = F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int")
    return stored(chunks.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct("item_id", "words")).alias("chunks")), "test-packs"), packs


class Windows:
    """The distinct windows of a pack: words[w, k] (index into ``terms``, -1
    behind a short item) and the items of every window."""

    def __init__(self, items: list[int | None], chunks: pa.ListArray, window: int):
        flat, self.terms = distinct(chunks.flatten())
        lengths = pc.list_value_length(chunks).to_numpy()
        starts = np.cumsum(lengths) - lengths
        n = np.maximum(lengths - window + 1, 1)
        at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.repeat(np.minimum(lengths, window), n)
        k = np.arange(window)
        grid = np.where(k < size[:, None], flat[np.minimum(at[:, None] + k, len(flat) - 1)], -1)
        self.words, back = np.unique(grid, axis=0, return_inverse=True)
        owner = np.unique(np.column_stack([back.ravel(), np.repeat(np.arange(len(items)), n)]), axis=0)
        self.size = (self.words >= 0).sum(axis=1)
        self.item_of, self.items = owner[:, 1], items
        self.item_at = np.searchsorted(owner[:, 0], np.arange(len(self.words) + 1))


def phrase_matches(
    wins: Windows, terms: pa.Array, ends: np.ndarray, postings: np.ndarray, slack: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of all matches in one segment."""
    at = pc.fill_null(pc.index_in(wins.terms, terms), -1).to_numpy().astype(np.int64)
    known = at >= 0
    high = np.where(known, ends[at], 0).astype(np.int64)
    low = np.where(known & (at > 0), ends[np.maximum(at, 1) - 1], 0).astype(np.int64)
    count = np.append(np.where(known, high - low, 0), np.iinfo(np.int64).max)  # -1: behind a short item
    lists = count[wins.words]
    live = np.flatnonzero((lists > 0).all(axis=1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the lists of the words used, one after the other, as word * 2^32 + position
    used = np.unique(wins.words[live])
    used = used[used >= 0]
    sizes = high[used] - low[used]
    where = np.repeat(low[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    keys = (np.repeat(used, sizes) << 32) + postings[where].astype(np.int64)
    begin = np.searchsorted(keys, used << 32)
    start_of = np.zeros(len(wins.terms), np.int64)
    start_of[used] = begin

    rank = np.argsort(lists[live], axis=1, kind="stable")
    rare = rank[:, 0]
    first = wins.words[live, rare]
    load = np.cumsum(count[first])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(live):  # as many windows as start from CANDIDATES places, or one
        top = max(low + 1, int(np.searchsorted(load, (load[low - 1] if low else 0) + CANDIDATES, "right")))
        n = count[first[low:top]]
        who = low + np.repeat(np.arange(top - low), n)
        entry = np.repeat(start_of[first[low:top]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pos = (keys[entry] & 0xFFFFFFFF) - rare[who]
        who, pos = who[pos >= 0], pos[pos >= 0]
        for r in range(1, wins.words.shape[1]):
            k = rank[who, r]
            word = wins.words[live[who], k]
            ask = (word << 32) + np.maximum(pos + k - slack, 0)
            found = np.searchsorted(keys, ask)
            ok = found < len(keys)
            ok[ok] = keys[found[ok]] <= (word[ok] << 32) + pos[ok] + k[ok] + slack
            ok |= word < 0
            who, pos = who[ok], pos[ok]
        out.append((live[who], pos))
        low = top
    return np.concatenate([w for w, _ in out]), np.concatenate([p for _, p in out])


def _found(window: int, slack: int) -> Callable:
    """A map over segments with packs: the documents with matches of the pack,
    with their covered words (merged intervals) and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("decontam")
        for batch in batches:
            out: dict[str, list] = {"segment": [], "row": [], "intervals": [], "items": []}
            for segment, pack, chunks, terms, *parts in zip(*(batch.column(c) for c in (
                    "segment", "pack", "chunks", "terms", "first", "n_words", "ends", "postings"))):
                segment, terms = segment.as_py(), terms.values
                first, n_words, ends, postings = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<i8", "<i8", "<u4", "<u4")))
                if not len(terms):
                    continue
                own = ((pack.as_py(), window), chunks.values)
                if known.get("pack") is None or known["pack"][0] != own[0] or not known["pack"][1].equals(own[1]):
                    known["pack"] = own
                    known["windows"] = Windows(own[1].field("item_id").to_pylist(), own[1].field("words"), window)
                wins = known["windows"]
                who, pos = phrase_matches(wins, terms, ends, postings, slack)
                if not len(who):
                    continue
                rows = np.searchsorted(first, pos, "right") - 1
                order = np.lexsort((pos, rows))
                who, pos, rows = who[order], pos[order], rows[order]
                begin = pos - first[rows]
                end = np.minimum(begin + wins.size[who], n_words[rows])
                edges = np.flatnonzero(np.diff(rows, prepend=-1))
                for a, b in zip(edges.tolist(), np.append(edges[1:], len(rows)).tolist()):
                    own = np.unique(who[a:b])
                    items = {wins.items[i] for w in own.tolist() for i in wins.item_of[wins.item_at[w]:wins.item_at[w + 1]].tolist()}
                    out["segment"].append(segment)
                    out["row"].append(int(rows[a]))
                    out["intervals"].append(merged(begin[a:b], end[a:b]).astype("<i8").tobytes())
                    out["items"].append(sorted(items, key=lambda x: (x is not None, x)))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("segment", pa.string()), ("row", pa.int32()), ("intervals", pa.binary()), ("items", pa.list_(pa.int64()))]))

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of intervals as rows (begin, end)."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return np.column_stack([begin[at], reach[np.append(at[1:], len(begin)) - 1]])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, unions = [], []
        for parts in batch.column("parts").to_pylist():
            spans = [np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts]
            spans = [s for s in spans if len(s)]
            own = merged(*np.concatenate(spans).T) if spans else np.zeros((0, 2), np.int64)
            hits.append(int((own[:, 1] - own[:, 0]).sum()))
            unions.append([{"start": a, "end": b} for a, b in own.tolist()])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()),
            pa.array(unions, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column("items"),
        ], names=["doc_id", "n_words", "n_hit", "intervals", "items"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, doc_ids, n in zip(*(batch.column(c) for c in ("segment", "doc_ids", "n_words"))):
            n = np.frombuffer(n.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([
                pa.array([segment.as_py()] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)),
                doc_ids.values.cast(pa.int64()), pa.array(n),
            ], names=["segment", "row", "doc_id", "n_words"])


def search(
    index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0, pack_words: int = PACK_WORDS, sent_packs: int = SENT_PACKS,
) -> DataFrame:
    """Every indexed document with its words, covered words, covered intervals
    (in words, end exclusive) and the items that have a window in it.

    A window is ``window`` words in a row of an item (item_id, text); an item
    with fewer words, but not none, is one window; null and empty items have
    none.  ``slack`` allows every word that many positions around its place.
    Every segment meets every pack of test texts in a task; repeated documents
    and items count one by one.
    """
    if not 0 < window < GAP // 2 or not 0 <= slack < GAP // 4 or pack_words <= 2 * window:
        raise ValueError("window, slack or size of a pack out of range")
    docs = index.select("segment", "doc_ids", "n_words").mapInArrow(_documents, "segment string, row int, doc_id long, n_words long")
    rows = docs.select("*", F.lit(None).cast("binary").alias("intervals"), F.lit(None).cast("array<long>").alias("items"))
    packs, n_packs = test_packs(items, window, pack_words)
    met = with_every_pack(index.drop("doc_ids"), packs, n_packs, sent_packs)
    found = met.select("segment", "pack", "chunks", "terms", "first", "n_words", "ends", "postings").mapInArrow(
        _found(window, slack), "segment string, row int, intervals binary, items array<long>")
    rows = rows.unionByName(found.select(
        "segment", "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "intervals", "items"))
    per_doc = rows.groupBy("segment", "row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.collect_list("intervals").alias("parts"),  # one per pack at most
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return per_doc.select("doc_id", "n_words", "parts", "items").mapInArrow(
        _united, "doc_id long, n_words long, n_hit long, intervals array<struct<start: long, end: long>>, items array<long>")
