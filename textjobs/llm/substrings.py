"""Removal of long repeated byte strings by prefix doubling over sampled positions.

A suffix array sorts every position; here the positions are sampled so that
equal strings have equal samples: the anchor of a start is the position, among
the ``WINDOW`` positions from the start on, with the least hash of its next
``GRAM`` bytes (the last one on a tie).  It depends on nothing behind the first
``WINDOW + GRAM - 1`` bytes of the ``length`` bytes that begin at the start, so
two equal strings have their anchors at the same offset, and every start
belongs to one anchor.

Anchors are ranked by growing prefixes.  The first rank stands for the next
``unit`` bytes.  A round then sorts the pairs (rank of a prefix, name of the
bytes as long again behind it) over the whole table, and equal neighbours in
that order get one new rank, for a prefix twice as long; an anchor whose rank
is unique goes.  This ends past ``core``, the bytes that all strings of an
anchor have in common behind it (rounds 1 to 3: core / 4, core / 2, core).
Then

4. anchors that are left get a rank of all bytes of all their strings as well:
   where it repeats, every start of the anchor repeats.  Where only the core
   does, at the edges of repeats, an anchor is open.  Open anchors mark their
   core's rank, and the others of such a rank learn that they are needed;
5. the starts of open anchors, and of one needed anchor of every kind in a
   chunk, are ranked by the pair (rank of the core, name of their ``length``
   bytes).

Spark sorts; a task reads its sorted pairs once, holding one row.  A chunk of
documents sends a pair once, however often it holds it, with a mark if more
than once, so a string that is everywhere costs a row per chunk.  What comes
back are the places with a repeated pair and their new ranks.  Texts are stored
once, in a table bucketed by chunk, so that ranks travel to the texts; what was
sent is found again from text and ranks instead of being stored.  Names are
hashes of 64 bits where they only prune or stand beside a rank, and of 128 bits
where they decide alone.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textjobs.llm.columns import BASE, BASE2, held, mix, slices, small_batches, span_hashes
from textjobs.sources.files import shared_dir

LENGTH, WINDOW, GRAM = 400, 128, 16
#: Bytes of text in a chunk and at a time when anchors are found.
CHUNK, PART = 1 << 22, 1 << 18

#: Gaps between spans that are hashed along; the longest prefix read in words, and starts at a time.
GAP, SHORT, STARTS = 64, 1024, 1 << 14

#: Bits of the second half of a pair that tell its partition.
SPREAD = 0x78
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PAIRS = "chunk long, place int, a long, b long, mark boolean"
_DONE = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of all runs of starts of one anchor, in order."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n)
    half = np.ndarray((n + GRAM // 2,), "<u8", np.ascontiguousarray(data), strides=(1,))  # eight bytes from every place on
    gram = mix(half[:n] * np.uint64(BASE) ^ mix(half[GRAM // 2:] + np.uint64(BASE2)))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    reach = 1
    while reach < window:  # least of the next `reach` positions
        step = min(reach, window - reach)
        least[:n - step] = np.minimum(least[:n - step], least[step:])
        reach += step
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    start = np.repeat(offsets[:-1] - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    anchor = (np.uint64(0xFFFFFFFF) - (least[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], start[first], start[last[:len(first)]]


def covered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of ascending spans with only the bytes that they
    cover and small gaps, if that is much less than ``data``."""
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1] + GAP))
    low, high = starts[new], reach[np.append(new[1:], len(starts)) - 1]
    sizes = high - low
    if not len(starts) or sizes.sum() > 0.7 * len(data):
        return data, starts, ends
    back = np.repeat(low - (np.cumsum(sizes) - sizes), np.diff(np.append(new, len(starts))))
    return np.concatenate([data[a:b] for a, b in zip(low.tolist(), high.tolist())]), starts - back, ends - back


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: bool = False, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of spans as one column of 64 bits, or two; starts need not
    ascend.  The cost follows the bytes that the spans cover."""
    order = np.argsort(starts, kind="stable")
    spans = covered(data, starts[order], ends[order]) if len(starts) else (data, starts, ends)
    out = np.zeros((len(starts), 2), np.uint64)
    for k, base in enumerate((BASE, BASE2)[:1 + wide]):
        out[order, k] = span_hashes(*spans, base)
        out[:, k] = mix(out[:, k] + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def prefix_names(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from every start on.  Short ones are read in
    words of eight bytes: the cost follows the starts, however long the text."""
    if not 8 <= size <= SHORT or not len(starts):
        return names(data, starts, starts + size)[:, 0]
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.full(len(starts), size, np.uint64)
    for i in range(0, len(starts), STARTS):
        at, name = starts[i:i + STARTS], out[i:i + STARTS]
        for k in (*range(0, size - 8, 8), size - 8):  # the last word may overlap the one before
            name = mix((name ^ word[at + k]) + np.uint64(BASE))
        out[i:i + STARTS] = name
    return out


def grouped(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every pair among the distinct ones in ascending order, an index of each)."""
    a, b = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    order = np.argsort(b)
    order = order[np.argsort(a[order], kind="stable")]
    a, b = a[order], b[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(pairs), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order[new]


def sent(chunk: int, pairs: np.ndarray, marked: np.ndarray | None = None) -> pa.RecordBatch:
    """The distinct pairs of a chunk by place, marked where they occur here
    more than once, or where ``marked`` says so."""
    place, one = grouped(pairs)
    n = len(one)
    marks = np.bincount(place, minlength=n) > 1 if marked is None else np.bincount(place, marked, minlength=n) > 0
    own = pairs[one].view(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(marks),
    ], names=["chunk", "place", "a", "b", "mark"])


def _ranked(only_marks: bool) -> Callable:
    """A map over sorted pairs, marked ones first among equals: the places of
    pairs that occur more than once, or are marked, and a number per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        columns = ("a", "b", "chunk", "place")
        wait = np.zeros((0, 5), np.int64)  # the last row so far, if it may yet be found again
        last: tuple[int, int, bool] | None = None  # the last pair, and whether it repeats
        for batch in batches:
            rows = np.column_stack([*(batch.column(c).to_numpy() for c in columns), batch.column("mark").to_numpy(zero_copy_only=False)])
            rows = np.concatenate([wait, rows])
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            group = np.cumsum(new) - 1
            many = np.bincount(group, rows[:, 4]) > 0
            if not only_marks:
                many |= np.bincount(group) > 1
            goes_on = last is not None and (rows[0, 0], rows[0, 1]) == last[:2]
            if goes_on:
                many[0] |= last[2]
            number += 0 if goes_on else 1
            rank = number + group
            number = int(rank[-1])
            last = (rows[-1, 0], rows[-1, 1], bool(many[-1]))
            # a row alone at the end waits: only the next batch tells whether it repeats
            open_end = not many[-1] and not only_marks
            wait = rows[-1:] if open_end else rows[:0]
            out = many[group]
            if open_end:
                last, number = None, number - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[out, 2]), pa.array(rows[out, 3].astype(np.int32)), pa.array(rank[out])], names=["chunk", "place", "rank"])

    return run


def ranked(pairs: DataFrame, buckets: int, with_ranks: bool, only_marks: bool) -> DataFrame:
    """(chunk, places, ranks): for every chunk the places of its pairs that
    repeat anywhere, with the new rank of each (or none), bucketed by chunk.
    Pairs of one rank go to up to sixteen partitions."""
    ordered = pairs.repartition("a", F.col("b").bitwiseAND(SPREAD)).sortWithinPartitions("a", "b", F.desc("mark"))
    found = ordered.mapInArrow(_ranked(only_marks), "chunk long, place int, rank long")
    if with_ranks:
        per_chunk = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "rank"))).alias("f")).select(
            "chunk", F.col("f.place").alias("places"), F.col("f.rank").alias("ranks"))
    else:
        per_chunk = found.groupBy("chunk").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumn(
            "ranks", F.lit(None).cast("array<long>"))
    return bucketed(per_chunk, "ranks", buckets)


def bucketed(df: DataFrame, purpose: str, buckets: int) -> DataFrame:
    """Writes a table bucketed by chunk to the shared folder and reads it: joins
    by chunk do not shuffle it.  The catalogue only names it meanwhile."""
    name = f"{purpose}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", shared_dir(df.sparkSession, purpose)).bucketBy(buckets, "chunk").saveAsTable(name)
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files of an external table stay
    return table


_TEXTS = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("packed", pa.binary()),
          ("anchor", pa.binary()), ("first", pa.binary()), ("last", pa.binary())]
TEXTS = "chunk long, doc_ids array<long>, offsets binary, packed binary, anchor binary, first binary, last binary"


def _u4(a: np.ndarray) -> bytes:
    return a.astype("<u4").tobytes()


def chunked(length: int, window: int, most: int = CHUNK) -> Callable:
    """A map over (doc_id, text): chunks of texts with their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held("substrings")
        seq = TaskContext.get().partitionId() << 24
        waiting: list[tuple] = []

        def flush():
            nonlocal waiting, seq
            doc_ids = [x for ids, *_ in waiting for x in ids]
            base = np.cumsum([0] + [len(d) for _, d, _, _ in waiting]).tolist()
            data = np.concatenate([d for _, d, _, _ in waiting])
            offsets = np.concatenate([[0]] + [o[1:] + b for (_, _, o, _), b in zip(waiting, base)])
            anchor, first, last = (np.concatenate([s[i] + b for (_, _, _, s), b in zip(waiting, base)]) for i in range(3))
            waiting, seq = [], seq + 1
            values = (seq - 1, doc_ids, offsets.astype("<i8").tobytes(), pa.compress(data.tobytes(), codec="zstd", asbytes=True),
                      _u4(anchor - first), _u4(np.diff(first, prepend=0)), _u4(last - first))  # differences compress well
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _TEXTS)], names=[n for n, _ in _TEXTS])

        size = 0
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), min(PART, most)):
                if waiting and size + len(data) > most:
                    yield flush()
                    size = 0
                waiting.append((batch.column("doc_id").slice(low, high - low).to_pylist(), data.copy(), offsets.copy(), anchors(data, offsets, length, window)))
                size += len(data)
        if waiting:
            yield flush()

    return run


class Chunk:
    """A chunk of texts, and what the rounds so far have made of its anchors.
    ``found[k]`` holds (places, ranks) that round k + 1 gave back."""

    def __init__(self, row: dict, length: int, window: int, found: list[tuple[np.ndarray, np.ndarray]]):
        self.number, self.doc_ids, self.length, self.window = row["chunk"], row["doc_ids"], length, window
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        size = int(self.offsets[-1])
        self.data = np.frombuffer(pa.decompress(row["packed"], decompressed_size=size, codec="zstd") if size else b"", np.uint8)
        anchor, first, last = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("anchor", "first", "last"))
        self.first = np.cumsum(first)
        self.anchor, self.last = anchor + self.first, last + self.first
        self.found = found

    def keep(self, which: np.ndarray) -> None:
        self.anchor, self.first, self.last = self.anchor[which], self.first[which], self.last[which]

    def reranked(self, pairs: np.ndarray, k: int) -> np.ndarray:
        """The ranks of round ``k`` + 1 of the anchors that sent ``pairs``; those without one go."""
        places, ranks = self.found[k]
        place, _ = grouped(pairs)
        at = np.searchsorted(places, place)
        alive = at < len(places)
        alive[alive] = places[at[alive]] == place[alive]
        self.keep(alive)
        return ranks[at[alive]].astype(np.uint64)

    def prefix_pairs(self, rounds: int) -> np.ndarray:
        """What the anchors that are left after ``rounds`` rounds send: (rank
        of the prefix, name of the bytes behind it up to twice its length)."""
        core = self.length - self.window + 1
        unit = -(-core // 4)
        name = prefix_names(self.data, self.anchor, unit)
        pairs = np.column_stack([name, np.zeros_like(name)])
        for k in range(rounds):
            rank = self.reranked(pairs, k)
            done = unit << k
            pairs = np.column_stack([rank, prefix_names(self.data, self.anchor + done, min(2 * done, core) - done)])
        return pairs

    def core_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """After three rounds: ranks of the anchors' cores, and names of all
        bytes of all their strings (with where they lie to the anchor)."""
        rank = self.reranked(self.prefix_pairs(2), 2)
        shape = (self.anchor - self.first) * self.window + self.last - self.first
        return rank, names(self.data, self.first, self.last + self.length, True, 2 + shape)

    def sure(self, whole: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of every anchor's name, whether it repeats)."""
        place, _ = grouped(whole)
        return place, np.isin(place, self.found[k][0])

    def edge_starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After rounds 1 to 5: (starts to be ranked, what they send, first and
        last starts of the anchors of which every start repeats)."""
        rank, whole = self.core_ranks()
        kind, sure = self.sure(whole, 3)
        place, _ = grouped(np.column_stack([rank, np.zeros_like(rank)]))
        needed = np.flatnonzero(sure & np.isin(place, self.found[4][0]))
        needed = needed[np.unique(kind[needed], return_index=True)[1]]  # equal strings once
        ask = np.concatenate([np.flatnonzero(~sure), needed])
        sizes = (self.last - self.first + 1)[ask]
        start = np.repeat(self.first[ask] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        name = names(self.data, start, start + self.length)[:, 0] & ~np.uint64(127)
        beside = (np.repeat(self.anchor[ask], sizes) - start).astype(np.uint64) & np.uint64(127)  # equal for equal strings
        return start, np.column_stack([np.repeat(rank[ask], sizes), name | beside]), self.first[sure], self.last[sure]


def _chunks(batches: Iterator[pa.RecordBatch], length: int, window: int, rounds: int) -> Iterator[Chunk]:
    """Chunks one at a time: their columns are large."""
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n, _ in _TEXTS}
            found = []
            for k in range(rounds):
                places, ranks = batch.column(f"places{k}")[i], batch.column(f"ranks{k}")[i]
                found.append((places.values.to_numpy(), ranks.values.to_numpy() if ranks.is_valid else None) if places.is_valid else nothing)
            yield Chunk(row, length, window, found)


def sends(length: int, window: int, rounds: int) -> Callable:
    """A map over chunks with the ranks of ``rounds`` rounds: what they send in the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings")
        for c in _chunks(batches, length, window, rounds):
            if rounds < 3:
                yield sent(c.number, c.prefix_pairs(rounds))
            elif rounds == 3:
                yield sent(c.number, c.core_ranks()[1])
            elif rounds == 4:
                rank, whole = c.core_ranks()
                yield sent(c.number, np.column_stack([rank, np.zeros_like(rank)]), ~c.sure(whole, 3)[1])
            else:
                yield sent(c.number, c.edge_starts()[1])

    return run


def runs(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs that spans cover, in order; no
    span crosses a row, and runs of two rows stay apart where they touch."""
    order = np.argsort(starts)
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    row = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > reach[:-1]) | (row[1:] != row[:-1])
    new = np.flatnonzero(new)
    return starts[new], reach[np.append(new[1:], len(starts)) - 1] if len(new) else reach, row[new]


def removed(length: int, window: int) -> Callable:
    """A map over chunks with all ranks: the results of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings")
        for c in _chunks(batches, length, window, 6):
            start, pairs, first, last = c.edge_starts()
            place, _ = grouped(pairs)
            again = start[np.isin(place, c.found[5][0])]
            data, offsets = c.data, c.offsets
            low, high, owner = runs(np.concatenate([first, again]), np.concatenate([last, again]) + length, offsets)
            ends = np.searchsorted(owner, np.arange(len(c.doc_ids)), "right").tolist()
            low, high, begin, rows = low.tolist(), high.tolist(), 0, []
            for doc, a, b, end in zip(c.doc_ids, offsets[:-1].tolist(), offsets[1:].tolist(), ends):
                kept, at, lost = hashlib.sha256(), a, 0
                for k in range(begin, end):
                    kept.update(data[at:low[k]])
                    at = high[k]
                    lost += at - low[k]
                kept.update(data[at:b])
                rows.append((doc, b - a, lost, end - begin, kept.hexdigest()))
                begin = end
            columns = list(zip(*rows)) or [[]] * len(_DONE)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _DONE)], names=[n for n, _ in _DONE])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its UTF-8 bytes, how many of
    them lie in a string of ``length`` bytes that also starts anywhere else
    (same text included; strings are judged on the input and never cross
    texts), in how many maximal runs, and the SHA-256 of the rest.

    A null text is empty; shorter texts lose nothing; repeated rows are texts
    like others and lose what they share; an empty table gives an empty one.
    A task holds a chunk of ``chunk`` bytes, or one longer text, and what it sends.
    """
    if window + GRAM - 1 > length or window < 2:
        raise ValueError("window does not fit the length")
    docs = small_batches(docs).select("doc_id", "text")
    # as many as the ranks' partitions, so that neither side of a join moves
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(docs.mapInArrow(chunked(length, window, chunk), TEXTS), "texts", buckets)
    known = texts
    for rounds in range(6):
        pairs = known.mapInArrow(sends(length, window, rounds), PAIRS)
        own = ranked(pairs, buckets, rounds < 3, rounds == 4).select(
            "chunk", F.col("places").alias(f"places{rounds}"), F.col("ranks").alias(f"ranks{rounds}"))
        known = known.join(own.hint("shuffle_hash"), "chunk", "left")  # rows of megabytes are not sorted
    return known.mapInArrow(removed(length, window), RESULT)
