"""Order-preserving packing of tokenised documents into fixed windows.

The ids of a task's documents form one stream in the order of its rows.  The
stream is cut into windows of at most ``size`` ids so that padding plus cut
penalties is least.  A window may end at a document's end (no penalty), at a
sentence's end (``SENTENCE``) or, in sentences longer than ``STRIDE`` ids, at
every ``STRIDE``-th id of them (``INSIDE``).  With f(j) the least cost of a
stream that ends at cut j,

    f(j) = penalty(j) + size - p(j) + min of f(i) + p(i) over p(j) - size <= p(i) < p(j)

and the minimum moves along a monotone queue, so the work is linear in the
number of cuts.  A window whose length is a power of two needs no padding.
The programme runs over ``STREAM`` ids at a time; the last windows of a run
are packed again with what follows, so a run's end is not a cut.
"""
from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textjobs.llm.columns import slices, small_batches
from textjobs.llm.tokens import encoder, with_end

SENTENCE, INSIDE, STRIDE, STREAM = 4, 16, 64, 1 << 20
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)
#: Sequences of one task; a task's ids stay in its own range.
TASK_RANGE = 1 << 36


def sentence_ends(path: str) -> np.ndarray:
    """For every id, whether its text ends a sentence: it holds a line feed or
    ends in ``.``, ``!`` or ``?``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    return np.array([t.rstrip(" ").endswith((".", "!", "?")) or "\n" in t for t in texts], bool)


def cuts(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions after which a window may end, their penalties), with a
    position at least every ``STRIDE`` ids; ``ends`` are document ends."""
    stride = min(STRIDE, size)
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[1:][is_end[ids]] = SENTENCE
    penalty[ends] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    edges = np.unique(np.concatenate(([0], at, [len(ids)])))
    gaps = (np.diff(edges) - 1) // stride
    if gaps.any():
        base = np.repeat(edges[:-1], gaps)
        k = np.arange(len(base)) - np.repeat(np.cumsum(gaps) - gaps, gaps) + 1
        penalty[base + stride * k] = INSIDE
    penalty[len(ids)] = min(penalty[len(ids)], INSIDE)
    at = np.flatnonzero(np.isfinite(penalty))
    return at[at > 0], penalty[at[at > 0]]


def padding(length: int, size: int) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def windows(positions: list[int], penalties: list[float], size: int) -> list[int]:
    """Ends of the cheapest windows over a stream that starts at 0 and ends at
    the last position, by a monotone queue."""
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # value f(i) + p(i), p(i), cut
    back: list[int] = []
    exact = {0: (0.0, -1)}
    for j, (p, pen) in enumerate(zip(positions, penalties)):
        while queue[0][1] < p - size:
            queue.popleft()
        value, _, via = queue[0]
        best = value + size - p
        low = p - size
        if low in exact and exact[low][0] < best:  # a full window
            best, via = exact[low]
        low = p - size // 2
        if low in exact and exact[low][0] < best:  # half a window, a power of two as well
            best, via = exact[low]
        best += pen
        back.append(via)
        exact[p] = (best, j)
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    out, j = [], len(positions) - 1
    while j >= 0:
        out.append(positions[j])
        j = back[j]
    return out[::-1]


def split_tail(length: int, size: int) -> list[int]:
    """Lengths for the last ids of a task: powers of two when that costs less
    than padding."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if INSIDE * (len(parts) - 1) < padding(length, size) else [length]


def packed(path: str, end_id: int, size: int, drop_space: bool = False, special_tokens: bool = False) -> Callable:
    """A map over batches (doc_id, text): one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, is_end = encoder(path, drop_space, special_tokens), sentence_ends(path)
        sequence = TaskContext.get().partitionId() * TASK_RANGE
        # the open stream: pieces of documents (doc_id, start in it, ids, its tokens)
        open_pieces: list[tuple[int | None, int, np.ndarray, int]] = []

        def emit(last: bool):
            nonlocal open_pieces, sequence
            ids = np.concatenate([x[2] for x in open_pieces])
            piece_ends = np.cumsum([len(x[2]) for x in open_pieces])
            doc_ends = piece_ends[[x[1] + len(x[2]) == x[3] for x in open_pieces]]
            at, pen = cuts(ids, doc_ends, is_end, size)
            stops = windows(at.tolist(), pen.tolist(), size)
            if last:
                low = stops[-2] if len(stops) > 1 else 0
                stops[-1:] = (low + np.cumsum(split_tail(len(ids) - low, size))).tolist()
            else:
                stops = stops[:-2]
            rows, begin, k, piece_start = [], 0, 0, 0
            for stop in stops:
                at_offset = 0
                while begin < stop:
                    doc, start, own, total = open_pieces[k]
                    end = min(stop, piece_start + len(own))
                    part = own[begin - piece_start:end - piece_start]
                    rows.append((doc, start + begin - piece_start, end - begin, zlib.crc32(part), total, sequence, at_offset))
                    at_offset += end - begin
                    begin = end
                    if end == piece_start + len(own):
                        k, piece_start = k + 1, end
                rows[-1] += (at_offset,)
                sequence += 1
            left = open_pieces[k:]
            if left:
                doc, start, own, total = left[0]
                left[0] = (doc, start + begin - piece_start, own[begin - piece_start:], total)
            open_pieces = left
            # the length of a sequence is known at its last piece
            length, lengths = 0, []
            for r in reversed(rows):
                length = r[7] if len(r) > 7 else length
                lengths.append(length)
            columns = list(zip(*(r[:7] for r in rows))) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in [*columns, lengths[::-1]]], names=[f.split()[0] for f in SCHEMA.split(", ")])

        held = 0
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                ids, before = with_end(*coder.encode(data, offsets), end_id)
                ids = ids.astype("<u4")
                doc_ids = batch.column("doc_id").slice(low, high - low).to_pylist()
                for doc, a, b in zip(doc_ids, before[:-1].tolist(), before[1:].tolist()):
                    open_pieces.append((doc, 0, ids[a:b], b - a))
                    held += b - a
                if held >= STREAM:
                    yield emit(last=False)
                    held = sum(len(x[2]) for x in open_pieces)
        if open_pieces:
            yield emit(last=True)

    return run


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, size: int = 1024, drop_space: bool = False, special_tokens: bool = False,
) -> DataFrame:
    """Packs ``docs`` (doc_id, text), each as its ids and ``end_id``, into
    sequences of at most ``size`` ids (a power of two): one row per piece, with
    the checksum of its ids, its place in its document and in its sequence, and
    the length of its sequence.

    No shuffle: a task packs its own rows in their order, with bounded memory
    (``STREAM`` ids, or one longer document).  A null or empty text is its end
    id; a table without rows gives no piece; equal rows are packed one by one;
    further columns are ignored.  ``special_tokens`` gives strings of added
    tokens their own ids.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    return small_batches(docs).select("doc_id", "text").mapInArrow(packed(path, end_id, size, drop_space, special_tokens), SCHEMA)
