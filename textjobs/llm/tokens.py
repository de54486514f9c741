"""Token ids of whole texts, and their storage in the fewest bits.

Ids come from a public tokenizer file.  Texts are cut where the tokenizer
cuts in any case (in front of white space that a word follows, between an
ASCII letter and punctuation), every distinct piece is encoded once by the
tokenizers library, and the ids of a text are those of its pieces in order.
The strings of the tokenizer's added tokens (``<|endoftext|>``) are ordinary
text, or with ``special_tokens`` one id each, as the library has it when
nothing is set; the text is then cut at them first.

File format (``write_ids``): a table of segments in Parquet, one row per
segment, with a binary image:

    magic "TIDS", version, bits, ids per block         4 x uint32
    documents, blocks                                  2 x uint32
    ids in the segment, ids of the shard before it     2 x uint64
    ids of each document                               documents x uint64
    byte offset of each block in the packed part       (blocks + 1) x uint64
    packed blocks, each from a byte of its own

An id takes ``bits`` bits, the fewest that hold the vocabulary; ids fill a
block from its lowest bit.  A block holds ``IDS_PER_BLOCK`` ids (the last one
fewer), so block ``i // IDS_PER_BLOCK`` has id ``i`` and is unpacked alone.
Documents ascend inside a segment, segments inside a shard, shards over the
corpus.
"""
from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textjobs.llm.columns import distinct, held, slices, small_batches, strings
from textjobs.sources.files import shared_dir

IDS_PER_BLOCK = 4096
SEGMENT_IDS = 1 << 20
MAGIC = 0x53444954
HEADER = 40

# Byte classes for the cuts.  A byte after which a cut may lie is no control
# byte, no DEL, no continuation byte and no lead byte of Unicode white space.
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_FOLLOWS = np.ones(256, bool)
_FOLLOWS[:0x21] = _FOLLOWS[0x7F:0xC0] = False
_FOLLOWS[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def added_tokens(path: str) -> re.Pattern | None:
    """What finds the strings of a tokenizer file's added tokens, the longest
    first; None when it has none."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that does not stand for its string alone")
    strings = sorted((t["content"].encode() for t in added), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, strings))) if strings else None


def special_spans(pattern: re.Pattern, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the added tokens' strings; none crosses a row."""
    raw, found = data.tobytes(), []
    if pattern.search(raw):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [m.span() for m in pattern.finditer(raw, a, b)]
    return np.array(found, np.int64).reshape(-1, 2)


def pieces(data: np.ndarray, offsets: np.ndarray, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, pieces before each row): pieces whose ids do not depend
    on what stands beside them.  Each of the spans ``special`` is a piece, and
    what stands between them is cut like rows."""
    cut = np.zeros(len(data), bool)
    if len(data):
        edges = offsets if special is None else np.union1d(offsets, special)
        cut[:-1] = _WS[data[:-1]] & _FOLLOWS[data[1:]]
        cut[edges[1:][edges[1:] > 0] - 1] = False  # white space that ends a row stays with what is before it
        cut[1:] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        for a, b in () if special is None else special.tolist():
            cut[a:b] = False
        cut[edges[edges < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class PieceEncoder:
    """Ids of pieces, with a table of the pieces that this worker has seen.
    The table is emptied when it holds ``max_pieces`` or ``max_ids``."""

    def __init__(self, path: str, drop_space: bool, max_pieces: int = 500_000, special_tokens: bool = False, max_ids: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        self.special = added_tokens(path) if special_tokens else None
        self.drop_space, self.max_pieces, self.max_ids = drop_space, max_pieces, max_ids
        self.clear()

    def clear(self) -> None:
        self.entries: dict[bytes, int] = {}
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.n_ids = 0

    def _add(self, own: list[bytes]) -> None:
        """Encodes distinct pieces."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in own], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        first = len(self.entries)
        self.start, self.length = _grown(self.start, first + len(ids)), _grown(self.length, first + len(ids))
        self.flat = _grown(self.flat, self.n_ids + len(flat))
        self.length[first:first + len(ids)] = lengths
        self.start[first:first + len(ids)] = self.n_ids + np.cumsum(lengths) - lengths
        self.flat[self.n_ids:self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.entries.update(zip(own, range(first, first + len(ids))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, ids before each row)."""
        if len(self.entries) > self.max_pieces or self.n_ids > self.max_ids:
            self.clear()
        starts, ends, first = pieces(data, offsets, self.special and special_spans(self.special, data, offsets))
        if self.drop_space:
            starts = starts + _WS[data[starts]]
        number, values = distinct(strings(data, starts, ends, pa.binary()))
        own = values.to_pylist()
        entry = np.fromiter(map(self.entries.get, own, itertools.repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = len(self.entries) + np.arange(len(new))
            self._add([own[i] for i in new.tolist()])
        entry = entry[number]
        lengths = self.length[entry].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(lengths)))
        narrow = np.int32 if max(self.n_ids, int(before[-1])) < 1 << 31 else np.int64
        where = np.repeat((self.start[entry] - before[:-1]).astype(narrow), lengths)
        where += np.arange(before[-1], dtype=narrow)
        return self.flat.take(where), before[first]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def encoder(path: str, drop_space: bool, special_tokens: bool = False) -> PieceEncoder:
    """The encoder of this worker process for a tokenizer file."""
    kept = held(f"tokens {path} {drop_space} {special_tokens}")
    if "encoder" not in kept:
        kept["encoder"] = PieceEncoder(path, drop_space, special_tokens=special_tokens)
    return kept["encoder"]


def with_end(ids: np.ndarray, before: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each row's."""
    return np.insert(ids, before[1:], end_id).astype(np.uint32), before + np.arange(len(before))


# Bit packing

def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, from the lowest bit of the first byte on.
    An id that does not fit is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits == 16:
        return packed[:2 * n].view("<u2").astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    wide = np.zeros(len(packed) + 8, np.uint8)
    wide[:len(packed)] = packed
    byte, value = at >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= wide[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def segment_image(ids: np.ndarray, lengths: np.ndarray, shard_start: int, bits: int) -> bytes:
    blocks = [pack(ids[i:i + IDS_PER_BLOCK], bits) for i in range(0, len(ids), IDS_PER_BLOCK)]
    at = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    return b"".join([
        np.array([MAGIC, 1, bits, IDS_PER_BLOCK, len(lengths), len(blocks)], "<u4").tobytes(),
        np.array([len(ids), shard_start], "<u8").tobytes(), lengths.astype("<u8").tobytes(), at.tobytes(), *blocks,
    ])


class Segment:
    """Reads a segment image; ``ids(i, j)`` unpacks only the blocks it needs."""

    def __init__(self, image: bytes):
        raw = np.frombuffer(image, np.uint8)
        magic, version, self.bits, self.per_block, documents, blocks = raw[:24].view("<u4").tolist()
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of token ids")
        self.n_ids, self.shard_start = raw[24:HEADER].view("<u8").tolist()
        end = HEADER + 8 * documents
        self.lengths = raw[HEADER:end].view("<u8").astype(np.int64)
        self.at = raw[end:end + 8 * (blocks + 1)].view("<u8").astype(np.int64)
        self.packed = raw[end + 8 * (blocks + 1):]

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.per_block, (end - 1) // self.per_block
        out = [
            unpack(self.packed[self.at[b]:self.at[b + 1]], min(self.per_block, self.n_ids - b * self.per_block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(out)[start - first * self.per_block:end - first * self.per_block]


def encoded(path: str, drop_space: bool, end_id: int, bits: int, special_tokens: bool = False) -> Callable:
    """A map over batches (bucket, doc_id, text): bucket, doc_id, number of ids, packed ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, drop_space, special_tokens)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                ids, before = with_end(*coder.encode(data, offsets), end_id)
                packed = [pack(ids[a:b], bits) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("bucket").slice(low, high - low), batch.column("doc_id").slice(low, high - low),
                    pa.array(np.diff(before)), pa.array(packed, pa.binary()),
                ], names=["bucket", "doc_id", "n", "packed"])

    return run


def segmented(bits: int) -> Callable:
    """A map over the sorted documents of one shard: its segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, ids, held, start, seq, bucket = [], [], [], 0, 0, 0, 0

        def flush():
            image = segment_image(np.concatenate(ids), np.array(lengths, np.int64), start, bits)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([bucket], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_ids": pa.array([held], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "image": pa.array([image], pa.binary()),
            })

        for batch in batches:
            for b, doc, n, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "packed"))):
                bucket = b
                doc_ids.append(doc)
                lengths.append(n)
                ids.append(unpack(np.frombuffer(packed, np.uint8), n, bits))
                held += n
                if held >= SEGMENT_IDS:
                    yield flush()
                    start, seq, held, doc_ids, lengths, ids = start + held, seq + 1, 0, [], [], []
        if doc_ids:
            yield flush()

    return run


def bucket_bounds(docs: DataFrame, key: str, buckets: int) -> list:
    """At most ``buckets - 1`` keys that cut a column into ranges of about
    equal numbers of rows, from one read of that column.  The list is bounded
    by ``buckets``, not by the data."""
    if buckets < 2:
        return []
    steps = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx(key, F.lit(steps), F.lit(20 * buckets)).alias("x")).first()["x"]
    return sorted(set(found or []))


def write_ids(
    docs: DataFrame, path: str, vocabulary: int, target: str, end_id: int = 1, drop_space: bool = False,
    shards: int | None = None, special_tokens: bool = False,
) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``target`` in the format
    above, in ascending doc_id (nulls first; equal doc_ids by their ids).

    A null or empty text has the end id alone; a table without rows gives no
    segment; further columns are ignored.  ``special_tokens`` gives strings of
    added tokens their own ids.  Only packed ids are shuffled, once, to shards
    that are cut by quantiles of doc_id.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = bits_for(vocabulary)
    bounds = bucket_bounds(docs.select("doc_id"), "doc_id", shards)
    bucket = F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    ids = small_batches(docs).select(bucket.cast("int").alias("bucket"), "doc_id", "text").mapInArrow(
        encoded(path, drop_space, end_id, bits, special_tokens), "bucket int, doc_id long, n long, packed binary")
    (
        ids.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "packed")
        .mapInArrow(segmented(bits), "shard int, seq int, n_ids long, doc_ids array<long>, image binary")
        .write.option("compression", "none").parquet(target)
    )


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """The segments of a written corpus."""
    return spark.read.schema("shard int, seq int, n_ids long, doc_ids array<long>, image binary").parquet(target)


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, before): the number of ids before each shard, from one row per shard."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, doc_ids, image in zip(*(batch.column(c) for c in ("shard", "doc_ids", "image"))):
            segment, doc_ids = Segment(image.as_py()), doc_ids.as_py()
            ends = np.cumsum(segment.lengths)
            starts = ends - segment.lengths
            ids = segment.ids(0, segment.n_ids).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([shard.as_py()] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()),
                pa.array(starts + segment.shard_start), pa.array(segment.lengths), pa.array(crc, pa.int64()),
            ], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def id_digests(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of every document, from the
    files.  Segments are read where they lie; only digests are joined."""
    segments = read_ids(spark, target)
    found = segments.mapInArrow(_digests, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(segments), "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file(
    docs: DataFrame, path: str, vocabulary: int, end_id: int = 1, drop_space: bool = False, special_tokens: bool = False,
) -> str:
    """Writes to a new folder in the shared folder; its path."""
    target = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary, target, end_id, drop_space, special_tokens=special_tokens)
    return target
