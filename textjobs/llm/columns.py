"""Text columns as byte arrays: slices of Arrow batches, span hashes, words.

Tasks see a batch of texts as one array of UTF-8 bytes with row offsets, so
that whole texts are worked on by array operations instead of row by row.
"""
from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textjobs.sources.files import shared_dir

#: Bytes of text worked on at once (a longer text is a slice of its own), and
#: of these, bytes hashed at once.
SLICE, BLOCK = 1 << 21, 1 << 18
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
#: The two largest primes below 2^31 (fixed values).
SPAN_PRIMES = (2147483647, 2147483629)

BATCH_ROWS, _BATCH_KEY, _BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

BATCH_BYTES, _BYTES_KEY, _BYTES_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after making Arrow batches of its session smaller: ten thousand
    whole texts are more than a task needs in memory at once.  A session that
    has set its own batch size keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


def few_bytes(df: DataFrame) -> DataFrame:
    """``df``, after making Arrow batches of its session smaller in bytes, for
    rows that are blobs: a batch ends behind the row that reaches the limit.
    A session that has set its own limit keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES_KEY, _BYTES_DEFAULT) == _BYTES_DEFAULT:
        conf.set(_BYTES_KEY, BATCH_BYTES)
    return df


def stored(df: DataFrame, purpose: str, group: int | None = None) -> DataFrame:
    """Writes a stage whose rows are large blobs to the shared folder and reads
    it.  The default codec works in buffers outside the heap that are as large
    as a page, and a page of blobs is large; zstd does not.

    ``group``: bytes of a row group, about, looked at from the first row on.
    A writer by itself looks after a hundred rows, and a reader takes all rows
    of a group at once: without it, both hold a whole file of blobs."""
    path = shared_dir(df.sparkSession, purpose)
    write = df.write.option("compression", "zstd")
    if group is not None:
        write = write.options(**{"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100})
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Packs of a bounded size that may be sent to every task together.
SENT_PACKS = 4


def with_every_pack(segments: DataFrame, packs: DataFrame, n_packs: int, sent_packs: int = SENT_PACKS) -> DataFrame:
    """Every row of ``segments`` (with a column ``segment`` of its own) with
    every row of ``packs`` (with ``pack`` from 0 to ``n_packs`` - 1, each of a
    bounded size).  Few packs are sent to all tasks; more are met by key, each
    at some places, so that the segments spread."""
    every = segments.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    if n_packs <= sent_packs:
        return every.join(F.broadcast(packs), "pack")
    places = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = packs.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    place = F.pmod(F.xxhash64("segment"), F.lit(places)).cast("int")
    return every.withColumn("place", place).join(copies, ["pack", "place"]).drop("place")


_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What a worker process keeps from task to task, for one operator at a
    time: when another one's task begins, it goes back to the system."""
    if operator not in _held:
        _held.clear()
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _held[operator] = {}
    return _held[operator]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most
    ``limit`` bytes, or of one longer row."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int, base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo ``prime``, ``n`` or more."""
    have = _powers.get((base, prime))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        tables = []
        for b in (base, pow(base, -1, prime)):
            a = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                a[done:done + step] = a[:step] * np.uint64(pow(b, done, prime)) % np.uint64(prime)
                done += step
            tables.append(a)
        have = (tables[0], tables[1])
        if n <= BLOCK + 4096:  # tables for one very long text are not kept
            _powers[base, prime] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes: polynomials
    modulo two primes, mixed with the length.  Starts ascend; spans may
    overlap.  Memory follows the longest span or ``BLOCK``."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + BLOCK)))
        high = max(low, int(ends[i:j].max()))
        s, e = starts[i:j] - low, ends[i:j] - low
        block = data[low:high].astype(np.uint64) + np.uint64(1)
        value = (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for shift, prime in zip((0, 32), SPAN_PRIMES):
            p = np.uint64(prime)
            power, inverse = _power_tables(high - low + 1, base % prime, prime)
            total = np.zeros(high - low + 1, np.uint64)
            if high - low <= 1 << 23:  # sums of numbers below 2^40 fit
                np.cumsum(block * power[:high - low], out=total[1:])
            else:
                np.cumsum(block * power[:high - low] % p, out=total[1:])
            value ^= ((total[e] - total[s]) % p * inverse[s] % p) << np.uint64(shift)
        out[i:j] = value
        i = j
    return mix(out)


# Words: A-Z in lower case, then runs of digits, a-z and bytes over 0x7F

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words before each row).
    A word never crosses a row; the last array has one entry more than rows."""
    low = LOWER[data]
    inside = IS_WORD[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return low, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """data[start:end] of all spans as an Arrow array; spans do not overlap."""
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)))
    flat = data[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])]
    wide = at[-1] >= 1 << 31
    kind = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}[kind] if wide else kind
    at = at.astype(np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def distinct(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of every value, the values by number); values are compared whole."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def strong_hashes(column: pa.Array) -> np.ndarray:
    """64 bits of a cryptographic digest of every value, taken once per distinct one."""
    number, values = distinct(column)
    raw = b"".join(hashlib.blake2b(v, digest_size=8).digest() for v in values.cast(pa.binary() if values.type != pa.large_string() else pa.large_binary()).to_pylist())
    return np.frombuffer(raw, "<u8")[number]


def code_points(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points before each byte position of one text."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[positions]
