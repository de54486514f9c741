"""Periodic runs of words in whole texts, by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(LEAST, EXPONENT * q)`` that no neighbouring word extends.

At scale B = 1, 2, 4, ... the words are cut into blocks of B.  Periods q with
B <= q < 2B are found there: as a run is at least four periods long, it holds
a whole block that occurs again q words later.  For every block the sums of
squared differences between it and all words of the window behind it,

    D(q) = sum (x[i] - x[i + q])^2 = sum x[i]^2 + sum x[i + q]^2 - 2 sum x[i] x[i + q],

come from one cyclic convolution of length 2B, a number-theoretic transform
modulo primes whose product is above any possible D: D is 0 in all of them
only if every word is equal.  The distances found seed extensions to both
sides, word by word.

Two exact tests spare convolutions.  A block whose four-word strings do not all
start again within the window cannot occur in it.  And a block whose whole
window lies in a run that is known from a smaller scale cannot belong to a run
of a longer smallest period (two periods that both fit their sum have their
greatest common divisor as a period).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from textjobs.llm.columns import held, slices, small_batches

LEAST, EXPONENT = 6, 4
#: Numbers in the blocks and windows that are transformed at a time.
CELLS = 1 << 19
#: Primes with roots of unity of order 2^26, and a primitive root of each (fixed values).
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
GRAM = 4

RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Transform:
    """Cyclic convolutions of length ``n`` (a power of two) modulo one prime.
    The transform leaves its values in bit-reversed order, which products keep
    and the inverse undoes."""

    def __init__(self, n: int, prime: int, root: int):
        self.n, self.prime = n, np.uint64(prime)
        self.powers, self.inverse = {}, {}
        m = n
        while m > 1:
            for table, w in ((self.powers, pow(root, (prime - 1) // m, prime)), (self.inverse, pow(root, -(prime - 1) // m, prime))):
                powers = np.ones(m // 2, np.uint64)
                have = 1
                while have < m // 2:
                    powers[have:2 * have] = powers[:have] * np.uint64(pow(w, have, prime)) % self.prime
                    have *= 2
                table[m] = powers
            m //= 2
        self.scale = np.uint64(pow(n, -1, prime))

    def forward(self, a: np.ndarray) -> np.ndarray:
        m = self.n
        while m > 1:
            v = a.reshape(-1, self.n // m, 2, m // 2)
            out = np.empty_like(v)
            total = v[:, :, 0] + v[:, :, 1]
            out[:, :, 0] = np.where(total >= self.prime, total - self.prime, total)
            out[:, :, 1] = (v[:, :, 0] + (self.prime - v[:, :, 1])) * self.powers[m] % self.prime
            a, m = out, m // 2
        return a.reshape(-1, self.n)

    def backward(self, a: np.ndarray) -> np.ndarray:
        m = 2
        while m <= self.n:
            v = a.reshape(-1, self.n // m, 2, m // 2)
            out = np.empty_like(v)
            far = v[:, :, 1] * self.inverse[m] % self.prime
            for half, total in enumerate((v[:, :, 0] + far, v[:, :, 0] + (self.prime - far))):
                out[:, :, half] = np.where(total >= self.prime, total - self.prime, total)
            a, m = out, m * 2
        return a.reshape(-1, self.n) * self.scale % self.prime


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For rows of ``B`` numbers and of ``2 B`` numbers, where (row, offset
    below B) the block equals the window from that offset on."""
    size = blocks.shape[1]
    bound = size * (int(max(blocks.max(initial=0), windows.max(initial=0))) + 1) ** 2
    equal, product = np.ones(blocks.shape, bool), 1
    for prime, root in PRIMES:
        if product > bound:
            break
        product *= prime
        p = np.uint64(prime)
        transform = Transform(2 * size, prime, root)
        x, y = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        wide = np.zeros(y.shape, np.uint64)
        wide[:, :size] = x[:, ::-1]
        both = transform.backward(transform.forward(wide) * transform.forward(y) % p)[:, size - 1:2 * size - 1]
        own = (x * x % p).sum(axis=1, dtype=np.uint64) % p
        total = np.zeros((len(y), 2 * size + 1), np.uint64)
        np.cumsum(y * y % p, axis=1, out=total[:, 1:])
        other = (total[:, size:2 * size] - total[:, :size]) % p
        equal &= (own[:, None] + other) % p == both * np.uint64(2) % p
    if product <= bound:
        raise ValueError("a text of more distinct words than the primes cover")
    return equal


def _again(ids: np.ndarray) -> np.ndarray:
    """Distance from every place to the next one with the same number."""
    out = np.full(len(ids), np.iinfo(np.int64).max)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _grams(ids: np.ndarray) -> np.ndarray:
    """Numbers of the four-word strings at every place but the last three."""
    for step in (1, 2):
        pair = ids[:-step] * (int(ids.max(initial=0)) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return ids


def _worst(again: np.ndarray, size: int, upto: int) -> np.ndarray:
    """The largest distance in the first ``upto`` places of every whole block."""
    whole = len(again) // size
    return again[:whole * size].reshape(whole, size)[:, :upto].max(axis=1, initial=0)


def _extent(x: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, size: int) -> np.ndarray:
    """How many places from ``at`` on, going by ``step``, agree with the place a period later."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    k = np.arange(size)
    while len(live):
        rows = max(1, CELLS // size)
        more = []
        for i in range(0, len(live), rows):
            part = live[i:i + rows]
            place = at[part, None] + step * (out[part, None] + k)
            other = place + period[part, None]
            inside = (place >= 0) & (other < len(x))
            same = inside & (x[np.where(inside, place, 0)] == x[np.where(inside, other, 0)])
            n = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
            out[part] += n
            more.append(part[n == size])
        live = np.concatenate(more)
    return out


def runs(x: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of numbers, by start
    and then period.  The exponent is 4 or more."""
    n = len(x)
    found = np.zeros((0, 3), np.int64)
    if n < least:
        return found
    x = x.astype(np.int64)
    words, grams = _again(x), _again(_grams(x)) if n >= GRAM else np.zeros(0, np.int64)
    grams = np.append(grams, np.zeros(n - len(grams), np.int64))
    padded = np.append(x, int(x.max(initial=0)) + 1)
    size = 1
    while exponent * size <= max(n, least):
        worst = _worst(words, size, size)
        if size >= 2 * GRAM:
            worst = np.maximum(worst, _worst(grams, size, size - GRAM + 1))
        block = np.flatnonzero(worst < 2 * size)
        if len(found):  # runs are known by start; `reach` is how far those up to one go
            reach = np.maximum.accumulate(found[:, 1])
            before = np.searchsorted(found[:, 0], block * size, "right") - 1
            block = block[(before < 0) | (reach[before] < block * size + 3 * size)]
        where, period = [], []
        rows = max(1, CELLS // (2 * size))
        for i in range(0, len(block), rows):
            part = block[i:i + rows]
            own = x[part[:, None] * size + np.arange(size)]
            windows = padded[np.minimum(part[:, None] * size + size + np.arange(2 * size), n)]
            row, offset = np.nonzero(zero_mismatches(own, windows))
            where.append(part[row])
            period.append(size + offset)
        if where:
            where, period = np.concatenate(where), np.concatenate(period)
            order = np.lexsort((where, period))
            where, period = where[order], period[order]
            new = np.ones(len(where), bool)  # blocks side by side with one period are one seed
            new[1:] = (np.diff(where) != 1) | (np.diff(period) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(where)) - 1
            low, high, period = where[first] * size, (where[last[:len(first)]] + 1) * size, period[first]
            low = low - _extent(x, low - 1, period, -1, size)
            high = high + _extent(x, high, period, 1, size) + period
            keep = high - low >= np.maximum(least, exponent * period)
            found = np.concatenate([found, np.column_stack([low, high, period])[keep]])
            # a stretch found again under a multiple of its period is no run of its own
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            one = np.ones(len(found), bool)
            one[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
            found = found[one]
        size *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def text_runs(texts: list[bytes], least: int, exponent: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """(words, runs) of every text; words that differ have different numbers."""
    words = [t.split() for t in texts]  # of bytes: at the six ASCII white-space characters
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    # one sequence with a number of its own behind every text, so that no run crosses
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(len(ids) + len(words), np.int64)
    ends = starts + sizes
    x[ends] = len(flat.dictionary) + np.arange(len(words))
    inner = np.ones(len(x), bool)
    inner[ends] = False
    x[inner] = ids
    all_runs = runs(x, least, exponent)
    cut = np.searchsorted(all_runs[:, 0], np.append(starts, len(x)))
    return words, [all_runs[a:b] - [s, s, 0] for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), starts.tolist())]


def collapse(words: list[bytes], own: np.ndarray) -> bytes:
    """The words without those behind the first period of any run, joined by spaces."""
    if len(own):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, own[:, 0] + own[:, 2], 1)
        np.add.at(change, own[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(
    docs: DataFrame, text: str = "text", runs_out: str = "runs", collapsed_out: str = "collapsed",
    least: int = LEAST, exponent: int = EXPONENT,
) -> DataFrame:
    """``docs`` with all runs of words of a text (start, length, period in
    words, by start and then period), and the text with every run cut down to
    its first period.

    Words are what ASCII white space separates; they are compared exactly.  A
    null, empty or blank text has no run and an empty collapsed text; repeated
    rows get equal results; columns with the names of the results are
    replaced.  A task holds a slice of 2 MB, or one longer text.
    """
    if exponent < EXPONENT or least < 1:
        raise ValueError("runs are of four periods or more")
    docs = small_batches(docs.drop(runs_out, collapsed_out))
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_out, RUN), T.StructField(collapsed_out, T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("periods")
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(batch.schema.get_field_index(text))):
                raw = data.tobytes()
                words, found = text_runs([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], least, exponent)
                flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
                at = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                structs = pa.StructArray.from_arrays(
                    [pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], ["start", "length", "period"])
                collapsed = pa.array([collapse(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, high - low).columns, pa.ListArray.from_arrays(pa.array(at), structs).cast(kind), collapsed],
                    names=[*batch.schema.names, runs_out, collapsed_out])

    return docs.mapInArrow(run, schema)
