"""Exact top-k search by inner product over a bit-sliced index.

Components become whole numbers.  A block of rows keeps, for every dimension,
one bitmap per bit of (component - least component of the block).  The scores
of a whole block come from bitmap arithmetic: a query component adds the
slices of its dimension once per non-zero digit, shifted by the digit's place,
and carry-save adders reduce all bitmaps of a place to one.  The result is
bit-sliced too, and the top rows are picked from its most significant slice
downwards; rows that tie at the boundary are resolved by their ids.

Vectors with a component of ``WIDE`` or more do not fit slices of 64-bit
numbers.  They are blocks and packs of their own kind, and every score with one
of them is computed in whole numbers of any size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textjobs.llm.columns import stored
from textjobs.sources.files import save_and_reread

#: Rows of a block, queries of a pack: both bound what one task holds.
BLOCK_ROWS, PACK_ROWS = 16_384, 256
#: Products with the factor are exact as 64-bit numbers below this.
WIDE = 2.0 ** 60
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def usable_vectors(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, q): components as doubles.  Vectors that are null or hold a null
    or non-finite component take no part, nor do null ids."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.filter(usable & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), x.alias("q"))


def scaled(value: float, factor: int) -> int:
    """floor(factor * value), exactly, of a double."""
    n, d = value.as_integer_ratio()
    return factor * n // d


def _matrices(batches: Iterator[pa.RecordBatch], factor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of a task as (ids ascending, whole-numbered matrix), one per
    dimension for 64-bit numbers and one for numbers of any size."""
    ids: dict[tuple, list] = {}
    rows: dict[tuple, list] = {}
    for batch in batches:
        column = batch.column("q")
        sizes = np.diff(column.offsets.to_numpy())
        flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        own = batch.column("id").to_numpy()
        for d in np.unique(sizes).tolist():
            k = np.flatnonzero(sizes == d)
            q = flat[at[k][:, None] + np.arange(d)].reshape(len(k), d)
            wide = (np.abs(q) >= WIDE / factor).any(axis=1)
            for kind, part in ((False, ~wide), (True, wide)):
                if part.any():
                    ids.setdefault((d, kind), []).append(own[k[part]])
                    rows.setdefault((d, kind), []).append(
                        np.array([[scaled(v, factor) for v in r] for r in q[part].tolist()], object).reshape(-1, d) if kind
                        else np.floor(q[part] * factor).astype(np.int64))
    for d in ids:
        own, q = np.concatenate(ids[d]), np.concatenate(rows[d])
        order = np.argsort(own, kind="stable")
        yield own[order], q[order]


def _texts(q: np.ndarray) -> list[list[str]] | None:
    """The numbers of a matrix of any size, None for one of 64 bits."""
    return [[str(v) for v in r] for r in q.tolist()] if q.dtype == object else None


def bit_slices(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, number of slices) of every dimension, and the bitmaps
    [slice, word], dimension by dimension from the lowest bit."""
    low = q.min(axis=0, initial=LONG_MAX) if q.shape[1] == 0 else q.min(axis=0)
    u = (q - low).astype(np.uint64)
    width = np.array([int(m).bit_length() for m in u.max(axis=0)])
    words = -(-len(q) // 64)
    planes = []
    for j, w in enumerate(width.tolist()):
        for s in range(w):
            bits = np.zeros(64 * words, np.uint8)
            bits[:len(q)] = (u[:, j] >> np.uint64(s)) & np.uint64(1)
            planes.append(np.packbits(bits, bitorder="little").view("<u8"))
    return low, width, np.array(planes, "<u8").reshape(-1, words)


_WIDE_ROWS = pa.list_(pa.list_(pa.string()))


def _block(factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for ids, q in _matrices(batches, factor):
            low, width, planes = bit_slices(q if q.dtype != object else np.zeros((1, 0), np.int64))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([TaskContext.get().partitionId()], pa.int32()), "dim": pa.array([q.shape[1]], pa.int32()),
                "ids": [ids.astype("<i8").tobytes()], "low": [low.astype("<i8").tobytes()],
                "width": [width.astype("<i4").tobytes()], "planes": [planes.tobytes()], "wide": pa.array([_texts(q)], _WIDE_ROWS),
            })

    return run


def _pack(factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for ids, q in _matrices(batches, factor):
            yield pa.RecordBatch.from_pydict({
                "pack": pa.array([TaskContext.get().partitionId()], pa.int32()), "dim": pa.array([q.shape[1]], pa.int32()),
                "query_ids": [ids.astype("<i8").tobytes()],
                "queries": [q.astype("<i8").tobytes() if q.dtype != object else b""], "wide_queries": pa.array([_texts(q)], _WIDE_ROWS),
            })

    return run


def digits(value: int) -> list[tuple[int, int]]:
    """The non-adjacent form of a number: (place, +1 or -1), fewest non-zero digits."""
    out, place = [], 0
    while value:
        if value & 1:
            d = 2 - (value & 3)
            out.append((place, d))
            value -= d
        value >>= 1
        place += 1
    return out


class BitSlicedBlock:
    """One block of the index: scores of a query as slices, and its top rows."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, width: np.ndarray, planes: np.ndarray):
        self.ids, self.low, self.width, self.planes = ids, low.tolist(), width.tolist(), planes
        self.inverse = ~planes
        self.first = (np.cumsum(width) - width).tolist()
        self.every = np.packbits(np.arange(64 * planes.shape[1]) < len(ids), bitorder="little").view("<u8")

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """(slices from the lowest, constant): score = slices' value + constant."""
        columns: list[list[np.ndarray]] = []
        constant = 0
        for q, low, width, first in zip(query, self.low, self.width, self.first):
            constant += q * low
            for place, sign in digits(q):
                # -u is (inverse of u) - (2^width - 1)
                constant -= 0 if sign > 0 else ((1 << width) - 1) << place
                source = self.planes if sign > 0 else self.inverse
                while len(columns) < place + width:
                    columns.append([])
                for s in range(width):
                    columns[place + s].append(source[first + s])
        out, k = [], 0
        while k < len(columns):
            column = columns[k]
            if len(column) > 1 and k + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                carry = a & b
                carry |= half & c
                half ^= c
                column.insert(0, half)
                columns[k + 1].append(carry)
            if len(column) == 2:
                a, b = column
                columns[k + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.every))
            k += 1
        return out, constant

    def top(self, query_id: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to the smaller id."""
        found, constant = self.scores(query)
        sure, even = np.zeros_like(self.every), self.every.copy()
        for row in range(*np.searchsorted(self.ids, [query_id, query_id + 1]).tolist()):
            even[row >> 6] &= ~np.uint64(1 << (row & 63))
        for plane in reversed(found):
            ones = even & plane
            both = sure | ones
            n = int(np.bitwise_count(both).sum())
            if n > k:
                even = ones
            else:
                sure, even = both, even & ~plane
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        tied = np.flatnonzero(np.unpackbits(even.view(np.uint8), bitorder="little"))[:k - len(rows)]
        rows = np.concatenate([rows, tied])
        fits = len(found) < 62 and abs(constant) < 1 << 62
        value = np.full(len(rows), constant, np.int64 if fits else object)
        for place, plane in enumerate(found):
            bit = ((plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(value.dtype)
            value += bit * (1 << place)
        return self.ids[rows], value if fits else in_64_bits(value)

    def rows(self) -> np.ndarray:
        """The whole-numbered vectors, from the slices."""
        out = np.zeros((len(self.ids), len(self.width)), np.int64)
        for j, (low, width, first) in enumerate(zip(self.low, self.width, self.first)):
            for s in range(width):
                out[:, j] += np.unpackbits(self.planes[first + s].view(np.uint8), count=len(self.ids), bitorder="little").astype(np.int64) << s
            out[:, j] += low
        return out


def in_64_bits(value: np.ndarray) -> np.ndarray:
    """Whole numbers of any size; those beyond 64 bits become the nearest."""
    return np.array([min(max(int(v), LONG_MIN), LONG_MAX) for v in value], np.int64)


def top_exactly(ids: np.ndarray, q: np.ndarray, query_id: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``BitSlicedBlock.top`` gives, from the numbers themselves."""
    scores = [sum(map(int.__mul__, row, query)) for row in q.astype(object).tolist()]
    best = sorted((i for i, own in enumerate(ids.tolist()) if own != query_id), key=lambda i: -scores[i])[:k]  # ids ascend, the sort is stable
    return ids[best], in_64_bits(np.array([scores[i] for i in best], object))


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, dim, wide, wide_queries, *parts in zip(*(batch.column(c) for c in (
                    "pack", "dim", "wide", "wide_queries", "ids", "low", "width", "planes", "query_ids", "queries"))):
                dim, wide, wide_queries = dim.as_py(), wide.as_py(), wide_queries.as_py()
                ids, low, width, planes, query_ids, queries = (
                    np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<i8", "<i8", "<i4", "<u8", "<i8", "<i8")))
                exact = wide is not None or wide_queries is not None
                if wide is None:
                    block = BitSlicedBlock(ids, low, width, planes.reshape(-1, -(-len(ids) // 64)))
                    numbers = block.rows() if exact else None
                else:
                    numbers = np.array([[int(v) for v in r] for r in wide], object).reshape(len(ids), dim)
                asked = queries.reshape(len(query_ids), dim).tolist() if wide_queries is None else [[int(v) for v in r] for r in wide_queries]
                out: list[list[np.ndarray]] = [[], [], [], []]
                for n, (query_id, query) in enumerate(zip(query_ids.tolist(), asked)):
                    rows, scores = top_exactly(ids, numbers, query_id, query, k) if exact else block.top(query_id, query, k)
                    for column, x in zip(out, (np.full(len(rows), query_id), np.full(len(rows), (pack.as_py() << 32) + (n << 1) + (wide_queries is not None)), rows, scores)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "row", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``is_query`` (over
    ``id``) the k rows with the largest inner product of whole-numbered
    components, ties to the smaller id; fewer if there are fewer.

    A row with the query's id is no candidate; repeated candidates count one by
    one, and a repeated query row gives its rows again.  Vectors of another
    length are never compared.  Blocks and packs are bounded, every pack meets
    every block in a task of its own key, and a task returns k rows a query.
    An empty table, or one without queries, gives no row.  Components are
    taken as doubles, and ``factor`` times one is rounded down exactly.  Any
    finite component takes part; a score beyond 64 bits is given as the nearest
    64-bit number.
    """
    spark = vectors.sparkSession
    rows = save_and_reread(usable_vectors(vectors, id_column, vector), "vectors")
    queries = rows.filter(is_query)
    blocks, packs = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-queries.count() // PACK_ROWS))
    index = stored(rows.repartition(blocks).mapInArrow(
        _block(factor), "block int, dim int, ids binary, low binary, width binary, planes binary, wide array<array<string>>"), "bit-slices")
    asked = stored(queries.repartition(packs).mapInArrow(
        _pack(factor), "pack int, dim int, query_ids binary, queries binary, wide_queries array<array<string>>"), "queries")
    pairs = index.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(
        asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["block", "pack", "dim"])
    found = pairs.select("pack", "dim", "ids", "low", "width", "planes", "wide", "query_ids", "queries", "wide_queries").mapInArrow(
        _searched(k), "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
