"""Streams that keep little per key and write only what is new."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textjobs.operators.score import score_batches
from textjobs.sources.files import shared_dir
from textjobs.streaming.jobs import gathered, milliseconds, run_batches

#: Keyed state with maps and lists needs this store; ``run_batches`` takes it as a setting of the query.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

PIECE_SCHEMA = "gen_id BIGINT, first_chunk INT, n_chunks INT, text STRING, status STRING"
Piece = Row("gen_id", "first_chunk", "n_chunks", "text", "status")


class Pieces(StatefulProcessor):
    """Places the chunks of one generation; holds those with a gap in front."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "n INT, last BIGINT, ends ARRAY<INT>")
        self.runs = handle.getMapState("runs", "first INT", "text STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        stored = self.place.get()
        if stored is None:
            self.handle.registerTimer(now + self.wait)
        n, _, ends = stored or (0, now, [])
        held = dict(zip(ends[::2], ends[1::2]))  # first chunk: last chunk
        came: dict[int, str] = {}
        for seq, chunk in ((s, c or "") for row in rows for s, c in zip(row["seqs"], row["chunks"])):
            if seq is None or seq < 0:
                yield Piece(key[0], seq, 1, chunk, "unplaced")
            elif seq >= n and not any(a <= seq <= b for a, b in held.items()):
                came[seq] = min(came.get(seq, chunk), chunk)
        first, parts = n, []
        while n in came or n in held:
            if n in came:
                parts.append(came.pop(n))
                n += 1
            else:
                parts.append(self.runs.getValue((n,))[0])
                self.runs.removeKey((n,))
                n = held.pop(n) + 1
        for _, run in groupby(enumerate(sorted(came)), lambda x: x[1] - x[0]):
            seqs = [s for _, s in run]
            held[seqs[0]] = seqs[-1]
            self.runs.updateValue((seqs[0],), ("".join(came[s] for s in seqs),))
        self.place.update((n, now, [x for pair in held.items() for x in pair]))
        if parts:
            yield Piece(key[0], first, n - first, "".join(parts), "placed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last, ends = self.place.get()
        if last + self.wait > timerValues.getCurrentProcessingTimeInMs():  # chunks came since the timer was set
            self.handle.registerTimer(last + self.wait)
            return
        yield Piece(key[0], n, 0, "", "incomplete" if ends else "ended")
        for first, last in sorted(zip(ends[::2], ends[1::2])):
            yield Piece(key[0], first, last - first + 1, self.runs.getValue((first,))[0], "unplaced")
        self.place.clear()
        self.runs.clear()

    def close(self) -> None:
        pass


def accumulate_pieces(chunks: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The text of each generation as it grows, for append mode: a trigger
    gives only the piece that it added, so what is written is as long as the
    texts, however many triggers they take.

    A piece has the number of its first chunk, how many chunks it holds, and
    status ``placed``.  State is the number of placed chunks and the chunks
    that came before a missing one; it ends when none has come for ``idle``:
    with a row ``ended``, or ``incomplete`` and the held chunks as rows
    ``unplaced``.  Chunks with no number, or one below zero, are ``unplaced``
    at once.  A repeated chunk counts once: that of the first trigger, within a
    trigger the first by text.  A null chunk is empty; null is a generation too.
    """
    return gathered(chunks).groupBy("gen_id").transformWithState(
        Pieces(milliseconds(idle)), T.StructType.fromDDL(PIECE_SCHEMA), "Append", "ProcessingTime")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Whole texts of placed pieces; a text is bounded by its generator's limit."""
    ordered = F.array_sort(F.collect_list(F.struct("first_chunk", "text", "n_chunks")))
    return pieces.where(F.col("status") == "placed").groupBy("gen_id").agg(ordered.alias("_p")).select(
        "gen_id", F.aggregate("_p", F.lit(0), lambda n, p: n + p["n_chunks"]).alias("n_chunks"),
        F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))


class Recent(StatefulProcessor):
    """The last entries of one session, consecutive repeats dropped."""

    def __init__(self, session: list[str], entry: T.StructType, order: list[str], name: str, n: int, ttl: int):
        self.session, self.entry, self.order, self.name, self.n, self.ttl = session, entry, order, name, n, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.entry, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        columns = self.entry.names
        before = [tuple(r) for r in self.kept.get()]
        at = columns.index(self.name)
        places = [columns.index(o) for o in self.order]
        came = sorted((tuple(row[c] for c in columns) for row in rows), key=lambda r: [(r[i] is not None, r[i]) for i in places])
        kept = before
        for row in came:
            if not kept or kept[-1][at] != row[at]:
                kept = [*kept[-self.n + 1:], row] if self.n > 1 else [row]
        if kept != before:
            self.kept.put(kept)
            entry = Row(*columns)
            yield Row(*self.session, "entries")(*key, [entry(*r) for r in reversed(kept)])

    def close(self) -> None:
        pass


def history_changes(stream: DataFrame, session: list[str], order: list[str], name: str, keep: list[str], n: int = 5,
                    steps: str | None = None, ttl: str = "30 days") -> DataFrame:
    """Recent history per session as keyed state: a trigger gives one row for
    every session whose history it changed, ``entries`` newest first, and
    touches no other session.

    State is at most ``n`` entries (order, name, ``keep``) a session and is
    dropped ``ttl`` after the session's last change.  Entries need a name and,
    with ``steps``, a step.  Triggers must follow the order; inside one the
    rows of a session are put in order, in memory: ``maxFilesPerTrigger`` of
    the source bounds them.  A null order comes first.
    """
    known = stream.where(F.col(name).isNotNull() & (F.col(name) != ""))
    if steps:
        known = known.where(F.size(F.coalesce(steps, F.array().cast(known.schema[steps].dataType))) > 0)
    columns = list(dict.fromkeys([*order, name, *keep]))
    entry = known.select(*columns).schema
    entry = T.StructType([T.StructField(f.name, f.dataType) for f in entry])
    out = T.StructType([*known.select(*session).schema, T.StructField("entries", T.ArrayType(entry))])
    return known.select(*dict.fromkeys([*session, *columns])).groupBy(*session).transformWithState(
        Recent(session, entry, order, name, n, milliseconds(ttl)), out, "Update", "ProcessingTime")


def latest_histories(changes: DataFrame, session: list[str], version: str = "batch") -> DataFrame:
    """One row per entry of each session's last change, with its position."""
    last = changes.groupBy(*session).agg(F.max_by("entries", version).alias("_e"))
    return last.select(*session, F.posexplode("_e").alias("_i", "_r")).select(
        *session, (F.col("_i") + 1).alias("position"), *[F.col(f"_r.{f}").alias(f) for f in _entry_fields(changes) if f not in session])


def _entry_fields(changes: DataFrame) -> list[str]:
    return changes.schema["entries"].dataType.elementType.names


def measured_traces(generations: DataFrame, measure: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows with the columns that ``measure`` gives, in batches; a row on which
    it raises has nulls there and what was raised in ``error``."""
    return score_batches(generations, measure, schema, {f.name: None for f in T.StructType.fromDDL(schema)})


def log_traces(traces: DataFrame, root: str | None = None) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Runs a stream of traces into a log that cannot stop it.

    Rows go to ``kind=log``, those with an ``error`` to ``kind=dead``, in one
    pass and in a folder per batch.  A batch that cannot be written is left
    out (the writer moves its files in place at the end only), named with its
    failure in the second result, and the next one runs.  Returns what is
    stored, with ``batch`` and ``kind``.
    """
    spark = traces.sparkSession
    root = root or shared_dir(spark, "traces")
    failed: list[tuple[int, str]] = []

    def store(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("error").isNull(), "log").otherwise("dead")
        try:
            batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{root}/data/batch={number}")
        except (PySparkException, Py4JJavaError) as e:  # a log is no reason to stop the generations
            failed.append((number, f"{type(e).__name__}: {e}"[:500]))

    run_batches(traces, store, f"{root}/checkpoint")
    stored = T.StructType([*traces.schema, T.StructField("batch", T.IntegerType()), T.StructField("kind", T.StringType())])
    try:
        return spark.read.schema(stored).parquet(f"{root}/data"), failed
    except AnalysisException as e:  # nothing written
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored), failed
