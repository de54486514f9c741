"""Secrets in whole texts, found by one automaton for all rules."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textjobs.llm.automaton import compile_rules, leftmost, scan
from textjobs.llm.columns import code_points, held, slices, small_batches

SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches end in a run of one class of characters.  A
    match counts when its group has ``least`` characters; a shorter one is
    dropped, but its characters are used up."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def finder(rules: tuple[Rule, ...]) -> Callable:
    """A map over one slice: for every row, its spans (kind, start, end) in
    bytes, by start and then by the order of the rules."""
    whole = compile_rules([r.pattern for r in rules])
    back = [compile_rules([r.pattern], anchored=True, back=True) for r in rules]
    exact = [re.compile(r.pattern.encode()) for r in rules]

    def find(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        at, mask = scan(whole, data, offsets)
        found: dict[int, list[tuple[int, int, int]]] = {}
        if not len(at):
            return found
        raw = data.tobytes()
        for k, rule in enumerate(rules):
            own = at[mask >> k & 1 == 1]
            rows = np.searchsorted(offsets, own, "right") - 1
            ends = np.ones(len(own), bool)  # a match ends where the next byte would not go on with it
            ends[:-1] = (np.diff(own) > 1) | (np.diff(rows) > 0)
            row_before, used = -1, 0
            for row, end in zip(rows[ends].tolist(), (own[ends] + 1).tolist()):
                if row != row_before:
                    row_before, used = row, int(offsets[row])
                start = leftmost(back[k], raw, used, end)
                if start < 0:
                    continue
                used = end
                match = exact[k].fullmatch(raw, start, end)
                if match and match.end(rule.group) - match.start(rule.group) >= rule.least:
                    found.setdefault(row, []).append((start - int(offsets[row]), k, end - int(offsets[row])))
        return {row: [(k, s, e) for s, k, e in sorted(spans)] for row, spans in found.items()}

    return find


def find_secrets(docs: DataFrame, text: str = "text", out: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with an array of (kind, start, end) in code points, end
    exclusive, by start and then by the order of ``rules``; matches of a kind
    do not overlap.  Null and empty texts have no span.  Every row is looked at
    alone, so repeated rows get equal spans; a column ``out`` is replaced.
    """
    find = finder(rules)
    docs = small_batches(docs.drop(out))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("secrets")
        for batch in batches:
            spans: list[list[dict]] = []
            for low, high, data, offsets in slices(batch.column(batch.schema.get_field_index(text))):
                rows: list[list[dict]] = [[] for _ in range(high - low)]
                for row, found in find(data, offsets).items():
                    points = code_points(data[offsets[row]:offsets[row + 1]], np.array([x[1:] for x in found]))
                    rows[row] = [
                        {"kind": rules[k].kind, "start": s, "end": e}
                        for (k, _, _), (s, e) in zip(found, points.tolist())
                    ]
                spans += rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replaces every span by its kind in brackets; of spans that overlap, the
    later ones go with the first.  Texts without spans are left as they are,
    null included."""
    folded = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(
                acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")),
            ).alias("done"), s["end"].alias("at"))),
    )
    done = docs.withColumn("_folded", folded)
    return done.withColumn(text, F.when(F.size(spans) > 0, F.concat(
        F.col("_folded.done"), F.substr(F.col(text), (F.col("_folded.at") + 1).cast("int"), F.length(text)))).otherwise(F.col(text))
    ).drop("_folded")
