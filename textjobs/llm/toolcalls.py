"""Tool calls linked to their results, in an order that respects dependencies.

Calls and results meet in a hash join by (conversation, identifier), calls and
the calls they depend on in another.  A call that only depends on earlier calls
keeps its own place.  Calls that depend on later ones, and what depends on
them, are found per connected component: a component of up to ``IN_TASK``
dependencies is ordered in one task; a larger one is peeled off level by level
over all tasks.  What cannot be ordered is in a cycle or behind one.  Places are numbered over the whole table at once, by ranges of the
sort key, so a conversation of any length is spread over tasks.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textjobs.llm.graph import components
from textjobs.sources.files import save_and_reread

#: Dependencies of a component that one task orders.
IN_TASK = 100_000
#: Bytes of all schemas together; they travel with the task.
MAX_SCHEMA_BYTES = 1 << 20
_TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None),
}
_KEYWORDS = {
    "type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength",
}
#: Digits of a whole number in arguments.
MAX_DIGITS = 4300
_HALF = re.compile("[\ud800-\udfff]")
#: Keywords that say nothing of a value.
_NOTES = {"$schema", "$comment", "title", "description", "default", "examples"}


def check_schema(schema: Any, path: str = "$") -> None:
    """Raises on what ``schema_errors`` cannot check."""
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: only an object can be a schema here")
    if unknown := sorted(set(schema) - _KEYWORDS - _NOTES):
        raise ValueError(f"{path}: schema keywords not supported: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if unknown := [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in _TYPES]:
        raise ValueError(f"{path}: types not supported: {', '.join(map(str, unknown))}")
    for k, s in schema.get("properties", {}).items():
        check_schema(s, f"{path}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{path}[]")
    if not isinstance(extra := schema.get("additionalProperties", True), bool):
        check_schema(extra, f"{path}.*")


def schema_errors(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What keeps a value from following a schema (type, enum, required,
    properties, additionalProperties, items, minimum, maximum, minLength,
    maxLength), in a fixed order."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        right = any(
            isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
        if not right:
            return [f"{path}: not of type {'/'.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{path}: not in enum")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        errors += [f"{path}: missing {k}" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in properties:
                errors += schema_errors(value[k], properties[k], f"{path}.{k}")
            elif (extra := schema.get("additionalProperties", True)) is False:
                errors.append(f"{path}: unexpected {k}")
            elif isinstance(extra, dict):
                errors += schema_errors(value[k], extra, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        errors += [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], f"{path}[{i}]")]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        errors += [f"{path}: under minimum"] * (value < schema.get("minimum", value))
        errors += [f"{path}: over maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        errors += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0))
        errors += [f"{path}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    return errors


def canonical(value: Any) -> str:
    """JSON with sorted keys, no white space, characters as they are; half of
    a surrogate pair, which no text can hold, stays the escape it was."""
    return _written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _written(text: str) -> str:
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _reject(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


class _OutOfRange(ValueError):
    """A number of JSON that no number here stands for."""


def _float(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise _OutOfRange
    return value


def _int(text: str) -> int:
    if len(text) > MAX_DIGITS:
        raise _OutOfRange
    return int(text)


def _checked(schemas: dict[str, dict]):
    def one(call_id, name, arguments, result) -> tuple[str | None, str | None]:
        try:
            parsed = json.loads(
                arguments if arguments is not None else "{}", parse_constant=_reject, parse_float=_float, parse_int=_int)
            errors = schema_errors(parsed, schemas[name]) if name in schemas else ["unknown tool"]
            text = canonical({"arguments": parsed, "id": call_id, "name": name, "result": result})
        except _OutOfRange:
            return "arguments hold a number out of range", None
        except RecursionError:
            return "arguments are nested too deep", None
        except ValueError:
            return "arguments are not JSON", None
        return "; ".join(map(_written, errors)) or None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result")))]
            errors, texts = zip(*pairs) if pairs else ((), ())
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("arguments", "result", "name")]
            names = [n for n in batch.schema.names if n not in ("arguments", "result", "name")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(errors, pa.string()), pa.array(texts, pa.string())], names=[*names, "schema_error", "canonical"])

    return run


def _result_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("call_id").to_pylist(), batch.column("content").to_pylist())
        texts = pa.array([canonical({"id": i, "result": x}) for i, x in pairs], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OWN), texts], names=[*_OWN, "canonical"])


_OWN = ["conv_id", "call_id", "error", "n_results"]


def _unlinked(results: DataFrame, firsts: DataFrame, calls: DataFrame) -> DataFrame:
    """The results that no call has, as rows of ``link_calls``.  ``results``
    have a ``result`` number, ``firsts`` the linked one of every identifier."""
    known = calls.select("conv_id", "call_id", F.lit(True).alias("known")).distinct()
    ids = firsts.join(known, ["conv_id", "call_id"], "left").select(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "n_results", F.coalesce("known", F.lit(False)).alias("known"),
        F.col("first.result").alias("_linked"))
    rest = results.join(ids, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call"))).filter(
        ~F.col("known") | (F.col("result") != F.col("_linked")))
    error = F.when(F.col("known"), "repeated result").otherwise("no call")
    texts = rest.select("conv_id", "call_id", error.alias("error"), "n_results", "content").mapInArrow(
        _result_texts, "conv_id long, call_id string, error string, n_results long, canonical string")
    return texts.select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("position"), F.lit(False).alias("valid"), "error", "n_results", "canonical")


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map over components, a row each with its edges (node, key, dep,
    dep_key): what ``_peeled`` returns."""
    for batch in batches:
        out: dict[str, list] = {"node": [], "key": [], "level": [], "cyclic": []}
        for edges in batch.column("edges"):
            node, key, dep, dep_key = (edges.values.field(c).to_pylist() for c in ("node", "key", "dep", "dep_key"))
            keys = dict(zip(dep, dep_key)) | dict(zip(node, key))
            after: dict[int, list[int]] = {}
            waits = dict.fromkeys(keys, 0)
            moved = dict.fromkeys(keys, False)
            for n, d in zip(node, dep):
                after.setdefault(d, []).append(n)
                waits[n] += 1
                moved[n] |= keys[d] >= keys[n]
            place = {n: (k, 0) for n, k in keys.items()}
            ready = [n for n, w in waits.items() if not w]
            for n in ready:  # grows while it is read
                for m in after.get(n, ()):
                    moved[m] |= moved[n]
                    own, level = place[n]
                    if own >= place[m][0]:
                        place[m] = max(place[m], (own, level + 1))
                    waits[m] -= 1
                    if not waits[m]:
                        ready.append(m)
            done = set(ready)
            for n, k in keys.items():
                if n not in done or moved[n]:
                    own = place[n] if n in done else (k, 0)
                    for c, x in zip(out.values(), (n, *own, n not in done)):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([
            pa.array(out["node"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["level"], pa.int64()),
            pa.array(out["cyclic"], pa.bool_())], names=list(out))


def _late(edges: DataFrame, keys: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(node, key, level, cyclic) of the calls that stand behind a later call
    they depend on, directly or through others: the largest key they wait for
    and their level at that key.  ``edges`` (node, dep), ``keys`` (node, key)."""
    own = save_and_reread(
        edges.join(keys, "node").join(keys.select(F.col("node").alias("dep"), F.col("key").alias("dep_key")), "dep"), "keyed-edges")
    schema = "node long, key long, level long, cyclic boolean"
    late = own.filter("dep_key >= key")
    if not late.head(1):
        return own.sparkSession.createDataFrame([], schema)
    placed = components(own, "node", "dep")
    behind = placed.join(late.select("node"), "node", "left_semi").select("component").distinct()
    within = own.join(placed.join(behind, "component"), "node")
    sizes = within.groupBy("component").agg(F.count("*").alias("n"))
    within = save_and_reread(within.join(sizes, "component"), "late-components")
    small = within.filter(F.col("n") <= in_task).groupBy("component").agg(F.collect_list(F.struct("node", "key", "dep", "dep_key")).alias("edges"))
    found = small.select("edges").mapInArrow(_ordered, schema)
    large = within.filter(F.col("n") > in_task).select("node", "dep")
    return found.unionByName(_peeled(large, keys)) if large.head(1) else found


def _peeled(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The same for components of any size, in a round per level."""
    late = edges.join(keys, "node").join(keys.select(F.col("node").alias("dep"), F.col("key").alias("dep_key")), "dep")
    moved = save_and_reread(late.filter("dep_key >= key").select("node").distinct(), "late")
    while True:  # and all that depend on them
        more = edges.join(moved.withColumnRenamed("node", "dep"), "dep").select("node").union(moved).distinct()
        more = save_and_reread(more, "late")
        if more.count() == moved.count():
            break
        moved = more
    own = save_and_reread(edges.join(moved, "node"), "late-edges")
    start = keys.join(save_and_reread(own.select("dep").distinct(), "late-deps").withColumnRenamed("dep", "node"), "node").join(moved, "node", "left_anti")
    done = save_and_reread(start.select("node", "key", F.lit(0).cast("long").alias("level")), "peeled")
    waiting = moved
    while True:
        ready = (
            own.join(waiting, "node").join(done.select(F.col("node").alias("dep"), "key", "level"), "dep", "left").groupBy("node").agg(
                F.count("*").alias("n"), F.count("key").alias("have"), F.max(F.struct("key", (F.col("level") + 1).alias("level"))).alias("after"))
            .filter("n = have").join(keys, "node"))
        after = F.col("after.key") >= F.col("key")
        step = save_and_reread(ready.select(
            "node", F.greatest("key", "after.key").alias("key"), F.when(after, F.col("after.level")).otherwise(F.lit(0)).alias("level")), "peeled")
        if not step.head(1):
            break
        done = save_and_reread(done.union(step), "peeled")
        waiting = save_and_reread(waiting.join(step, "node", "left_anti"), "waiting")
    out = done.join(moved, "node").withColumn("cyclic", F.lit(False))
    return out.unionByName(waiting.join(keys, "node").select("node", "key", F.lit(0).cast("long").alias("level"), F.lit(True).alias("cyclic")))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position``: 0, 1, ... inside every group, by ``order``.
    Rows are sorted by ranges of (group, order), numbered inside their range,
    and a range starts where the ones before it end."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = save_and_reread(
        rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
        .withColumn("_id", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_range").agg(F.count("*").alias("n"))  # one row per range
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    whole = placed.join(before, "_range").withColumn("_place", F.col("_before") + F.col("_row"))
    first = whole.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    joined = whole.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("position", F.col("_place") - F.col("_first")).select(*rows.columns, "position")


def link_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every_result: bool = False, in_task: int = IN_TASK,
) -> DataFrame:
    """One row per call, and with ``every_result`` one per result that no call has: conv_id, call_id, position, valid, error, n_results,
    canonical.

    ``calls``: conv_id, seq (its place as written), call_id, name, arguments
    (JSON text), depends_on (identifiers); ``results``: conv_id, call_id, seq,
    content; ``schemas``: by tool name.  ``position`` numbers the calls of a
    conversation so that a call comes after what it depends on, else as
    written; a call in or behind a cycle has none.  ``error`` names, in order:
    a repeated identifier, a missing dependency, a cycle, no result, and what
    is wrong with the arguments.  Of several results the first by seq (then by
    content) is linked; a null argument text is an empty object; null
    identifiers link to nothing; calls whose rows are equal are rows like
    others.  ``canonical`` is the call with its result as canonical JSON, null
    when the arguments are not JSON, hold a number out of range (a float above
    64 bits, a whole number of more than ``MAX_DIGITS`` digits) or are nested
    too deep, which is an error.  A row of a result has no position, the
    error ``no call`` or ``repeated result`` (its call is linked to another),
    and its identifier and content as ``canonical``.  Schemas with keywords
    that are not checked are an error.  Empty tables give an empty one.
    """
    for schema in schemas.values():
        check_schema(schema)
    if len(json.dumps(schemas)) > MAX_SCHEMA_BYTES:
        raise ValueError("schemas are too large to travel with every task")
    calls = save_and_reread(
        calls.select("conv_id", "seq", "call_id", "name", "arguments", "depends_on").withColumn("node", F.monotonically_increasing_id()), "calls")
    results = results.select("conv_id", "call_id", "seq", "content")
    if every_result:
        results = save_and_reread(results.withColumn("result", F.monotonically_increasing_id()), "results")
    else:
        results = results.withColumn("result", F.lit(0).cast("long"))
    first = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), F.col("content"), F.col("result"))
    firsts = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(first).alias("first"))
    keys = calls.select("node", F.coalesce("seq", F.lit(0)).alias("key"))

    named = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("same"), F.min("node").alias("dep"))
    wants = calls.select("node", "conv_id", F.explode(F.array_distinct(F.coalesce("depends_on", F.array()))).alias("call_id"))
    linked = save_and_reread(wants.join(named.drop("same"), ["conv_id", "call_id"], "left").select("node", "dep"), "dependencies")
    missing = linked.groupBy("node").agg(F.max(F.col("dep").isNull()).alias("missing"))
    moved = _late(linked.filter("dep IS NOT NULL"), keys, in_task)

    rows = (
        calls.join(firsts, ["conv_id", "call_id"], "left").join(named.drop("dep"), ["conv_id", "call_id"], "left")
        .join(missing, "node", "left").join(moved, "node", "left"))
    rows = rows.select(
        "conv_id", "call_id", "name", "arguments", F.col("first.content").alias("result"), "node",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("key", "seq", F.lit(0)).alias("key"), F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce(F.col("same") > 1, F.lit(False)).alias("same"),
        F.coalesce("missing", F.lit(False)).alias("missing"),
    )
    placed = numbered(rows, "conv_id", ["cyclic", "key", "level", "node"]).drop("key", "level", "node")
    checked = placed.mapInArrow(
        _checked(schemas), "conv_id long, call_id string, n_results long, cyclic boolean, same boolean, missing boolean, "
        "position long, schema_error string, canonical string")
    error = F.concat_ws(
        "; ", F.when(F.col("same"), "repeated identifier"), F.when(F.col("missing"), "missing dependency"), F.when(F.col("cyclic"), "cycle"),
        F.when(F.col("n_results") == 0, "no result"), "schema_error")
    linked_calls = checked.select(
        "conv_id", "call_id", F.when(~F.col("cyclic"), F.col("position")).alias("position"), (error == "").alias("valid"),
        F.nullif(error, F.lit("")).alias("error"), "n_results", "canonical")
    return linked_calls.unionByName(_unlinked(results, firsts, calls)) if every_result else linked_calls
