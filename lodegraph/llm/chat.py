"""Tool-call linking in conversations: calls meet their results by identifier, in topological order, as canonical JSON.

Messages: conv_id, turn, role, text, tool_calls (JSON array of ``{"id", "name", "arguments"}``, or the
nested ``{"id", "function": {...}}``), tool_call_id (on the message that carries a call's result).
Arguments may refer to another call's result by ``{"$ref": id}``; ``depends_on`` may list ids.

One row comes out for every call and for every result, found by a hash join on (conv_id, identifier):

* status of a call: ``linked``, ``no_result``, or ``repeated_call`` (a later call under a used id, never linked);
  of a result that doesn't belong to a call: ``orphan_result`` (no such call, or the call comes no earlier)
  or ``repeated_result``.
* order: by (turn, level, seq). A call can only use what is there before it, so between messages the turn
  is the topological order and a reference to a later turn is a problem; within a message, where calls
  stand side by side, ``level`` is the longest chain of references below a call. Calls on a cycle get
  level -1 and the problem ``cycle``.
* ``valid`` and ``problems``: arguments against the tool's JSON schema (type, properties, required,
  additionalProperties, items, enum, const, minimum, maximum, minLength, maxLength, minItems, maxItems),
  unknown tools, unreadable JSON, references to unknown or later calls.
* ``json``: the call with its result, keys sorted by code point, no white space, integers for whole numbers,
  UTF-8 unescaped.

Null conv_id, turn or identifier links nothing. Empty text is an empty result. Unreadable ``tool_calls``, among them such as hold
numbers beyond a double or lone surrogates, give one row with the problem ``unreadable``, unreadable arguments the same
problem. Repeated rows are repeated calls or results: of calls alike in every way one is the first. Empty tables give an empty
result. Other columns are ignored.

Scale: joins are on (conv_id, identifier), never on the conversation, so a conversation with a third of
all messages is spread by its identifiers; first occurrences are combined map-side, and the hashed side of
every join holds one row an identifier. JSON is read once and written as a table. Python holds a message whole, and
of a batch only slices of ``SLICE_ROWS`` rows or ``SLICE_BYTES`` of text (one message at least) as objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
_CALLS = "conv_id long, turn long, seq int, call_id string, name string, arguments string, level int, problems string, outer_refs array<string>"
_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
}


def _plain(v):
    """Whole floats as integers, so that equal numbers are written alike."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return int(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def canonical(v) -> str:
    return json.dumps(_plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def loads(text: str):
    """JSON without NaN, infinities (numbers beyond a double are such) and lone surrogates."""
    v = json.loads(text, parse_constant=_no_constant)
    canonical(v).encode()  # ValueError, of which a failed encoding is one
    return v


def violations(value, schema: Mapping, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, as ``path:keyword``."""
    found: list[str] = []
    if isinstance(value, dict) and set(value) == {"$ref"}:  # a result that isn't known yet may be anything
        return found
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}:type"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}:enum")
    if "const" in schema and value != schema["const"]:
        found.append(f"{at}:const")
    if isinstance(value, int | float) and not isinstance(value, bool):
        found += [f"{at}:{k}" for k, broken in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)) if k in schema and broken(schema[k])]
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            found += [f"{at}:{least}"] * (len(value) < schema.get(least, 0)) + [f"{at}:{most}"] * (len(value) > schema.get(most, len(value)))
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}:required" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}:additionalProperties")
            elif isinstance(extra := schema.get("additionalProperties"), Mapping):
                found += violations(value[k], extra, f"{at}.{k}")
    return found


def references(value) -> set[str]:
    """Identifiers that a value refers to; without recursion, for deep values."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str):
                found.add(v["$ref"])
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
    return found


def levels(needs: list[set[int]]) -> list[int]:
    """Kahn's algorithm over the calls of one message: the longest chain below each, -1 on or behind a cycle."""
    out, open_ = [-1] * len(needs), [len(n) for n in needs]
    users: list[list[int]] = [[] for _ in needs]
    for i, n in enumerate(needs):
        for j in n:
            users[j].append(i)
    ready = [i for i, k in enumerate(open_) if not k]
    for i in ready:
        out[i] = 0
    for i in ready:
        for u in users[i]:
            out[u] = max(out[u], out[i] + 1)
            open_[u] -= 1
            if not open_[u]:
                ready.append(u)
    return [level if not k else -1 for level, k in zip(out, open_)]


def read_calls(text: str, schemas: Mapping[str, Mapping]) -> list[tuple]:
    """(seq, id, name, canonical arguments, level, problems, references outside the message) of one message."""
    try:
        calls = loads(text)
        calls = calls if isinstance(calls, list) else [calls]
        if not all(isinstance(c, dict) for c in calls):
            raise ValueError("a call must be an object")
    except (ValueError, RecursionError):
        return [(0, None, None, None, 0, ["unreadable"], [])]
    rows, first, refs = [], {}, []
    for seq, c in enumerate(calls):
        inner = c["function"] if isinstance(c.get("function"), dict) else c
        call_id, name, args, problems = c.get("id"), inner.get("name"), inner.get("arguments", {}), []
        call_id = call_id if isinstance(call_id, str) else None
        name = name if isinstance(name, str) else None
        if isinstance(args, str):
            try:
                args = loads(args)
            except (ValueError, RecursionError):
                args, problems = None, ["unreadable"]
        if not problems:
            problems = violations(args, schemas[name]) if name in schemas else ["unknown_tool"]
        needs = references(args) | {x for x in (c.get("depends_on") or []) if isinstance(x, str)} if isinstance(c.get("depends_on") or [], list) else references(args)
        if call_id is not None:
            first.setdefault(call_id, seq)
        rows.append([seq, call_id, name, canonical(args), 0, problems])
        refs.append(needs)
    deep = levels([{first[r] for r in need if r in first} for need in refs])
    for row, level in zip(rows, deep):
        row[4] = level
        if level < 0:
            row[5] = [*row[5], "cycle"]
    return [(*row, sorted(r for r in need if r not in first)) for row, need in zip(rows, refs)]


def slices(batches, *texts: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE_ROWS`` rows and, unless they are of one row, ``SLICE_BYTES`` in the columns ``texts``."""
    for b in batches:
        sizes = sum((pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(b.num_rows, np.int64))
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            to = min(max(fits, at + 1), at + SLICE_ROWS)
            yield b.slice(at, to - at)
            at = to


def link(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """conv_id, turn, seq, call_id, name, level, status, result_turn, valid, problems, json."""
    held = json.loads(json.dumps(schemas))

    def parse(batches):
        for b in slices(batches, "tool_calls"):
            rows = []
            for conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "tool_calls"))):
                rows += [(conv, turn, s, i, n, a, lv, ",".join(p), out) for s, i, n, a, lv, p, out in read_calls(text, held)]
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _CALLS.split(", ")])

    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"),
        F.col("tool_calls").cast("string").alias("tool_calls"), F.col("tool_call_id").cast("string").alias("tool_call_id"),
    )
    calls = m.where("tool_calls IS NOT NULL").select("conv_id", "turn", "tool_calls").mapInArrow(parse, _CALLS)
    names = calls.columns
    calls = materialize(calls.groupBy(*names).agg(F.count(F.lit(1)).cast("int").alias("n")), "calls")
    by, place = ["conv_id", "call_id"], F.struct("turn", "seq", "name", "arguments", "problems")
    first_call = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL").groupBy(*by).agg(F.min(place).alias("at")).hint("shuffle_hash")
    results = m.where("tool_call_id IS NOT NULL").select("conv_id", F.col("tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"), F.coalesce("text", F.lit("")).alias("result"))
    judged = results.join(first_call, by, "left").withColumn("late", F.coalesce(F.col("result_turn") > F.col("at.turn"), F.lit(False)))
    taken = judged.where("late").groupBy(*by).agg(F.min(F.struct("result_turn", "result")).alias("r")).hint("shuffle_hash")
    # references to other messages must be to calls of earlier turns
    asked = calls.where("size(outer_refs) > 0").select(*names, F.explode("outer_refs").alias("ref"))
    made = first_call.select("conv_id", F.col("call_id").alias("ref"), F.col("at.turn").alias("ref_turn")).hint("shuffle_hash")
    wrong = asked.join(made, ["conv_id", "ref"], "left").where("coalesce(ref_turn >= turn, true)")
    wrong = wrong.select(*names, F.concat(F.when(F.col("ref_turn").isNull(), "unknown_ref:").otherwise("later_ref:"), "ref").alias("ref"))
    wrong = wrong.groupBy(*names).agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("bad_refs")).hint("shuffle_hash")
    same = [calls[c].eqNullSafe(wrong[c]) for c in names]
    full = calls.join(wrong, same, "left").select(calls["*"], "bad_refs").join(first_call, by, "left").join(taken, by, "left")
    full = full.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    is_own = F.coalesce(place.eqNullSafe(F.col("at")) & (F.col("copy") == 1), F.lit(False))
    of_calls = full.select(
        "conv_id", "turn", "seq", "call_id", "name", "level", "arguments",
        F.when(F.col("at").isNotNull() & ~is_own, "repeated_call").when(is_own & F.col("r").isNotNull(), "linked").otherwise("no_result").alias("status"),
        F.when(is_own, F.col("r.result_turn")).alias("result_turn"), F.when(is_own, F.col("r.result")).alias("result"),
        F.concat_ws(",", F.nullif("problems", F.lit("")), "bad_refs").alias("problems"),
    )
    left = judged.join(taken.select(*by, F.col("r.result_turn").alias("taken_turn"), F.col("r.result").alias("taken_result")).hint("shuffle_hash"), by, "left")
    # of results alike in every way one is the taken one: the others are counted off
    extra = left.groupBy("conv_id", "call_id", "result_turn", "result", "late", "taken_turn", "taken_result").agg(F.count(F.lit(1)).alias("n"))
    is_taken = F.coalesce(F.col("late") & (F.col("result_turn") == F.col("taken_turn")) & (F.col("result") == F.col("taken_result")), F.lit(False))
    extra = extra.withColumn("n", F.when(is_taken, F.col("n") - 1).otherwise(F.col("n"))).where("n > 0")
    null = F.lit(None)
    of_results = extra.select(
        "conv_id", null.cast("long").alias("turn"), null.cast("int").alias("seq"), "call_id", null.cast("string").alias("name"), null.cast("int").alias("level"), null.cast("string").alias("arguments"),
        F.when(F.col("late"), "repeated_result").otherwise("orphan_result").alias("status"), "result_turn", "result", F.lit("").alias("problems"), F.sequence(F.lit(1), F.col("n").cast("int")).alias("copies"),
    )
    of_results = of_results.select("*", F.explode("copies")).drop("copies", "col")
    rows = of_calls.unionByName(of_results)

    def write(batches):
        for b in slices(batches, "arguments", "result"):
            texts = []
            for call_id, name, args, result, status in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result", "status"))):
                one = {"id": call_id, "status": status}
                if status not in ("orphan_result", "repeated_result"):
                    one |= {"name": name, "arguments": json.loads(args) if args is not None else None}
                if result is not None:
                    one["result"] = result
                texts.append(canonical(one))
            keep = [c for c in b.schema.names if c not in ("arguments", "result")]
            valid = [p == "" for p in b.column("problems").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(valid), pa.array(texts, pa.string())], [*keep, "valid", "json"])

    return rows.mapInArrow(
        write, "conv_id long, turn long, seq int, call_id string, name string, level int, status string, result_turn long, problems string, valid boolean, json string"
    )


_ONE = {"type": "object", "required": ["$ref"]}
REPLY_SCHEMAS = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}, "like": _ONE},
    },
    "rank": {"type": "object", "required": ["of"], "additionalProperties": False, "properties": {"of": _ONE}},
    "reply": {
        "type": "object", "required": ["prompt", "turn", "sources"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "sources": _ONE, "after": _ONE},
    },
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic.

    Every user turn calls ``reply`` on its text, the sources of which are what ``rank`` makes of a ``search`` (so three
    calls to be put in order), after the reply two turns before; every assistant turn is the result of the reply
    one turn before; system turns are neither. By a hash of the place one turn in eight each has a cycle,
    a limit below its minimum, an unknown tool, an argument too many, and a repeated call.
    """
    name = lambda turn, what="": F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"), F.lit(what))
    ref = lambda turn, what="": F.struct(name(turn, what).alias("$ref"))
    turn, kind = F.col("turn"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))
    call = lambda tool, what, *args: F.struct(name(turn, what).alias("id"), tool.alias("name"), F.to_json(F.struct(*args)).alias("arguments"))
    search = call(F.lit("search"), "s", F.col("text").alias("query"), F.when(kind == 1, 0).otherwise(10).alias("limit"), F.when(kind == 0, ref(turn, "k")).alias("like"))
    rank = call(F.when(kind == 2, "sort").otherwise("rank"), "k", ref(turn, "s").alias("of"), F.when(kind == 3, 1).alias("extra"))
    reply = call(F.lit("reply"), "", F.col("text").alias("prompt"), turn.alias("turn"), ref(turn, "k").alias("sources"), F.when(turn >= 2, ref(turn - 2)).alias("after"))
    calls = F.when(kind == 5, F.array(reply, rank, search, search)).otherwise(F.array(reply, rank, search))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "user", F.to_json(calls)).alias("tool_calls"),
        F.when(F.col("role") == "assistant", name(turn - 1)).alias("tool_call_id"),
    )
