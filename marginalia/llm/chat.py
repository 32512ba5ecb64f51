"""Operator 9: conversations with their tool calls linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Schemas of the tools in tool_view; the subset of JSON Schema that `faults` knows.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}, "required": ["query"], "additionalProperties": False},
    "measure": {"type": "object", "properties": {"text": {"type": "string"}, "unit": {"enum": ["word", "line", "character"]}}, "required": ["text", "unit"], "additionalProperties": False},
    "schedule": {"type": "object", "properties": {"at": {"type": "object", "properties": {"turn": {"type": "integer"}}, "required": ["turn"]}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["at"]},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and characters as they are; numbers that JSON lacks are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None) -> object:
    """The value of a JSON text. Errors, all ValueError: a repeated key, NaN or Infinity, a number beyond a double, a lone surrogate, a null text."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def none(name: str) -> None:
        raise ValueError(name)

    def finite(digits: str) -> float:
        value = float(digits)
        if not math.isfinite(value):
            raise ValueError("number out of range")
        return value

    if text is None:
        raise ValueError("null")
    value = json.loads(text, object_pairs_hook=once, parse_constant=none, parse_float=finite)
    canonical(value).encode()  # a lone surrogate has no bytes
    return value


def of_type(value: object, kind: str) -> bool:
    """Whether a value has a type of JSON Schema; nothing has a type of another name."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, one or a list of them, enum, required, properties, additionalProperties, items, and bounds of numbers and lengths."""
    out = []
    kind = schema.get("type")
    number = of_type(value, "number")
    if kind is not None and not any(of_type(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at}: not {kind if isinstance(kind, str) else ' or '.join(kind)}"]
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        out.append(f"{at}: not in enum")
    if number:
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: under minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: over maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += faults(item, schema["items"], f"{at}[{i}]")
    return out


def ordered(calls: list[dict]) -> tuple[list[int], set[int]]:
    """A topological order of the calls by `after`, earliest turn and then call_id first among those that are free; and the calls on or behind a cycle, which come last, by turn and call_id. Ids of no call are ignored."""
    number = {c["call_id"]: i for i, c in enumerate(calls)}
    rank = sorted(range(len(calls)), key=lambda i: (calls[i]["turn"] is None, calls[i]["turn"] or 0, calls[i]["call_id"]))
    place = {i: r for r, i in enumerate(rank)}
    behind: list[list[int]] = [[] for _ in calls]
    waits = [0] * len(calls)
    for i, c in enumerate(calls):
        for d in {number[x] for x in c["after"] or [] if x in number}:
            behind[d].append(i)
            waits[i] += 1
    free = [place[i] for i in range(len(calls)) if not waits[i]]
    heapq.heapify(free)
    out = []
    while free:
        i = rank[heapq.heappop(free)]
        out.append(i)
        for j in behind[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, place[j])
    stuck = set(range(len(calls))) - set(out)
    return out + [i for i in rank if i in stuck], stuck


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results, by a hash join on the conversation and the call's id: status is linked, no_result, orphan_result, or repeated.

    Of calls that share an id the first by turn, name and arguments counts, and of results
    the first by turn and content; the others are `repeated`, as are calls and results
    without an id.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after").where("conv_id is not null")
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content").where("conv_id is not null")
    first_call = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "name", "arguments", F.to_json(F.struct("after"))))
    first_result = F.row_number().over(Window.partitionBy(*key).orderBy("result_turn", "content"))
    calls = calls.withColumn("nth", first_call).withColumn("is_call", F.lit(True))
    results = results.withColumn("nth_result", first_result).withColumn("is_result", F.lit(True))
    good = lambda n: (F.col(n) == 1) & F.col("call_id").isNotNull()
    joined = calls.where(good("nth")).hint("shuffle_hash").join(results.where(good("nth_result")), key, "full")
    status = F.when(F.col("is_call").isNull(), "orphan_result").when(F.col("is_result").isNull(), "no_result").otherwise("linked")
    joined = joined.select("conv_id", "call_id", "turn", "name", "arguments", "after", "result_turn", "content", status.alias("status"))
    rest = calls.where(~good("nth")).select("conv_id", "call_id", "turn", "name", "arguments", "after", F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit("repeated").alias("status"))
    more = results.where(~good("nth_result")).select("conv_id", "call_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after"), "result_turn", "content", F.lit("repeated").alias("status"))
    return joined.unionByName(rest).unionByName(more)


def written_chat(messages: list[dict], calls: list[dict], schemas: dict) -> tuple[str, int, int, int, int, list[str]]:
    """One conversation's canonical JSON; numbers of calls linked, valid, on a cycle and left out; and what is wrong with arguments."""
    used = [c for c in calls if c["status"] in ("linked", "no_result")]
    order, stuck = ordered(used)
    by_turn: dict = {}
    wrong, valid = [], 0
    for i in order:
        c = used[i]
        try:
            value = parsed(c["arguments"])
            found = faults(value, schemas[c["name"]]) if c["name"] in schemas else [f"unknown tool {c['name']}"]
        except (ValueError, RecursionError) as error:
            value, found = c["arguments"], [f"not JSON: {type(error).__name__}"]
        valid += not found
        wrong += [f"{c['call_id']} {f}" for f in found]
        by_turn.setdefault(c["turn"], []).append((c, value, not found))
    rows: list = []
    turns = {}
    for m in sorted(messages, key=lambda m: (m["turn"] is None, m["turn"] or 0, m["role"] is not None, m["role"] or "", m["text"] is not None, m["text"] or "")):
        rows.append((m["turn"], {"role": m["role"], "content": m["text"]}))
        if m["role"] == "assistant":
            turns.setdefault(m["turn"], rows[-1][1])
    for turn in by_turn:
        if turn not in turns:
            turns[turn] = {"role": "assistant", "content": None}
            rows.append((turn, turns[turn]))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for turn, row in rows:
        out.append(row)
        if turns.get(turn) is row and turn in by_turn:
            row["tool_calls"] = [{"id": c["call_id"], "name": c["name"], "arguments": value, "valid": good} for c, value, good in by_turn[turn]]
            out += [{"role": "tool", "tool_call_id": c["call_id"], "content": c["content"]} for c, _, _ in by_turn[turn] if c["status"] == "linked"]
    return canonical({"messages": out}), sum(c["status"] == "linked" for c in used), valid, len(stuck), len(calls) - len(used), wrong


def chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Each conversation as (conv_id, chat, n_messages, n_calls, n_linked, n_valid, n_cyclic, n_left_out, faults).

    Calls stand at the assistant's message of their turn (an empty one is made if there is
    none) in topological order, each with its arguments as JSON, or as text where they
    aren't JSON, and whether they satisfy the tool's schema; the results follow in that
    order.  Orphan results, and repeated or nameless calls and results, are left out and
    counted.

    Arguments that no JSON text may have (repeated keys, numbers beyond a double, lone
    surrogates, nesting beyond Python's stack) are a fault of that call and stay as text.

    Rows with a null conv_id are ignored; null roles and texts become JSON nulls; messages
    are ordered by turn, role and text, null turns last and null roles and texts first; equal messages are kept once.
    Conversations that have calls but no message are there too.  Other columns are ignored,
    and empty tables give no rows.
    """
    spoken = messages.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("m"))
    said = spoken.groupBy("conv_id").agg(F.collect_set("m").alias("messages"))
    made = linked(calls, results)
    done = made.groupBy("conv_id").agg(F.collect_list(F.struct(*[c for c in made.columns if c != "conv_id"])).alias("calls"))
    rows = said.join(done, "conv_id", "full").select("conv_id", "messages", "calls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, spoken, called in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "messages", "calls"))):
                spoken, called = spoken or [], called or []
                chat, n_linked, valid, cyclic, left_out, wrong = written_chat(spoken, called, schemas)
                out.append((conv, chat, len(spoken), len(called) - left_out, n_linked, valid, cyclic, left_out, wrong))
            kinds = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.list_(pa.string())]
            names = ["conv_id", "chat", "n_messages", "n_calls", "n_linked", "n_valid", "n_cyclic", "n_left_out", "faults"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(run, "conv_id long, chat string, n_messages int, n_calls int, n_linked int, n_valid int, n_cyclic int, n_left_out int, faults array<string>")


def tool_view(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from the whole table, which has none of its own: a call for each assistant turn, a result for most.

    Arguments quote the turn's text; some are invalid or no JSON, some calls depend on the
    one before or, in every 11th conversation, on the one after, some results are missing,
    repeated or orphaned.
    """
    turns = conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    name_of = F.element_at(F.array(F.lit("search"), F.lit("measure"), F.lit("schedule")), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    id_of = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    odd = F.pmod(F.col("conv_id"), F.lit(7)) == 0
    arguments = (
        F.when(F.pmod(F.col("conv_id"), F.lit(29)) == 0, F.concat(F.lit("{"), "text"))
        .when(F.col("name") == "search", F.to_json(F.struct(F.split_part("text", F.lit(" "), F.lit(1)).alias("query"), F.pmod(F.length("text"), F.lit(60)).alias("limit"))))
        .when(F.col("name") == "measure", F.to_json(F.struct(F.col("text"), F.when(odd, "page").otherwise("word").alias("unit"))))
        .otherwise(F.to_json(F.struct(F.struct("turn").alias("at"), F.slice(F.split("text", " "), 1, 2).alias("tags"))))
    )
    after = F.when(F.pmod(F.col("conv_id"), F.lit(11)) == 0, F.array(id_of(F.col("turn") + 2), id_of(F.col("turn") - 2))).when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, F.array(id_of(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.withColumn("name", name_of).select("conv_id", id_of(F.col("turn")).alias("call_id"), "turn", "name", arguments.alias("arguments"), after.alias("after"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(13))
    results = turns.where(kind != 0).select("conv_id", F.explode(F.when(kind == 1, F.array(id_of(F.col("turn")), id_of(F.col("turn")))).when(kind == 2, F.array(id_of(F.col("turn")), id_of(F.col("turn") + 100))).otherwise(F.array(id_of(F.col("turn"))))).alias("call_id"), F.col("turn"), F.concat(F.lit("result: "), "text").alias("content"))
    return calls, results
