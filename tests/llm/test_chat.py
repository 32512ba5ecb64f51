import json
import random

from marginalia.llm import chat as C

MESSAGES = "conv_id long, turn long, role string, text string, calls string"
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def run(spark, messages, calls, results):
    made = C.chats(spark.createDataFrame([(*m, "x") for m in messages], MESSAGES), spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS))
    return {r.conv_id: r for r in made.collect()}


def test_calls_are_linked_ordered_and_validated(spark):
    search = '{"limit": 5, "query": "é"}'
    out = run(
        spark,
        [(1, 0, "user", "hi"), (1, 1, "assistant", "wait"), (1, 1, "assistant", "wait"), (2, 0, None, None), (None, 0, "user", "lost")],
        [
            (1, "b", 1, "search", search, []), (1, "a", 1, "search", '{"query":""}', ["b"]), (1, "c", 1, "measure", "{bad", ["a", "gone"]),
            (1, "b", 2, "search", "{}", []), (1, None, 1, "search", "{}", []), (2, "x", 3, "nothing", None, ["y"]), (2, "y", 3, "schedule", '{"at":{"turn":1},"at":1}', ["x"]),
            (3, "only", 0, "schedule", '{"at":{"turn":1.0},"tags":[1]}', None), (None, "q", 0, "search", "{}", []),
        ],
        [(1, "b", 2, "found"), (1, "b", 3, "again"), (1, "zz", 3, "orphan"), (3, "only", 0, None)],
    )
    assert set(out) == {1, 2, 3}
    one = json.loads(out[1].chat)["messages"]
    assert [m["role"] for m in one] == ["user", "assistant", "tool"]
    assert [(c["id"], c["valid"]) for c in one[1]["tool_calls"]] == [("b", True), ("a", False), ("c", False)]
    assert one[1]["tool_calls"][0]["arguments"] == {"query": "é", "limit": 5} and one[1]["tool_calls"][2]["arguments"] == "{bad"
    assert one[2] == {"role": "tool", "tool_call_id": "b", "content": "found"}
    assert (out[1].n_messages, out[1].n_calls, out[1].n_linked, out[1].n_valid, out[1].n_cyclic, out[1].n_left_out) == (2, 3, 1, 1, 0, 4)
    assert '"arguments":{"limit":5,"query":"é"}' in out[1].chat and ": " not in out[1].chat
    assert out[2].n_cyclic == 2 and out[2].n_valid == 0 and json.loads(out[2].chat)["messages"][0] == {"role": None, "content": None}
    assert out[3].faults == ["only $.tags[0]: not string"] and json.loads(out[3].chat)["messages"][0]["content"] is None


def test_json_that_a_model_can_emit(spark):
    deep, huge, long = "[" * 100_000, "1" + "0" * 400, "x" * 2_000_000
    texts = ["1e999", '{"query":"\\ud800"}', '{"query":"a","limit":' + huge + "}", deep, '{"a":1,"a":2}', "NaN", "", "-0", '{"query":"' + long + '"}', "9" * 5000]
    calls = [(1, f"c{i}", 1, "search", t, []) for i, t in enumerate(texts)]
    out = run(spark, [(1, 1, "assistant", "go")], calls, [])[1]
    got = {c["id"]: c for c in json.loads(out.chat)["messages"][0]["tool_calls"]}
    assert [got[f"c{i}"]["valid"] for i in range(len(texts))] == [False] * 8 + [True, False]
    assert got["c0"]["arguments"] == "1e999" and got["c2"]["arguments"]["limit"] == int(huge) and got["c8"]["arguments"]["query"] == long
    assert {f.split(" ")[0] for f in out.faults} == {f"c{i}" for i in range(len(texts)) if i != 8}
    assert any(f.startswith("c2 $.limit: over maximum") for f in out.faults) and any(f.startswith("c1 not JSON") for f in out.faults)


def test_types_of_schemas():
    either = {"type": ["string", "null"]}
    assert C.faults(None, either) == [] and C.faults("a", either) == [] and C.faults(1, either) == ["$: not string or null"]
    assert C.faults(1, {"type": "thing"}) == ["$: not thing"]
    assert C.faults(10**400, {"type": "integer"}) == [] and C.faults(True, {"type": "integer"}) == ["$: not integer"] and C.faults(2.0, {"type": "integer"}) == []
    assert C.faults(True, {"type": "number"}) == ["$: not number"] and C.faults(True, {"type": ["boolean"]}) == []


def plain(messages, calls, results):
    """All columns of every conversation, by loops over plain rows."""
    first = lambda x: (x is not None, x if x is not None else "")
    number = lambda x: (x is not None, x if x is not None else 0)
    out = {}
    for conv in {r[0] for r in (*messages, *calls, *results)} - {None}:
        said = {m[1:4] for m in messages if m[0] == conv}
        own = sorted((c for c in calls if c[0] == conv), key=lambda c: (number(c[2]), first(c[3]), first(c[4])))
        given = sorted((r for r in results if r[0] == conv), key=lambda r: (number(r[2]), first(r[3])))
        live, left = {}, 0
        for c in own:
            if c[1] is None or c[1] in live:
                left += 1
            else:
                live[c[1]] = c
        answer = {}
        for r in given:
            if r[1] is None or r[1] in answer:
                left += 1
            else:
                answer[r[1]] = r[3]
        left += sum(k not in live for k in answer)
        order, waiting = [], dict(live)
        rank = lambda k: (live[k][2] is None, live[k][2] or 0, k)  # noqa: E731, B023
        while waiting:
            free = [k for k in waiting if not any(d in waiting for d in waiting[k][5] or [])]
            if not free:
                break
            order.append(min(free, key=rank))
            del waiting[order[-1]]
        cyclic = len(waiting)
        order += sorted(waiting, key=rank)
        wrong, made, valid = [], {}, 0
        for k in order:
            _, _, turn, name, arguments, _ = live[k]
            try:
                value = C.parsed(arguments)
                bad = C.faults(value, C.SCHEMAS[name]) if name in C.SCHEMAS else [f"unknown tool {name}"]
            except ValueError as error:
                value, bad = arguments, [f"not JSON: {type(error).__name__}"]
            valid += not bad
            wrong += [f"{k} {b}" for b in bad]
            made.setdefault(turn, []).append((k, name, value, not bad))
        rows = [[t, role, text, None] for t, role, text in sorted(said, key=lambda m: (m[0] is None, m[0] or 0, first(m[1]), first(m[2])))]
        for turn in made:
            mine = [r for r in rows if r[0] == turn and r[1] == "assistant"]
            if not mine:
                mine = [[turn, "assistant", None, None]]
                rows += mine
            mine[0][3] = made[turn]
        chat = []
        for _, role, text, tools in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            chat.append({"role": role, "content": text})
            if tools:
                chat[-1]["tool_calls"] = [{"id": k, "name": n, "arguments": v, "valid": g} for k, n, v, g in tools]
                chat += [{"role": "tool", "tool_call_id": k, "content": answer[k]} for k, *_ in tools if k in answer]
        text = json.dumps({"messages": chat}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out[conv] = (text, len(said), len(live), sum(k in answer for k in live), valid, cyclic, left, wrong)
    return out


def test_every_column_equals_brute_force(spark):
    rng = random.Random(3)
    any_of = lambda *x: rng.choice(x)
    ids = [None, "a", "b", "c", "d", "e"]
    messages = [(any_of(None, *range(12)), any_of(None, 0, 1, 2, 3), any_of(None, "user", "assistant", "assistant"), any_of(None, "", "x", "yé")) for _ in range(120)]
    arguments = [None, "{", '{"query":"q"}', '{"query":"","limit":99}', '{"text":"t","unit":"word"}', '{"at":{"turn":1},"tags":["a",2]}', '{"at":{}}', "[1e999]", '{"query":"q","z":1}']
    calls = [(any_of(None, *range(14)), rng.choice(ids), any_of(None, 0, 1, 2, 3), any_of("search", "measure", "schedule", "other"), rng.choice(arguments), rng.choice([None, [], [any_of("a", "b", "z")], ["a", "b", any_of("c", "d", "e")]])) for _ in range(160)]
    calls = list({(c[0], c[1], c[2], c[3], c[4]): c for c in calls}.values())
    results = [(any_of(None, *range(14)), rng.choice([*ids, "orphan"]), any_of(None, 1, 2, 3), any_of(None, "r", "s")) for _ in range(120)]
    got = run(spark, messages, calls, results)
    want = plain(messages, calls, results)
    assert {k: (r.chat, r.n_messages, r.n_calls, r.n_linked, r.n_valid, r.n_cyclic, r.n_left_out, list(r.faults)) for k, r in got.items()} == want
    assert sum(w[5] for w in want.values()) > 0 and sum(w[3] for w in want.values()) > 10


def test_order_is_topological():
    calls = [{"call_id": c, "turn": t, "after": a} for c, t, a in (("d", 0, ["a"]), ("a", 2, None), ("b", 1, []), ("c", 0, ["d", "b"]), ("e", 0, ["f"]), ("f", 0, ["e"]), ("g", 9, ["e"]))]
    order, stuck = C.ordered(calls)
    assert [calls[i]["call_id"] for i in order] == ["b", "a", "d", "c", "e", "f", "g"]
    assert {calls[i]["call_id"] for i in stuck} == {"e", "f", "g"}


def test_whole_view_agrees_with_counts_by_hand(spark):
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    calls, results = C.tool_view(talk)
    made, given = calls.toPandas(), results.toPandas()
    out = C.chats(talk, calls, results).toPandas()
    assert len(out) == talk.select("conv_id").distinct().count()
    both = set(zip(made.conv_id, made.call_id)) & set(zip(given.conv_id, given.call_id))
    assert out.n_linked.sum() == len(both) and out.n_calls.sum() == len(made)
    for text in out.chat:
        assert C.canonical(json.loads(text)) == text


def test_empty(spark):
    assert run(spark, [], [], []) == {}
