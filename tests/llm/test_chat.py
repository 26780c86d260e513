import json

import pyarrow as pa

from lodegraph.llm import chat

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}, "b": {"type": "number", "minimum": 0}}, "additionalProperties": False}}
SHAPE = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string, status string"


def run(spark, rows, schemas=SCHEMAS):
    return chat.link(spark.createDataFrame([(*r, "clash") for r in rows], SHAPE), schemas).collect()


def calls(*cs):
    return json.dumps([{"id": i, "name": n, "arguments": a, **(extra[0] if extra else {})} for i, n, a, *extra in cs])


def test_links_orders_validates_and_serialises(spark):
    rows = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "assistant", None, calls(("c", "add", {"a": {"$ref": "b"}}), ("a", "add", {"b": 2.0, "a": 1.50}), ("b", "add", {"a": {"$ref": "a"}})), None),
        (1, 2, "tool", "é\n", None, "a"), (1, 3, "tool", "again", None, "a"), (1, 3, "tool", None, None, "b"),
        (1, 4, "assistant", None, calls(("a", "add", {"a": 1}), ("d", "sub", {}), ("e", "add", {"b": -1, "x": 1})), None),
        (1, 0, "tool", "too early", None, "d"), (2, 1, "tool", "nobody's", None, "a"),
        (2, 5, "assistant", None, calls(("x", "add", {"a": {"$ref": "y"}}), ("y", "add", {"a": {"$ref": "x"}}), ("z", "add", {"a": {"$ref": "later"}})), None),
        (2, 6, "assistant", None, calls(("later", "add", {"a": {"$ref": "none"}})), None), (2, 7, "assistant", None, "{not json", None),
        (None, 1, "assistant", None, calls(("n", "add", {"a": 1})), None), (None, 2, "tool", "r", None, "n"),
    ]
    got = {(r.conv_id, r.turn, r.seq, r.call_id, r.result_turn): r for r in run(spark, rows)}
    assert len(got) == 16
    one = got[1, 1, 1, "a", 2]
    assert (one.status, one.level, one.valid, one.json) == ("linked", 0, True, '{"arguments":{"a":1.5,"b":2},"id":"a","name":"add","result":"é\\n","status":"linked"}')
    assert (got[1, 1, 2, "b", 3].level, got[1, 1, 0, "c", None].level, got[1, 1, 2, "b", 3].status) == (1, 2, "linked")
    assert got[1, 4, 0, "a", None].status == "repeated_call" and got[1, None, None, "a", 3].status == "repeated_result"
    assert got[1, 4, 1, "d", None].problems == "unknown_tool" and got[1, None, None, "d", 0].status == "orphan_result"
    assert got[1, 4, 2, "e", None].problems == "$.a:required,$.b:minimum,$.x:additionalProperties"
    assert (got[2, 5, 0, "x", None].level, got[2, 5, 1, "y", None].problems, got[2, 5, 2, "z", None].problems) == (-1, "cycle", "later_ref:later")
    assert got[2, 6, 0, "later", None].problems == "unknown_ref:none" and got[2, 7, 0, None, None].problems == "unreadable"
    assert got[2, None, None, "a", 1].status == "orphan_result"
    assert got[None, 1, 0, "n", None].status == "no_result" and got[None, None, None, "n", 2].status == "orphan_result"
    assert run(spark, []) == []


def test_canonical_json_round_trips_and_is_one_form():
    for v in ({"b": 1, "a": [1.0, 2.5, None, True, "\u2028é\"\\"]}, [], 1e300, -0.5):
        text = chat.canonical(v)
        assert json.loads(text) == v and chat.canonical(json.loads(text)) == text
    assert chat.canonical({"b": 1.0, "a": 2}) == chat.canonical({"a": 2.0, "b": 1})


def test_levels_are_topological():
    assert chat.levels([{1, 2}, {2}, set(), {3}, {3, 0}]) == [2, 1, 0, -1, -1]


def test_odd_json_is_unreadable_and_repeats_are_told_apart(spark):
    one = calls(("a", "add", {"a": 1}))
    rows = [
        (1, 1, "assistant", None, '[{"id": "\\ud800", "name": "add"}]', None), (1, 2, "assistant", None, '[{"id": "x", "name": "add", "arguments": {"a": 1e999}}]', None),
        (1, 3, "assistant", None, json.dumps([{"id": "y", "name": "add", "arguments": '{"a": "\\udfff"}'}]), None), (1, 4, "assistant", None, "[" * 100_000, None),
        (1, 5, "assistant", None, '[{"id": "z", "name": "add", "arguments": {"a": ' + "9" * 5000 + "}}]", None), (1, 6, "assistant", None, "[1]", None),
        (2, 1, "assistant", None, one, None), (2, 1, "assistant", None, one, None), (2, 1, "assistant", None, calls(("a", "add", {"a": 0})), None), (2, 2, "tool", "r", None, "a"),
    ]
    got = run(spark, rows)
    assert [r.problems for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)] == ["unreadable"] * 6
    assert sorted((r.status, json.loads(r.json)["arguments"]["a"]) for r in got if r.conv_id == 2) == [("linked", 0), ("repeated_call", 1), ("repeated_call", 1)]


def plain(messages, schemas):
    """(conv_id, turn, seq, call_id, level, status, result_turn, problems) by loops over one conversation at a time."""
    out = []
    for conv in {m.conv_id for m in messages}:
        mine = sorted((m for m in messages if m.conv_id == conv), key=lambda m: m.turn)
        first, taken, rows = {}, {}, []
        for m in mine:
            if m.tool_call_id is not None:
                early = m.tool_call_id in first and first[m.tool_call_id][0] < m.turn
                status = ("repeated_result" if m.tool_call_id in taken else "linked") if early else "orphan_result"
                if status == "linked":
                    taken[m.tool_call_id] = m.turn
                else:
                    out.append((conv, None, None, m.tool_call_id, None, status, m.turn, ""))
            listed = json.loads(m.tool_calls) if m.tool_calls else []
            ids = {c["id"] for c in listed}
            needs = [{v["$ref"] for v in json.loads(c["arguments"]).values() if isinstance(v, dict)} for c in listed]

            def depth(i, seen=()):
                if i in seen:
                    return None
                below = [depth(k, (*seen, i)) for k, c in enumerate(listed) if c["id"] in needs[i] and [x["id"] for x in listed].index(c["id"]) == k]
                return None if None in below else max((b + 1 for b in below), default=0)

            for i, c in enumerate(listed):
                level, args = depth(i), json.loads(c["arguments"])
                bad = chat.violations(args, schemas[c["name"]]) if c["name"] in schemas else ["unknown_tool"]
                bad += ["cycle"] if level is None else []
                bad += sorted(("later_ref:" if r in first else "unknown_ref:") + r for r in needs[i] - ids if r not in first or first[r][0] >= m.turn)
                rows.append([conv, m.turn, i, c["id"], -1 if level is None else level, "repeated_call" if c["id"] in first else "call", ",".join(bad)])
                first.setdefault(c["id"], (m.turn, i))
        for conv_, turn, i, call_id, level, status, bad in rows:
            own = status == "call"
            out.append((conv_, turn, i, call_id, level, ("linked" if call_id in taken else "no_result") if own else status, taken.get(call_id) if own else None, bad))
    return sorted(map(str, out))


def test_conversations_as_traffic(spark, small):
    traffic = chat.as_tool_messages(spark.read.parquet(f"{small}/conversations.parquet"))
    linked = chat.link(traffic, chat.REPLY_SCHEMAS)
    assert "ShuffledHashJoin" in linked._jdf.queryExecution().toString()
    got = linked.collect()
    assert sorted(str((r.conv_id, r.turn, r.seq, r.call_id, r.level, r.status, r.result_turn, r.problems)) for r in got) == plain(traffic.collect(), chat.REPLY_SCHEMAS)
    assert {r.level for r in got} >= {-1, 0, 1, 2} and {r.status for r in got} >= {"linked", "no_result", "repeated_call"}
    assert {"cycle", "unknown_tool", "$.limit:minimum", "$.extra:additionalProperties"} <= {p for r in got for p in r.problems.split(",")}
    texts = {(r.conv_id, r.turn): r.text for r in traffic.collect()}
    for r in got:
        one = json.loads(r.json)
        assert chat.canonical(one) == r.json and r.valid == (not r.problems)
        if r.status == "linked":
            assert one["arguments"]["prompt"] == texts[r.conv_id, r.turn] and one["result"] == texts[r.conv_id, r.result_turn]


def test_large_batches_are_read_and_written_in_slices(spark, monkeypatch):
    kind, fs = type(spark.range(1)), []
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: fs.append(f) or through(self, f, schema))
    assert run(spark, []) == []
    sizes = [10, 200_000, 9_000_000, None, *[50_000] * 120, *[10] * 3000]
    texts = [n and calls((f"c{i}", "add", {"a": "x" * n})) for i, n in enumerate(sizes)]
    n, kept = len(sizes), sum(x is not None for x in sizes)
    read, write = fs
    whole = pa.RecordBatch.from_pydict({"conv_id": [1] * n, "turn": list(range(n)), "tool_calls": pa.array([x or "[]" for x in texts], pa.string())})
    out = list(read([whole.slice(3), whole.slice(0, 3), whole.slice(0, 0)]))
    assert all(b.num_rows == 1 or b.nbytes < 6 << 20 for b in out) and len(out) > 4
    seen = {c: json.loads(a)["a"] for b in out for c, a in zip(b.column("call_id").to_pylist(), b.column("arguments").to_pylist())}
    assert seen == {f"c{i}": "x" * x for i, x in enumerate(sizes) if x is not None} and len(seen) == kept
    rows = {c: pa.array([v] * n, pa.string()) for c, v in (("call_id", "c"), ("name", "add"), ("status", "linked"), ("problems", ""), ("arguments", None))}
    rows["result"] = pa.array([x and "x" * x for x in sizes], pa.string())
    out = list(write([pa.RecordBatch.from_pydict(rows)]))
    assert all(b.num_rows == 1 or b.nbytes < 6 << 20 for b in out)
    assert [len(json.loads(j).get("result", "")) for b in out for j in b.column("json").to_pylist()] == [x or 0 for x in sizes]
