import json
import random

import numpy as np
import pytest

from tessella.llm import toolcalls as C
from tessella.llm import topk as K
from tessella.llm.queries import QUERIES, TOOL_SCHEMAS, tool_messages


def held(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, queries, k):
    out = []
    for q, v in rows:
        if q in queries:
            scored = sorted(((-held(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in rows if i != q))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims,spread,k", [(1, 1, 3), (4, 1, 5), (8, 3, 5), (64, 20, 20), (3, 0, 4)])
def test_maxscore_against_all_products(dims, spread, k):
    rng = random.Random(dims)
    for n in (1, 2, k, 60):
        rows = [(i * 3, [rng.randint(-spread, spread) if rng.random() < 0.7 else 0 for _ in range(dims)]) for i in range(n)]
        rng.shuffle(rows)
        shard = K.Shard(np.array([i for i, _ in rows]), np.array([v for _, v in rows]))
        got = []
        for q, v in rows:
            ids, scores = shard.top(q, np.array(v), k)
            got += [(q, r + 1, i, s) for r, (i, s) in enumerate(zip(ids.tolist(), scores.tolist(), strict=True))]
        assert sorted(got) == brute(rows, {i for i, _ in rows}, k)


def test_scores_are_whole_numbers(spark):
    ids, scores = K.Shard(np.array([0, 1, 9]), np.array([[6401, 0], [6400, 1], [6401, 0]])).top(9, np.array([6401, 1]), 2)
    assert (ids.tolist(), scores.tolist()) == ([0, 1], [40972801, 40966401])
    rng = random.Random(4)
    for spread in (100.0, 1e9, 1e12, 1e300):
        rows = [(i, [rng.choice([rng.uniform(-spread, spread), rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        codes = [(i, [held(int(np.floor(64 * x))) for x in v]) for i, v in rows]
        got = sorted(tuple(r) for r in K.exact_top_k(df, df["vec_id"] % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(codes, {0, 20, 40}, 20)


def test_postings_are_skipped():
    rng = random.Random(9)  # few vectors hold the strong term, so lists of weak terms are not traversed
    vectors = [[1000 if i % 50 == 0 else 0, *(rng.randint(0, 3) for _ in range(5))] for i in range(2000)]
    shard = K.Shard(np.arange(2000), np.array(vectors))
    shard.lists = {t: rows for t, rows in shard.lists.items() if t[0] == 0}
    ids, _ = shard.top(-1, np.array([5, 1, 1, 1, 1, 1]), 10)
    assert ids.tolist() == [i for _, _, i, _ in brute([(-1, [5, 1, 1, 1, 1, 1]), *enumerate(vectors)], {-1}, 10)]


def test_search_of_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [0.5, None], "x"), (302, [float("nan")] * 6, "x"), (303, [float("inf")] * 6, "x"), (None, [0.1] * 6, "x"), (304, [0.5, -0.5], "x"), (305, [], "x"), (7, rows[7][1], "x"), (400, rows[9][1], "x"), (401, rows[9][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    ask = df["vec_id"] % 20 == 0
    fit = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = brute(sorted(fit.items()), {i for i in fit if i % 20 == 0}, 20)
    for shard, block in ((10_000, 1000), (40, 3)):
        got = K.exact_top_k(df, ask, shard=shard, block=block)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert K.exact_top_k(df.limit(0), ask).collect() == []


def call(i, name="search", arguments='{"query":"q","limit":1}', after=None):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments, "after": after}]})


def result(i, content="r"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_levels_of_calls_with_several_parents(spark):
    rng, rows, want = random.Random(2), [], {}
    for n in range(60):
        ups = rng.sample(range(n), min(n, rng.choice((0, 1, 1, 2, 3))))
        rows.append((None if n < 0 else 1, n, "assistant", call(f"c{n}", after=[f"c{u}" for u in ups] if len(ups) != 1 else f"c{ups[0]}")))
        want[f"c{n}"] = 1 + max((want[f"c{u}"] for u in ups), default=-1)
    rows += [(2, 0, "assistant", call("x", after=["y", "gone"])), (2, 1, "assistant", call("y", after="x")), (2, 2, "assistant", call("z", after=["r", "x"])), (2, 3, "assistant", call("r", after="[")), (None, 1, "assistant", call("n", after=["m", "m"])), (None, 2, "assistant", call("m"))]
    got = C.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), TOOL_SCHEMAS).collect()
    assert {r["call_id"]: r["level"] for r in got} == want | {"x": None, "y": None, "z": None, "r": 0, "m": 0, "n": 1}


def test_odd_arguments(spark):
    odd = ['{"limit":1e999}', "[" * 100_000 + "]" * 100_000, '{"query":"\\ud800","limit":1}', '{"\\udfff":1}', "NaN", "1" * 5000, "", "null", None]
    rows = [(1, n, "assistant", call(f"c{n}", arguments=a)) for n, a in enumerate(odd)] + [(1, 90, "tool", json.dumps({"tool_call_id": "c0", "content": "\ud83d x"}))]
    got = {r["call_id"]: r for r in C.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), TOOL_SCHEMAS).collect()}
    assert [got[f"c{n}"]["valid"] for n in range(len(odd))] == [n == 2 for n in range(len(odd))]
    assert all(got[f"c{n}"]["errors"] == "$: not JSON" for n in (0, 1, 4, 5, 6, 8))
    assert '"query":"\\ud800"' in got["c2"]["json"] and "\\udfff" in got["c3"]["errors"] and json.loads(got["c1"]["json"])["arguments"] is None


def test_linking(spark):
    rows = [
        (1, 5, "assistant", call("c", after="b")),
        (1, 1, "assistant", call("a")),
        (1, 3, "assistant", call("b", '{"x"', after="a")),
        (1, 2, "tool", result("a", "ü")),
        (1, 9, "tool", result("z")),
        (1, 1, "assistant", call("a")),
        (1, 4, "user", call("no")),
        (2, 0, "assistant", call("x", after="y")),
        (2, 1, "assistant", call("y", after="x")),
        (2, 2, "assistant", call("w", after="x")),
        (2, 3, "assistant", call("v", after="gone", arguments='{"query":"","limit":9,"more":1}')),
        (None, 0, "assistant", call("n", arguments="not json")),
        (None, 1, "tool", result("n")),
        (3, 0, "assistant", None),
        (3, 1, "assistant", '{"tool_calls": "odd"}'),
        (3, 2, None, "x"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = {(r["conv_id"], r["call_id"]): r for r in C.link_tool_calls(df, TOOL_SCHEMAS).collect()}
    assert {k: (r["level"], r["status"]) for k, r in got.items()} == {
        (1, "a"): (0, "linked"), (1, "b"): (1, "unanswered"), (1, "c"): (2, "unanswered"), (1, "z"): (None, "orphan"),
        (2, "x"): (None, "unanswered"), (2, "y"): (None, "unanswered"), (2, "w"): (None, "unanswered"), (2, "v"): (0, "unanswered"), (None, "n"): (0, "linked"),
    }
    a = got[1, "a"]
    assert a["copies"] == 2 and a["valid"] and a["json"] == '{"arguments":{"limit":1,"query":"q"},"id":"a","name":"search","result":"ü"}'
    assert got[1, "b"]["errors"] == "unknown name" and got[None, "n"]["errors"] == "$: not JSON"
    assert got[2, "v"]["errors"] == "$.limit: above maximum; $.more: not allowed; $.query: too short"
    assert C.link_tool_calls(df.limit(0), TOOL_SCHEMAS).collect() == []


def test_long_chain_and_hub(spark):
    calls = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)] + [(2, f"h{i}", ["h0"] if i else []) for i in range(300)]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in C.levels(spark.createDataFrame(calls, "conv_id long, call_id string, parents array<string>")).collect()}
    assert all(got[1, f"c{i}"] == i for i in range(300)) and all(got[2, f"h{i}"] == (i > 0) for i in range(300))


@pytest.mark.parametrize(
    "value,schema,want",
    [
        (True, {"type": "integer"}, ["$: not integer"]),
        (1.0, {"type": "number", "minimum": 2}, ["$: below minimum"]),
        ([1, "x"], {"type": "array", "items": {"type": "integer"}}, ["$[1]: not integer"]),
        ({"a": None}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "null"}}}, ["$.b: missing"]),
        ("x", {"enum": ["y"], "maxLength": 0}, ["$: not in enum", "$: too long"]),
        ({}, {}, []),
    ],
)
def test_schemas(value, schema, want):
    assert C.problems(value, schema) == want


def test_query_against_brute_force(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    calls, results = {}, {}
    for conv, turn, role, text in turns:
        if role == "user":
            calls[conv, f"c{conv}_{turn}"] = ("translate" if turn % 3 == 2 else "search", {"query": text, "limit": turn + 1}, f"c{conv}_{turn - 2}")
        else:
            results[conv, f"c{conv}_{turn - 1}"] = text

    def level(conv, i):
        up = calls[conv, i][2]
        return level(conv, up) + 1 if (conv, up) in calls else 0

    import hashlib

    want = {}
    for conv, i in calls.keys() | results.keys():
        name, arguments, _ = calls.get((conv, i), (None, None, None))
        written = json.dumps({"id": i, "name": name, "arguments": arguments, "result": results.get((conv, i))}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        valid = name == "search" and 1 <= len(arguments["query"]) <= 400 and arguments["limit"] <= 6
        want[conv, i] = (name, level(conv, i) if name else None, valid, hashlib.sha256(written.encode()).hexdigest())
    got = {(r["conv_id"], r["call_id"]): (r["name"], r["level"], r["valid"], r["json_sha256"]) for r in QUERIES["op8_tool_calls"](spark, sf_dir).collect()}
    assert got == want
    assert tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")).count() == len(turns)
