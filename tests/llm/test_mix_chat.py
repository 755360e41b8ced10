"""Mixing, tool calls, and the pipeline."""
import json
import random

import pytest

from codeweave.llm import mixing, tool_calls

from .helpers import docs, words

# -- mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling, source by source: sizes by source name (None last)."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not full:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in full:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


def mix_rows():
    r = random.Random(4)
    rows = []
    for i in range(400):
        s = ["b", "a", "a", "a", "c", "é", None, "\U0001F600"][r.randrange(8)]
        rows.append((i, " ".join(words(i, r.choice([1, 3, 7, 20, 60, 60, 60, 300]))), s))
    return rows + [(900, None, "a"), (901, "", "empty"), (902, " \t x", "c"), (None, "x y z", "a"), (5, rows[5][1], rows[5][2]), (903, "w " * 20000, "b")]


def test_mix_meets_targets(spark):
    rows = mix_rows()
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    key = ("doc_id", "source", "size", "taken")
    assert sorted((tuple(r[k] for k in key) for r in got), key=repr) == sorted((tuple(r[k] for k in key) for r in again), key=repr)


def test_rates_are_the_tilt(spark):
    """Multipliers solve the dual: tilted, bounded rates meet each target."""
    import math
    hist = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (10, 20), (100, 5), (1000, 1))] + [("b", 7, 30), ("c", 5, 4)], "source string, size long, n long")
    t = spark.createDataFrame([("a", 76, 1750, 900.0), ("b", 30, 210, 300.0), ("c", 4, 20, 40.0)], "source string, n_docs long, source_size long, target double")
    lam = {r["source"]: r for r in mixing.balance(hist, t).collect()}

    def total(s):
        x = lam[s]
        return sum(r["n"] * r["size"] * min(2.0, math.exp(min(50, x["lam"] * r["size"] / x["scale"]))) for r in hist.collect() if r["source"] == s)
    assert total("a") == pytest.approx(900, rel=1e-6) and total("b") == pytest.approx(300, rel=1e-6) and lam["c"]["full"]


def test_mix_edge_tables(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    got = mixing.mix(docs(spark, [(1, None, None), (2, "", "x")])).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0)] * 2
    one = mixing.mix(docs(spark, [(i, "same size here", "x") for i in range(100)])).collect()
    assert sum(r["taken"] for r in one) == 450


# -- tool calls ------------------------------------------------------------------------------------

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parents array<string>, level string, schema string"
TOOLS = [("f", json.dumps({"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}))]


def link(spark, calls, results):
    c = spark.createDataFrame([(*x, "q", "r") for x in calls], CALLS)
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").selectExpr("*", "'q' AS status")
    return tool_calls.link(c, r, spark.createDataFrame(TOOLS, "name string, schema string"))


def test_links(spark):
    calls = [(1, "a", 1, "f", '{"x": 1.0}', []), (1, "b", 3, "f", '{"y":"\\u00e9","x":-1}', ["a", "zz", None]), (1, "c", 0, "f", "oops", ["b"]),
             (1, "d", 5, "g", "{}", None), (1, "a", 9, "f", "{}", []), (2, "a", 1, "f", None, []), (None, "n", 1, "f", "{}", []), (3, None, 1, "f", "{}", []),
             (4, "p", 1, "f", '{"x":1}', ["q"]), (4, "q", 2, "f", '{"x":1}', ["p"]), (4, "r", 3, "f", '{"x":1}', ["q"]), (4, "s", 4, "f", '{"x":NaN}', ["s"])]
    results = [(1, "a", 2, "ok"), (1, "a", 8, "late"), (1, "b", 4, None), (1, "x", 4, "who"), (None, "n", 2, "lost"), (9, "z", 1, "é\n\"")]
    got = link(spark, calls, results).collect()
    by = {(r["conv_id"], r["call_id"], r["status"]): r for r in got}
    assert len(got) == 14
    a = by[1, "a", "linked"]
    assert (a["turn"], a["result_turn"], a["n_calls"], a["n_results"], a["level"], a["valid"]) == (1, 2, 2, 2, 0, True)
    assert a["json"] == ('[{"role":"assistant","tool_calls":[{"function":{"arguments":{"x":1},"name":"f"},"id":"a","type":"function"}]},'
                         '{"content":"ok","role":"tool","tool_call_id":"a"}]')
    assert by[1, "b", "linked"]["errors"] == "$.x: under minimum; $.y: unknown" and by[1, "b", "linked"]["level"] == 1
    assert by[1, "c", "no_result"]["level"] == 2 and by[1, "c", "no_result"]["errors"] == "$: no JSON"
    assert by[1, "d", "no_result"]["errors"] == "$: unknown tool" and by[2, "a", "no_result"]["valid"] is False
    assert by[1, "x", "orphan_result"]["valid"] is None and by[9, "z", "orphan_result"]["json"] == '[{"content":"é\\n\\"","role":"tool","tool_call_id":"z"}]'
    assert {r["status"] for r in got if r["conv_id"] is None or r["call_id"] is None} == {"no_id"}
    assert {k: by[4, k, "no_result"]["level"] for k in "pqrs"} == dict.fromkeys("pqrs")  # in or behind a circle
    assert link(spark, [], []).collect() == []


def test_levels_brute(spark):
    r = random.Random(2)
    calls, want = [], {}
    for conv in range(6):
        order = list(range(25))
        r.shuffle(order)
        for i, k in enumerate(order):
            p = [str(order[j]) for j in {r.randrange(i) for _ in range(r.randint(0, 3))}] if i else []
            calls.append((conv, str(k), r.randint(0, 9), "f", "{}", p))
            want[conv, str(k)] = max((want[conv, x] + 1 for x in p), default=0)
    calls += [(50, str(i), 0, "f", "{}", [str(i - 1)]) for i in range(200)]  # a long chain takes few rounds
    want |= {(50, str(i)): i for i in range(200)}
    got = tool_calls.levels(spark.createDataFrame([(*x, "q", "r") for x in calls], CALLS)).collect()
    assert {(x["conv_id"], x["call_id"]): x["level"] for x in got} == want


def test_levels_of_cycles_end(spark):
    calls, free = [], {}
    for n in (3, 5, 6):
        calls += [(n, str(i), 0, "f", "{}", [str((i + 1) % n)]) for i in range(n)] + [(n, "behind", 0, "f", "{}", ["1"])]
        calls += [(n, "x", 0, "f", "{}", []), (n, "y", 0, "f", "{}", ["x"]), (n, "both", 0, "f", "{}", ["y", "2"])]
        free |= {(n, "x"): 0, (n, "y"): 1}
    # two cycles through one call, with a way out
    calls += [(9, "a", 0, "f", "{}", ["b", "d", "z"]), (9, "b", 0, "f", "{}", ["c"]), (9, "c", 0, "f", "{}", ["a"]), (9, "d", 0, "f", "{}", ["a"]), (9, "z", 0, "f", "{}", [])]
    got = tool_calls.levels(spark.createDataFrame([(*x, "q", "r") for x in calls], CALLS)).collect()
    assert {(x["conv_id"], x["call_id"]): x["level"] for x in got} == free | {(9, "z"): 0}


def test_canonical_json():
    c = tool_calls.canonical
    assert c({"\U0001F600": 1, "דּ": 2, "b": [None, True, False, "é\n\u0001/"]}) == '{"b":[null,true,false,"é\\n\\u0001/"],"😀":1,"דּ":2}'
    for x, t in ((1.0, "1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.0, "0"), (4.5, "4.5"), (-1.5e-10, "-1.5e-10")):
        assert c(x) == t and float(t) == x
    with pytest.raises(ValueError):
        c(float("nan"))


# -- pipeline -------------------------------------------------------------------------------------

def test_arguments_that_have_no_canonical_json(spark):
    deep = "[" * 20_000 + "]" * 20_000
    bad = {"big": '{"turn":1e400}', "half": '{"text":"\\ud800"}', "deep": deep, "levels": "[" * 150 + "]" * 150, "digits": "9" * 5000, "none": None, "nan": "[NaN]"}
    calls = [(1, k, i, "f", v, None) for i, (k, v) in enumerate(bad.items())] + [(1, "ok", 90, "f", '{"x":9007199254740993}', None), (1, "odd", 91, "broken", "5", None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, parents array<string>")
    r = spark.createDataFrame([(1, k, 95, "done") for k in bad], "conv_id long, call_id string, turn long, content string")
    tools = spark.createDataFrame([("f", '{"type":"object"}'), ("broken", "{no schema")], "name string, schema string")
    got = {x["call_id"]: x for x in tool_calls.link(c, r, tools).collect()}
    assert {k: got[k]["errors"] for k in got} == {
        "big": "$: number out of range", "half": "$: unpaired surrogate", "deep": "$: too deep", "levels": "$: too deep", "digits": "$: no JSON",
        "none": "$: no JSON", "nan": "$: no JSON", "ok": "", "odd": "$: bad schema"}
    assert '"arguments":{"x":9007199254740992}' in got["ok"]["json"]
    assert json.loads(got["half"]["json"])[0]["tool_calls"][0]["function"]["arguments"] == bad["half"]
    assert json.loads(got["deep"]["json"])[0]["tool_calls"][0]["function"]["arguments"] == deep


def test_pipeline_stages(spark):
    """Each stage against its own operator's (brute-force tested) decisions on sf0.001."""
    import corpus_pipeline as P
    from codeweave.llm import decontaminate, exact_dedup, simhash
    from codeweave.llm.common import load, stage
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "mixing"]
    d, kept = load(spark, sf, "documents"), []
    cols = d.columns
    for name, f in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} if name != "mixing" else None
        prior, d = d, stage(f(spark, d, sf), name)
        ids = {r["doc_id"] for r in d.select("doc_id").collect()}
        if name != "mixing":
            assert d.columns == cols and ids <= set(before)
        if name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
            assert ids == {min(g)[1] for g in groups.values()}
        if name == "simhash":
            n = simhash.near_duplicates(prior).collect()
            assert ids == {r["component_id"] for r in n}
        if name == "decontamination":
            assert ids == set(before) - {r["doc_id"] for r in decontaminate.contaminated(prior, load(spark, sf, "benchmark")).collect()}
        kept.append(len(ids))
    assert kept == sorted(kept, reverse=True) and kept[0] > 0.8 * 200 and kept[-1] == kept[-2]
    assert d.agg({"taken": "sum"}).first()[0] > 0
