import itertools
import json

import numpy as np
import pytest

from keelson.functions import messages as M
from keelson.functions import payloads as P
from keelson.functions.chunks import count_words


def test_layouts_and_reasons(spark):
    call = {"function": {"name": "f", "arguments": '{"b": 1, "a": 2}'}}
    tag = '<tool_call>{"arguments": {"a": 2, "b": 1}, "name": "f"}</tool_call>'
    rows = [
        ("hermes", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        ("twice", {"messages": json.dumps([{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a", "tool_calls": [call]}])}),
        ("calls", {"query": "q", "tools": "[]", "answers": json.dumps([{"name": "f", "arguments": {"a": 2, "b": 1}}])}),
        ("role", {"messages": [{"role": "alien", "content": "x"}]}), ("block", {"messages": [{"role": "user", "content": [{"type": "image"}]}]}), ("none", {}), ("quiet", {"messages": [{"role": "user", "content": "x"}]}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [("bad", "{"), ("null", None)], "k string, raw string")
    got = {r["id"]: r for r in M.normalized(df, "k", "raw").collect()}
    assert {k: r["reason"] for k, r in got.items() if r["reason"]} == {"role": "unknown_role", "block": "unknown_block", "none": "no_messages", "quiet": "no_answer", "bad": "malformed", "null": "malformed"}
    assert [tuple(m) for m in got["hermes"]["messages"]] == [("user", "q"), ("assistant", "a")]
    assert [tuple(m) for m in got["twice"]["messages"]] == [("user", "q"), ("assistant", f"a\n{tag}")]
    assert [m["role"] for m in got["calls"]["messages"]] == ["system", "user", "assistant"] and got["calls"]["messages"][2]["content"] == tag


def test_commands_needs_steps_and_faults():
    assert M.commands("```bash\n$ ls -l \\\n  /tmp\n# no\nls -l /tmp\n```\n```sql\nSELECT 1; -- x\n```") == ["ls -l /tmp", "SELECT 1"]
    assert M.need("task: a\ntask: b c\nmore", "task:") == "b c"
    assert M.earliest(["cat"], ["category", "a cat"]) == 1 and M.earliest(["dog"], ["x"]) is None
    assert M.faults([("user", "q"), ("assistant", "<tool_call>x</tool_call>"), ("tool", "r"), ("assistant", "a")], [0, 1, 2, 3]) == []
    assert M.faults([("tool", "r"), ("assistant", "<tool_call>x</tool_call>"), ("user", "")], [0, 2, 1]) == ["result_without_call", "call_without_result", "empty", "time_runs_back"]


def test_payloads():
    v = np.array([[0.0], [2.0], [4.0]])
    assert P.resample(v, 5).ravel().tolist() == [0, 1, 2, 3, 4] and P.resample(v, 1).ravel().tolist() == [2] and P.resample(v, 3) is not None
    assert P.mean_payload([v, v + 2], [1, 3]).ravel().tolist() == pytest.approx([1.5, 3.5, 5.5])
    scores = [0.3, -1.0, 2.0, 0.1]
    s = np.exp(scores)
    assert P.plan_probability(scores, [[2]]) == pytest.approx(s[2] / s.sum())
    brute = sum(s[a] / s.sum() * s[b] / (s.sum() - s[a]) for a, b in itertools.permutations(range(4), 2) if {a, b} == {0, 2})
    assert P.plan_probability(scores, [[0, 2], [2, 0], [0, 1, 2]]) == pytest.approx(brute)
    q = P.compaction_quality(np.eye(3) * 9, np.eye(3) * 9, 100, 40)
    assert q["failed"] == [] and q["saved"] == 0.6 and P.compaction_quality(np.eye(3) * 9, -np.eye(3) * 9, 100, 100)["failed"] == ["kl", "choice", "size"]


def test_texts():
    assert P.similarity("a b c d", "a b x d") == 0.75 and P.titles_agree("The  Cat!", "the cat sat") and not P.titles_agree("abc", "xyz") and P.folded("ﬁne—Art") == "fine art"
    assert P.prefix_target("One two three. Four five. Six.", 4, 5, count_words) == "One two three. Four five."
    assert P.prefix_target("a b c d e f g", 2, 4, count_words) == "a b c d" and P.prefix_target("a", 2, 4, count_words) is None
