import json
import random

import pytest
from pyspark.sql import functions as F

from keelson.functions import answers as A
from keelson.functions import chunks as C
from keelson.functions import html as HT
from keelson.functions import sqltext as S
from keelson.functions import stats
from keelson.functions import text as T
from keelson.operators import greedy as G


def test_packed_pieces_fit_and_lose_nothing():
    r = random.Random(1)
    for _ in range(200):
        parts = [" ".join("w" * r.randint(1, 12) for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 12))]
        out = list(C.packed(parts, 40))
        assert all(len(t) <= 40 for t, _ in out)
        assert " ".join(t for t, _ in out).replace(" ", "") == "".join(parts).replace(" ", "")
        assert sorted({k for _, ks in out for k in ks}) == list(range(len(parts)))


def test_lines_repeat_the_header_and_cut_what_is_too_long():
    assert list(C.packed_lines("H\n", ["a" * 30, "b", "c"], 10)) == ["H\n" + "a" * 7, "H\nb\nc"]


def test_windows_overlap_and_pieces_are_lossless():
    text = "one two\n\n" + " ".join(f"w{k}" for k in range(50))
    found = list(C.windows(text, 20, 5))
    assert text[found[0][0] : found[0][1]] == "one two" and found[0][2] == "paragraph"
    spans = [text[a:b].split() for a, b, rule in found if rule == "overlap"]
    assert all(len(s) <= 20 for s in spans) and spans[0][-5:] == spans[1][:5] and spans[-1][-1] == "w49"
    for limit in (1, 7, 1000):
        assert "".join(text[a:b] for a, b in C.pieces(text, limit, len)) == text
    assert list(C.windows("", 5, 1)) == [] == list(C.pieces("", 5))


def test_sentence_spans_know_short_forms_and_formulas():
    text = "See Fig. 2 for more. It holds that $a. b$ is so. End"
    assert [text[a:b] for a, b in C.sentence_spans(text)] == ["See Fig. 2 for more.", "It holds that $a. b$ is so.", "End"]
    assert C.context(text, 25, 100).startswith("See") and C.context(text, 25, 30) == "It holds that $a. b$ is so."
    assert C.word_bounds("alpha beta gamma", 7, 8) == (6, 10)


def test_dialogue_keeps_labels_and_owners():
    out = C.dialogue([("a: ", "One. Two."), ("b: ", ""), ("c: ", "Three. " * 10)], "P:", 40)
    assert all(t.startswith("P:") and len(t) <= 40 for t, _ in out) and out[0][1][0] == 0 and out[-1][1] == [2]


def test_html_lines():
    page = "<head><title>t</title></head><nav>menu</nav><p>Hello&nbsp;<b>you</b><sup>1</sup></p><div style='display: none'>x<br><p>y</p></div><table><tr><th>a</th><td>b &amp; c</td></tr></table>tail"
    assert HT.lines(page) == ["Hello you", "a | b & c", "tail"] and HT.lines(None) == []


NAMES = S.fresh_names(["singer", "name", "age", "Country", "singer_id", "cast", "role", "concert", "Free Count (K-12)"], 1)


@pytest.mark.parametrize("sql", [
    "SELECT T1.name, count(*) FROM singer AS T1 JOIN concert T2 ON T1.singer_id = T2.singer_id GROUP BY T1.name",
    "SELECT name FROM singer WHERE singer_id NOT IN (SELECT singer_id FROM concert) -- name\nORDER BY age DESC, name",
    "SELECT `Free Count (K-12)` / [age] FROM \"singer\" WHERE country = 'name' and role = \"France\"",
    "SELECT cast.role FROM cast, singer WHERE CAST(age AS REAL) > 3",
    "SELECT CASE WHEN age > 3 THEN name ELSE 'it''s' END FROM singer UNION SELECT max(age) - min(age) FROM concert",
])
def test_statements_rename_there_and_back(sql):
    new = S.aliased(sql, NAMES)
    assert not S.leftovers(new, S.inverse(NAMES)) and S.canonical(S.renamed(new, S.inverse(NAMES))) == S.canonical(sql)
    for kept in ("'name'", "count(*)", "CAST(", "-- name", "it''s", '"France"'):
        assert (kept in new) == (kept in sql)
    assert "".join(t.text for t in S.scan(sql)) == sql


@pytest.mark.parametrize("sql, reason", [
    ("SELECT name AS age FROM singer", "alias_collision"),
    ("SELECT * FROM singer name WHERE name.age > 3", "alias_collision"),
    ('SELECT * FROM singer WHERE name = "Name"', "quoted_literal_ambiguous"),
    ('SELECT * FROM singer WHERE role IN ("France", "Country")', "quoted_literal_ambiguous"),
    (f"SELECT {NAMES['name']}.age FROM singer AS {NAMES['name']}", "alias_roundtrip"),
])
def test_statements_with_two_readings_are_refused(sql, reason):
    with pytest.raises(S.Ambiguous) as caught:
        S.aliased(sql, NAMES)
    assert caught.value.reason == reason


def test_keyword_tables_definitions_and_prose():
    assert S.renamed("SELECT cast.role FROM cast", NAMES) == f"SELECT {NAMES['cast']}.{NAMES['role']} FROM {NAMES['cast']}"
    made = S.renamed_definition("CREATE TABLE IF NOT EXISTS \"singer\" (age name NOT NULL DEFAULT 'age', PRIMARY KEY (age), FOREIGN KEY (role) REFERENCES cast(role))", NAMES)
    assert made == f"CREATE TABLE IF NOT EXISTS \"{NAMES['singer']}\" ({NAMES['age']} name NOT NULL DEFAULT 'age', PRIMARY KEY ({NAMES['age']}), FOREIGN KEY ({NAMES['role']}) REFERENCES {NAMES['cast']}({NAMES['role']}))"
    assert S.leftovers("SELECT name FROM x2", S.inverse({"name": "x1", "singer": "x2"})) == {"name"}
    assert S.renamed_prose("the `name` of singer.name, first_name = 1, name here, 'name'", {"name": "n", "first_name": "f"}) == "the `n` of singer.n, f = 1, name here, 'name'"
    assert len(set(NAMES.values())) == len(NAMES) and S.fresh_names(["A", "b"], 1) == S.fresh_names(["b", "a", "B"], 1) != S.fresh_names(["a", "b"], 2)
    assert S.identifier_like("userId") and not S.identifier_like("user")
    for odd in ("", "'", '"a', "select (", ")", "/* x", "-- y"):
        assert S.renamed(odd, NAMES) == odd


def verdicts(spark, kind, cases):
    df = spark.createDataFrame([(p, json.dumps({"type": kind, **v})) for p, v, _ in cases], "p string, v string")
    return [r[0] for r in df.select(A.passes(F.col("p"), F.col("v"))).collect()], [w for _, _, w in cases]


def test_exact_answers(spark):
    cases = [("so\nAnswer: **1,000.0**.", "1000", True), ("answer: 12", "13", False), (r"thus \boxed{\frac{1}{2}} is", r"\frac{1}{2}", True), ("Answer: `Empty`", "empty", True), ("12 is wrong; the answer is 13", "12", False),
             ("The answers are listed.\nx\n7", "7", True), ("the final answer is &C &C A&.", "&C &C A&", True), ("Answer: **Wednesday**.\n\nAnswer:", "Wednesday", True), ("Answer: <true>", "True", True), ("", "", True), (r"\boxed{open", "open", False)]
    got, want = verdicts(spark, "exact", [(p, {"answer": a}, w) for p, a, w in cases])
    assert got == want


def test_calls(spark):
    gold = [{"name": "a", "arguments": {"x": 1, "y": [2]}}, {"name": "b", "arguments": {}}]
    cases = [('Calls: [{"name": "b", "arguments": {}}, {"name": "a", "arguments": {"y": [2], "x": 1}}]', True), ("<|call|>[b(), a(x=1, y=[2])]<|end|>", True), ("[a(1, y=[2]), b()]", False), ("[a(x=1, y=[2])]", False), ("no calls [here]", False),
             ('[{"name": "b", "arguments": "{}"}, {"name": "a", "arguments": {"x": 1, "y": [2]}}]', True), ("[a(x=2, y=[2]), b()]", False), ("[a(x=1, y=[2]), b(), b()]", False), ("[b(), a(x='1', y=[2])]", False)]
    got, want = verdicts(spark, "calls", [(p, {"calls": gold}, w) for p, w in cases])
    assert got == want
    got, want = verdicts(spark, "first_call", [("[a(x=1, y=[2]), c()]", {"call": gold[0]}, True), ("[b()]", {"call": gold[0]}, False), ("none", {"call": gold[1]}, False)])
    assert got == want
    assert next(A.call_lists("[f(s='it\\'s \"x\"', n=None, t=True, z=-1.5e3)]")) == [A.keys_of({"name": "f", "arguments": {"s": 'it\'s "x"', "n": None, "t": True, "z": -1500.0}})]


def test_values_and_roles(spark):
    rows = {"rows": [["Paris", 3.0], ["Lyon", 1.25], [None, None]]}
    got, want = verdicts(spark, "values", [("Paris (3) and Lyon (1.25)", rows, True), ("Paris (3)", rows, False), ("Paris 3 Lyon 1.25 " + "x " * 80, rows, False), ("It is 42.", {"rows": [[42]]}, True), ("It is 3.142 and Bob", {"rows": [[3.14159, "bob"]]}, True), ("It is 3.15 and Bob", {"rows": [[3.14159, "bob"]]}, False), ("", {"rows": []}, False)])
    assert got == want
    roles = {"names": ["Ann", "Bo"], "knights": [True, False]}
    got, want = verdicts(spark, "roles", [("(1) Ann is a knight\n(2) Bo is a knave", roles, True), ("Ann is a knave and Bo is a knave", roles, False), ("Ann is a knight", roles, False), ("Final: **Ann**: Knight; Bo - knave", roles, True)])
    assert got == want


def test_puzzles(spark):
    cases = [("Answer: 52.36", "576/11", "number", False), ("Answer: 1/3", "2/6", "number", True), ("Answer: 2.32", "2.3", "rounded", True), ("Answer: 2.36", "2.3", "rounded", False), ("Answer: [1, 4, 5, 6]", "[1, 4, 6, 5]", "list", False), ("Answer: (1.0, b)", "1, B", "list", True),
             ("Answer: b, a", "a, b", "set", True), ("Answer: 1 2\t3", "123", "spaceless", True), ("Answer: 1", "2", "", False), ("Answer: −1,200.5", "-2401/2", "number", True), ("Answer: 1/0", "0", "number", False)]
    got, want = verdicts(spark, "puzzle", [(p, {"answer": a, "family": f}, w) for p, a, f, w in cases])
    assert got == want


def test_checks_of_nothing_and_of_no_kind(spark):
    df = spark.createDataFrame([("x", None), (None, json.dumps({"type": "exact", "answer": "4"}))], "p string, v string")
    assert [r[0] for r in df.select(A.passes(F.col("p"), F.col("v"), ("exact",))).collect()] == [None, False]
    with pytest.raises(Exception, match="no such check"):
        spark.createDataFrame([("x", '{"type": "other"}')], "p string, v string").select(A.passes(F.col("p"), F.col("v"), ("exact",))).collect()


def test_greedy():
    assert G.within_budget([5, 9, 4, 2], [False, True, False, False], 15) == [True, True, False, False]
    assert G.within_budget([3, 20, 4], [False, False, False], 8) == [True, False, True]  # skipped, not stopped
    assert G.paced([3, 3, 3], 5, 3) == [True, False, False]
    assert G.grounded_order([("a", {"x", "y"}), ("b", {"z"})], {"z"}) == ["b", "a"]
    assert sum(G.capped_share([True] * 100, 0.2)) == 10


def test_budget_query_equals_brute_force(spark, sf_dir):
    from keelson.plans import cut_queries

    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        key = (r["l_orderkey"], r["l_linenumber"])
        rows[key] = max(rows.get(key, 0), r["l_quantity"])
    want, by = set(), {}
    for (o, n), q in sorted(rows.items()):
        by.setdefault(o, []).append((n, q))
    for o, lines in by.items():
        used = sum(q for n, q in lines if n == 1)
        want |= {(o, n) for n, _ in lines if n == 1}
        for n, q in lines:
            if n != 1 and used + q <= 60:
                used += q
                want.add((o, n))
    assert {(r["l_orderkey"], r["l_linenumber"]) for r in cut_queries.context_budget(spark, sf_dir).collect()} == want


def test_text_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  b\tc ",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.clean(F.col("t")), F.size(T.split_words(F.col("t"))), T.shingles(T.terms(F.col("t")), 2)).collect()]
    assert got == [("a b c", 3, ["a b", "b c"]), ("", 0, []), (None, 0, [])]
    one = spark.createDataFrame([("a",)], "t string").select(T.shingles(T.terms(F.col("t")), 8).alias("s")).first()
    assert one["s"] == ["a"]


def test_formulas_on_edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h")).collect()
    assert rows[0]["l"] is None and rows[1]["l"] == 0 and rows[2]["h"] == 1
    w = spark.createDataFrame([(0.0,), (0.0,)], "w double").agg(*[c.alias(k) for k, c in stats.effective_count(F.col("w")).items()]).first()
    assert tuple(w) == (0.0, 0.0, 0.0)
    w = spark.createDataFrame([(2.0,), (2.0,), (0.0,)], "w double").agg(*[c.alias(k) for k, c in stats.effective_count(F.col("w")).items()]).first()
    assert tuple(w) == pytest.approx((2.0, 2.0, 0.5))
