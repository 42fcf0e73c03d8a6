import gzip
import base64
import io
import json
import math
import os
import sqlite3
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import graph, ordered, vectors, visibility
from keelson.operators.bank import Bank
from keelson.sources import readers, sinks
from keelson.streaming import events


# -- vectors ---------------------------------------------------------------
VECTORS = [(1, [1.0, 0.0], 0, 5), (2, [1.0, 0.0], 1, 6), (3, [0.0, 1.0], 0, 7), (4, [0.0, 0.0], 0, 8), (5, [2.0, 2.0], 0, 9)]


def frame(spark, rows=VECTORS):
    df = spark.createDataFrame(rows, "id long, v array<double>, d long, t long")
    return vectors.prepared(df, "id", "v", F.col("d"), F.col("t"))


def test_search_ties_zero_vectors_and_filters(spark):
    x = frame(spark)
    q = x.where("id = 2")
    got = lambda **k: [(r["id"], r["score"]) for r in vectors.knn(x, q, 9, **k).orderBy("rank").collect()]
    assert got() == [(1, 1.0), (5, pytest.approx(math.sqrt(0.5))), (3, 0.0), (4, 0.0)]
    assert [i for i, _ in got(causal="strict", exclude_self=False)] == [1]
    assert [i for i, _ in got(causal="inclusive", exclude_self=False)] == [1, 2]
    assert got(same_domain=True) == []
    assert [i for i, _ in got(excluded={2: [1, 5]})] == [3, 4]
    assert [i for i, _ in got(metric="dot")] == [5, 1, 3, 4]
    assert vectors.knn(x.limit(0), q, 3).count() == 0 and vectors.knn(x, q.limit(0), 3).count() == 0


def test_search_in_blocks_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=4).round(1).tolist(), k % 3, k) for k in range(150)]
    x = frame(spark, rows).repartition(4)
    found = vectors.knn(x, x.where("id % 10 = 0"), 7, same_domain=True, queries_per_block=4).collect()
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v, _, _ in rows}
    for q in range(0, 150, 10):
        want = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i, _, d, _ in rows if i != q and d == q % 3)[:7]
        assert [(f["id"]) for f in sorted((f for f in found if f["query_id"] == q), key=lambda f: f["rank"])] == [i for _, i in want]


def test_hubness_formula(spark):
    counts = [0, 0, 1, 5]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(counts)], "id long, n long")
    mean, sd = np.mean(counts), np.std(counts, ddof=1)
    got = vectors.hubness(df).first()
    assert got["skewness"] == pytest.approx(np.mean((np.array(counts) - mean) ** 3) / sd**3)
    assert got["gini"] == pytest.approx(sum((2 * r - 5) * c for r, c in enumerate(sorted(counts), 1)) / (4 * 6)) and got["never_retrieved"] == 0.5 and got["max_share"] == pytest.approx(5 / 6)


# -- ordered ---------------------------------------------------------------
@pytest.mark.parametrize("width", [3, 1000])
def test_running_by_blocks(spark, width):
    r = np.random.default_rng(2)
    rows = [(int(k % 2), k, int(r.integers(0, 50))) for k in range(60)]
    out = ordered.running(ordered.running(spark.createDataFrame(rows, "k int, o long, v long"), ["k"], "o", F.col("v"), "max", width, "m"), ["k"], "o", F.col("v"), "sum", width, "s").collect()
    for r in out:
        before = [v for k, o, v in rows if k == r["k"] and o < r["o"]]
        assert r["m"] == (max(before) if before else None) and r["s"] == (sum(before) if before else None)


def test_capped_and_overlaps(spark):
    df = spark.createDataFrame([("a", k) for k in range(100)] + [("b", 1)], "g string, v int")
    assert sorted(tuple(r) for r in ordered.capped(df, ["g"], [F.col("v")], 3).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]
    left = spark.createDataFrame([("x", k, k + k % 7) for k in range(0, 60, 3)], "k string, a long, b long")
    right = left.select("k", F.col("a").alias("c"), F.col("b").alias("d"))
    rows = [tuple(r) for r in left.collect()]
    want = sorted((a, c) for _, a, b in rows for _, c, d in rows if a <= d and c <= b)
    for width in (1, 5, 100):
        assert sorted((r["a"], r["c"]) for r in ordered.overlaps(left, right, "k", width).collect()) == want


# -- graph -----------------------------------------------------------------
def test_composition_diamond_chain_and_cycle(spark):
    edges = [("top", "left", 1.0), ("top", "right", 3.0), ("left", "s1", 1.0), ("right", "s1", 1.0), ("right", "s2", 1.0), ("none", "s1", 0.0)]
    got = {(r["item"], r["source"]): r["share"] for r in graph.composition(spark.createDataFrame(edges, "item string, contributor string, weight double")).collect()}
    assert got[("top", "s1")] == pytest.approx(0.25 + 0.375) and got[("top", "s2")] == pytest.approx(0.375) and not any(i == "none" for i, _ in got)
    with pytest.raises(ValueError):
        graph.composition(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "item string, contributor string, weight double"), rounds=6)


def test_reachable_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "parent long, child long")
    assert sorted(r["node"] for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3]
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(chain).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_of_a_long_chain_in_few_rounds(spark):
    """The least node is at one end and the next at the other, so that labels meet in the middle; sizes of plans stay small."""
    path = [0, *range(200, 0, -1)]
    chain = spark.createDataFrame([*zip(path, path[1:]), (300, 300)], "a long, b long")
    got = graph.components(chain, rounds=10)
    assert int(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 64
    assert {r["node"]: r["root"] for r in got.collect()} == dict.fromkeys(path, 0) | {300: 300}


# -- visibility ------------------------------------------------------------
def test_versions_and_gc(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "k string, o int, born long")
    rows = {(r["k"], r["version"]): r["dead"] for r in visibility.versions(df, "k", ["o"], "born").collect()}
    assert rows == {("a", 1): 20, ("a", 2): 0, ("b", 1): 0}
    journal = spark.createDataFrame([("a", 1), ("a", 4), ("a", 9), ("b", 2)], "k string, c long")
    assert sorted(tuple(r) for r in visibility.retained(journal, "k", "c", 5).collect()) == [("a", 4), ("a", 9), ("b", 2)]


# -- bank ------------------------------------------------------------------
def rows_of(spark, ids, time=1, mass=1.0, space="A"):
    return spark.createDataFrame([(space, i, time, mass, [float(k + 1), 1.0], [f"src-{i}"]) for k, i in enumerate(ids)], "space string, id string, time long, mass double, key array<float>, sources array<string>")


def ids_of(df):
    return sorted(r["id"] for r in df.collect())


def test_bank_life(spark, tmp_path):
    bank = Bank.create(spark, f"file://{tmp_path}/bank", "d", ["A", "B"])
    assert bank.append(rows_of(spark, ["x", "y", "z"])) == 1
    for bad in (["x"], ["n", "n"], [""]):
        with pytest.raises(ValueError):
            bank.append(rows_of(spark, bad))
    with pytest.raises(ValueError):
        bank.append(rows_of(spark, ["q"], space="C"))
    assert bank.supersede(rows_of(spark, ["x"], time=0).drop("sources")) == 2
    now = {r["id"]: r for r in bank.current().collect()}
    assert now["x"]["version"] == 2 and now["x"]["time"] == 1 and now["x"]["sources"] == ["src-x"]
    assert bank.current(1).where("id = 'x'").first()["version"] == 1
    shares = spark.createDataFrame([("A", "y", "o1", 0.25), ("A", "y", "o2", 0.75), ("A", "z", "o1", 1.0)], "space string, input string, output string, share double")
    assert bank.rewrite(rows_of(spark, ["o1", "o2"]), shares) == 3
    now = {r["id"]: r for r in bank.current().collect()}
    assert sorted(now) == ["o1", "o2", "x"] and sum(r["mass"] for r in now.values()) == pytest.approx(3.0) and now["o1"]["mass"] == pytest.approx(1.25)
    comp = {(r["item"], r["source"]): r["share"] for r in bank.composition("A").collect()}
    assert comp[("o1@1", "src-y")] == pytest.approx(0.2) and comp[("o1@1", "src-z")] == pytest.approx(0.8) and comp[("x@2", "src-x")] == 1.0
    with pytest.raises(ValueError):
        bank.rewrite(rows_of(spark, ["o9"]), spark.createDataFrame([("A", "x", "o9", 0.5)], "space string, input string, output string, share double"))
    q = vectors.prepared(spark.createDataFrame([(0, [1.0, 1.0], 5)], "id long, v array<double>, t long"), "id", "v", None, F.col("t"))
    assert [(r["id"], r["rank"]) for r in bank.search("A", q, 2).orderBy("rank").collect()] in ([("o1", 1), ("x", 2)], [("x", 1), ("o1", 2)])
    assert bank.verify() == []
    other, history = bank.compact(f"file://{tmp_path}/compact")
    assert ids_of(other.current()) == ["o1", "o2", "x"] and history.count() == 3
    assert bank.delete(spark.createDataFrame([("A", "o1")], "space string, id string")) == 4 and ids_of(bank.current()) == ["o2", "x"]
    bank.rollback(2)
    assert ids_of(bank.current()) == ["x", "y", "z"] and bank.manifest()["cursor"] == 2
    assert bank.append(rows_of(spark, ["w"])) == 3 and ids_of(bank.current()) == ["w", "x", "y", "z"]
    with pytest.raises(Exception, match="no visible item"):
        bank.read("A", spark.createDataFrame([("gone",)], "id string")).collect()


def test_bank_ignores_files_that_no_manifest_names(spark, tmp_path):
    bank = Bank.create(spark, f"file://{tmp_path}/bank", "d", ["A"])
    bank.append(rows_of(spark, ["x"]))
    bank.current().write.parquet(f"{bank.root}/rows-2-lost")
    assert ids_of(bank.current()) == ["x"] and bank.verify() == []


def test_of_two_writers_the_second_fails_and_readers_always_find_a_manifest(spark, tmp_path):
    bank = Bank.create(spark, f"file://{tmp_path}/bank", "d", ["A"])
    before = bank.manifest()
    bank.append(rows_of(spark, ["x"]))
    with pytest.raises(RuntimeError, match="another writer"):
        bank._publish(before | {"cursor": 1, "commits": []})
    assert ids_of(bank.current()) == ["x"] and bank.manifest()["cursor"] == 1
    assert not [f for f in os.listdir(tmp_path / "bank") if f.startswith("_manifest")]
    with pytest.raises(FileExistsError):
        Bank.create(spark, f"file://{tmp_path}/bank", "d", ["A"])


def test_more_anchors_than_a_task_can_hold_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_ANCHORS", 2)
    x = vectors.prepared(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(3)], "id long, v array<double>"), "id", "v", None, None)
    for call in (lambda: vectors.knn_distances(x, x, 1), lambda: vectors.nearest(x, x, 1), lambda: vectors.folded(x, x, {})):
        with pytest.raises(ValueError, match="ask in blocks"):
            call()


def test_search_equals_brute_force_with_ties_and_filters(spark):
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, (300, 3)).astype(float)
    rows = [(k, x[k].tolist(), k % 4, k % 7) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, d long, t long").repartition(3)
    items = vectors.prepared(df, "id", "v", F.col("d"), F.col("t"))
    u = vectors.unit(x)
    for causal, same, most in ((None, False, None), ("strict", False, 0.9), ("inclusive", True, None)):
        got = {}
        for row in vectors.knn(items, items.where("id % 30 = 0"), 5, causal=causal, same_domain=same, most=most).collect():
            got.setdefault(row["query_id"], []).append((row["rank"], row["id"]))
        for q in range(0, 300, 30):
            seen = [k for k in range(300) if k != q and (not same or k % 4 == q % 4) and (causal is None or (k % 7 < q % 7 if causal == "strict" else k % 7 <= q % 7)) and (most is None or round(u[q] @ u[k], 9) <= most)]
            want = sorted(seen, key=lambda k: (-round(u[q] @ u[k], 9), k % 4, k))[:5]
            assert [k for _, k in sorted(got.get(q, []))] == want


# -- events ----------------------------------------------------------------
LOG = [("s", 0, "e0", 5, "c0"), ("s", 1, "e1", 7, "c1"), ("s", 1, "e1", 7, "c1"), ("s", 1, "e9", 7, "other"), ("s", 2, "e2", 6, "c2"), ("s", 4, "e4", 9, "c4"), ("t", 0, "f0", 1, None)]
WANT = {("e0", "committed"), ("e1", "committed"), ("e1", "retry"), ("e9", "conflict"), ("e2", "late"), ("e4", "gap"), ("f0", "committed")}


def test_event_outcomes_batch(spark):
    assert {(r["event_id"], r["outcome"]) for r in events.commits(spark.createDataFrame(LOG, events.EVENT)).collect()} == WANT


def test_event_outcomes_stream_over_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate((LOG[:2], LOG[2:5], LOG[5:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(events.EVENT.names, r))) for r in rows))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))  # files are taken by their time
    stream = spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = events.commits(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {(r["event_id"], r["outcome"]) for r in spark.table("decided").collect()} == WANT
    finally:
        q.stop()


def test_decayed_counts_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key string, step long"
    for k, rows in enumerate(([("a", 1), ("a", 1)], [("a", 3), ("b", 2)])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("key", "step"), r))) for r in rows))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = events.decayed_counts(stream, 0.5).writeStream.outputMode("update").format("memory").queryName("loads").start()
    try:
        q.processAllAvailable()
        last = {}
        for r in spark.table("loads").collect():
            last[r["key"]] = max(last.get(r["key"], (0, 0)), (r["step"], r["load"]))
        assert last == {"a": (3, 1.5), "b": (2, 1.0)}
    finally:
        q.stop()


# -- sources and sinks -------------------------------------------------------
def support(i, t=1, text=None):
    return {"record_id": i, "text": text or f"text {i}", "created_at": t, "kind": "k"}


def test_episodes_and_quarantine(spark, tmp_path):
    base = {"environment": "e", "query": "q", "answer": "a", "query_time": 5, "required_ids": ["r1"], "choices": ["a", "b"], "supports": [support("r1"), support("r2")]}
    rows = [base | {"episode_id": "ok"}, base | {"episode_id": "late", "supports": [support("r1", 5)]}, base | {"episode_id": "dup", "supports": [support("r1"), support("r1")]}, base | {"episode_id": "miss", "required_ids": ["zz"]}, base | {"episode_id": "choice", "answer": "c"}, base | {"episode_id": "two"}, base | {"episode_id": "two"}, base | {"episode_id": "empty", "supports": []}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    good, bad = readers.episodes(readers.json_lines(spark, str(tmp_path / "e.jsonl"), readers.EPISODE))
    assert [r["episode_id"] for r in good.collect()] == ["ok"]
    assert {r["episode_id"]: r["reason"] for r in bad.collect()} == {"late": "support_not_before_query", "dup": "repeated_support", "miss": "required_missing", "choice": "answer_not_in_choices", "two": "repeated_id", "empty": "no_supports"}


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"record_id": "x", "text": "t"}, {"record_id": "y", "text": "u"}], indent=1))
    assert readers.json_array(spark, str(tmp_path / "a.json"), readers.RECORD).count() == 2
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write(f"20200101\t{b64('a b')}\t{b64('A. B')}\nbroken line\n")
    good, bad = readers.dated_base64(spark, str(tmp_path / "w.tsv.gz"))
    assert [(str(r["date"]), r["text"]) for r in good.collect()] == [("2020-01-01", "A. B")] and bad.first()["malformed"] == 1
    for name, mode in (("t.tar.gz", "w:gz"), ("t.tar.bz2", "w:bz2"), ("t.tar", "w")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for member in ("in/a.txt", "in/b.md"):
                info = tarfile.TarInfo(member)
                info.size = 5
                tar.addfile(info, io.BytesIO(b"hello"))
        assert [(r["member"], bytes(r["content"])) for r in readers.members(spark, str(tmp_path / name), r"\.txt$").collect()] == [("in/a.txt", b"hello")]
    (tmp_path / "d.csv").write_bytes("original,desc\nName,Größe\n".encode("latin-1"))
    assert [tuple(r) for r in readers.described_columns(spark, str(tmp_path / "d.csv")).collect()] == [("name", "Größe")]
    db = sqlite3.connect(tmp_path / "x.sqlite")
    db.executescript("CREATE TABLE t(a TEXT, b INT); INSERT INTO t VALUES ('x', 1), ('y', 2), ('x', 3);")
    db.close()
    got = {r["col"]: r for r in readers.sqlite_tables(spark, str(tmp_path / "x.sqlite"), values=2).collect()}
    assert got["a"]["distinct_values"] == ["x", "y"] and got["b"]["distinct_values"] is None and got["a"]["n_rows"] == 3
    story = ["1 Mary went home.", "2 Where is Mary?\thome\t1", "1 Tom left.", "2 Who left?\tTom\t1"]
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(story)], "file string, n int, value string")
    got = sorted((r["story"], r["line"], r["answer"], r["support"]) for r in readers.numbered_stories(lines).collect() if r["answer"])
    assert got == [(1, 2, "home", [1]), (2, 2, "Tom", [1])]
    chunks = spark.createDataFrame([("p", 0, 2, "b"), ("p", 0, 1, "a"), ("p", 1, 1, "z")], "page string, file int, idx int, text string")
    assert readers.first_file_wins(chunks, "page", "idx", "file", "text").first()["text"] == "a\nb"


def test_corpus_sink(spark, tmp_path):
    records = spark.createDataFrame([("r1", "t", "d", 1, "k", None), ("r1", "t", "d", 1, "k", None), ("r2", "u", "d", 1, "k", None)], readers.RECORD)
    episode = {"episode_id": "e", "query_time": 5, "required_ids": ["r1"], "supports": [support("r1"), support("r2")]}
    eps = spark.createDataFrame([episode | {f.name: None for f in readers.EPISODE if f.name not in episode}], readers.EPISODE)
    m = sinks.write_corpus(records, {"train": eps}, f"file://{tmp_path}/c")
    assert m["sources"]["rows"] == 2 and m["splits"]["train"]["gold"] == {"1": 1} and (tmp_path / "c/manifest.json").exists()
    with pytest.raises(sinks.Refused):
        sinks.write_corpus(records.where("record_id = 'r1'"), {"train": eps}, f"file://{tmp_path}/d")
    clash = records.unionByName(spark.createDataFrame([("r1", "t", "d", 2, "k", None)], readers.RECORD))
    with pytest.raises(Exception, match="one identity"):
        sinks.unique_records(clash).collect()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "episode_id string")
    assert sinks.mix(ids("a"), {"o": ids("b", "c", "d")}, 2, 1).count() == 3
    with pytest.raises(sinks.Refused):
        sinks.mix(ids("a"), {"o": ids("a")}, 2, 1)
