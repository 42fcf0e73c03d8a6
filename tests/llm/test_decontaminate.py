import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import decontaminate, queries


def brute(text, items, window=13):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for name, other in items:
        own = decontaminate.words_of(other)
        m = min(window, len(own))
        for a in range(len(own) - m + 1 if m else 0):
            for b in range(len(words) - m + 1):
                if words[b : b + m] == own[a : a + m]:
                    hit.update(range(b, b + m))
                    found.add(str(name))
    n = len(words)
    return n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n


WORDS = st.lists(st.sampled_from(["a", "B", "c1", "é", "ß,d"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=4), st.sampled_from([1, 2, 3, 5]))
def test_search_equals_brute_force(text, others, window):
    words, found = decontaminate.words_of(text), set()
    for s in decontaminate.searches(list(enumerate(others)), window):
        for at, items in s.find(words):
            found.update((at + k) for k in range(s.m))
            assert items
    assert len(found) == brute(text, list(enumerate(others)), window)[1]


def test_odd_rows(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None), (4, "!!"), (None, "never used words")]
    docs = [(1, "x ONE two three four five six seven eight nine ten eleven twelve thirteen y short-item", 3), (2, None, 0), (3, "", 0), (4, "never used words", 0), (4, "never used words", 0), (None, "a short item", 1), (5, "pad " * 400 + "short item", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, [x for x in items if x[0] is not None])) for i, t, _ in docs), key=repr)
    for size in (10, 8_000_000):  # many blocks, one block
        assert sorted(map(tuple, decontaminate.contamination(df, bench, block_bytes=size).collect()), key=repr) == want
        kept = decontaminate.decontaminated(df, bench, block_bytes=size)
        assert kept.columns == df.columns and sorted(((r["doc_id"], r["n_hit"]) for r in kept.collect()), key=repr) == sorted(((d[0], d[2]) for d, w in zip(docs, [brute(t, [x for x in items if x[0] is not None]) for _, t, _ in docs], strict=True) if not w[4]), key=repr)
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == 7 and decontaminate.decontaminated(df.limit(0), bench).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(df, bench.limit(0)).collect()] == [0] * 7
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", ["op6_decontamination", "op7_url_filter", "op9_topk_histogram"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
