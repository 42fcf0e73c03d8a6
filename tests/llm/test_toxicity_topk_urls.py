import math
import random

import pytest

from keelson.llm import topk, toxicity, urls


def test_sentences_are_located():
    text = "One two. Three!\nFour ... five"
    assert [text[a:b] for a, b in toxicity.sentences(text)] == ["One two.", " Three!\n", "Four ...", " five"]
    assert not list(toxicity.sentences(None)) and not list(toxicity.sentences(" \n "))


def toy(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for k in range(n):
        words = [r.choice(plain) + (". " if r.random() < 0.1 else "") for _ in range(120)]
        if bad := k % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["zorgo", "zorgina", "quux"]))
        rows.append((" ".join(words), int(bad)))
    return rows


def test_learns_from_document_labels_and_locates_the_sentence():
    model = toxicity.fit(toy(500, 1))
    held = toy(300, 2)
    guess = [model.score(t)[0] >= 0.7 for t, _ in held]
    assert sum(g == bool(y) for g, (_, y) in zip(guess, held, strict=True)) >= 285
    text, _ = held[0]
    score, _, a, b, worst = model.score(text)
    assert score >= worst > 0.5 and any(w in text[a:b] for w in ("zorg", "quux"))


def test_noisy_or():
    model = toxicity.Model(-2.0, {"bad": 3.0})
    p, q = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(2))
    assert model.score("Bad here. Fine here.")[0] == pytest.approx(1 - (1 - p) * (1 - q))


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "bad bad", 0.5), (1, "bad bad", 0.5), (None, "bad", 0.0), (2, None, 0.0), (3, "", 0.0), (4, " \n", 0.0), (5, "fine. " * 30000 + "bad", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = toxicity.toxicity(df, toxicity.Model(-12.0, {"bad": 15.0})).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert toxicity.toxicity(df.limit(0), toxicity.Model()).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    import zlib

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(5, 1), (None, 1), (6, None)], "id long, label int")
    from pyspark.sql import functions as F

    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    got = toxicity.labelled_sample(docs, labels, usable, 50, 10**6)
    assert len(got) == 50
    ids = [int(t.split()[1]) for t, _ in toxicity.labelled_sample(docs, labels, usable, 1000, 10**6)]
    assert sorted(ids) == [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sum(len(t) for t, _ in toxicity.labelled_sample(docs, labels, usable, 1000, 100)) <= 100


def test_a_very_long_text_does_not_empty_the_sample(spark):
    from pyspark.sql import functions as F

    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    first = spark.range(300).where(usable).orderBy(F.xxhash64("id")).limit(2).collect()
    huge, large = (r["id"] for r in first)
    docs = spark.createDataFrame([(k, "x" * {huge: 50_000, large: 19_000}.get(k, 20)) for k in range(300)], "id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "id long, label int")
    n = spark.range(300).where(usable).count()
    got = toxicity.labelled_sample(docs, labels, usable, 1000, 20_000, 1000)
    assert len(got) == n - 2 and {y for _, y in got} == {0, 1}
    assert len(toxicity.labelled_sample(docs, labels, usable, 1000, 30_000, 1000)) == n - 1
    with pytest.warns(UserWarning, match="lacks a class"):
        toxicity.train(docs.where("id < 0"), labels, id_col="id", label_id_col="id", label_col="label")


def brute_top(rows, every, k, scale=64):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 1e4, 1e7])
def test_top_k_equals_brute_force(spark, big):
    r = random.Random(3)
    rows = [(k, [r.uniform(-big, big) for _ in range(6)]) for k in range(200)]
    rows += [(k, [0.5] * 6) for k in range(200, 330)]  # a tie over most of the table
    rows += [(400, None), (420, []), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (None, [0.1] * 6), (520, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == brute_top(rows, 20, 20)
    assert sorted(map(tuple, topk.top_k(df, queries_per_block=7, k=3).collect())) == brute_top(rows, 20, 3)
    assert topk.top_k(df.limit(0)).count() == 0


def test_url_parts_rules_and_list(spark):
    pages = [(1, "http://WWW.A.example.org/es/x?utm_source=q#t"), (2, "https://b.org"), (3, "https://example.org/en/12"), (4, "x://shop.com/fr/"), (5, "x://shop.com/de/1"), (6, None), (7, "no scheme"), (8, ""), (9, "http://casino-win.example.net/en/5/?utm_a=1&page=2"), (9, "http://casino-win.example.net/en/5/?utm_a=1&page=2"), (10, "https://other.net/en/5"), (11, "http://notexample.org/es/1"), (12, "http://www.casino-win.example.net/en/5?page=2#x")]
    df = spark.createDataFrame([(i, u, "v") for i, u in pages], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("casino-win.example.net/en/5?page=2",), ("casino-win.example.net/en/5?page=2",), (None,), ("b.org/x",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in urls.filter_urls(df, listed).collect()}
    assert got == {
        1: ("www.a.example.org", "/es/x", "example.org/es/", "block", False), 2: ("b.org", "", None, "allow", False), 3: ("example.org", "/en/12", "example.org/en/1", "block", False),
        4: ("shop.com", "/fr/", "com/fr/", "allow", False), 5: ("shop.com", "/de/1", "com/de/", "block", False), 6: ("", "", None, "allow", False), 7: ("", "", None, "allow", False), 8: ("", "", None, "allow", False),
        9: ("casino-win.example.net", "/en/5/", None, "block", True), 10: ("other.net", "/en/5", None, "allow", False), 11: ("notexample.org", "/es/1", "org/", "allow", False), 12: ("www.casino-win.example.net", "/en/5", None, "block", True),
    }
    assert urls.filter_urls(df, listed).count() == 13 and urls.filter_urls(df, listed.limit(0)).where("listed").count() == 0 and urls.filter_urls(df.limit(0), listed).count() == 0


def test_a_url_that_most_pages_share_is_dealt_out(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://a.net/x").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("http://b.net/"), "id")).alias("url"))
        out = urls.filter_urls(pages, urls.listed_urls(spark).unionByName(spark.createDataFrame([("a.net/x",)], "canonical string")))
        assert out.where("listed").count() == out.where("page_id % 3 = 0 AND verdict = 'block'").count() == 1334 and out.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert urls.listed_urls(spark).count() == urls.listed_urls(spark).distinct().count() == 667 * 6 * 3 * 2 * 4 * 2


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(3000).select(F.concat(F.lit("a.org/"), "id").alias("canonical"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), "id").alias("url"))
    out = urls.filter_urls(pages, listed, rules=())
    assert out.where("page_id < 3000 AND NOT (possible AND listed AND verdict = 'block')").count() == 0
    assert out.where("page_id >= 3000 AND (listed OR verdict = 'block')").count() == 0
    assert out.where("page_id >= 3000 AND possible").count() < 150


def test_filter_of_toxic_rows_equals_the_scores(spark):
    rows = [("a vile slur here. fine words", 1), ("fine words only", 0)] * 30
    model = toxicity.fit([(f"{t} number {k}", y) for k, (t, y) in enumerate(rows)], min_docs=2)
    df = spark.createDataFrame([(k, t, "p") for k, (t, _) in enumerate(rows)] + [(90, None, "p"), (None, "", "p"), (91, "fine words only", None)], "doc_id long, text string, predicted string")
    scored = {(r["doc_id"], r["predicted"]) for r in toxicity.toxicity(df, model).collect()}
    kept = toxicity.not_toxic(df, model)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, y in scored if not y), key=repr)
    assert 0 < kept.count() < df.count() and toxicity.not_toxic(df.limit(0), model).count() == 0
