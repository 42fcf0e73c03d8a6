import random

from keelson.functions import chunks as C
from keelson.plans import catalog
from keelson.plans.cut_queries import by_sentence


def test_sentence_chunks_are_placed_where_they_stand():
    r = random.Random(3)
    some = ["The same line of the record is said here once more, again.", "No.", "Other words stand here!", "x" * 900 + ".", "long " * 200 + "end."]
    texts = [" ".join([some[0]] * 60), *("  ".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(60))]
    for text in texts:
        tidied, at = C.tidy(text), 0
        want = [t for t, _ in C.packed(C.sentences(text), 800)]
        spans = list(by_sentence(text))
        assert [tidied[a:b] for a, b, _ in spans] == want
        for a, b, _ in spans:
            assert tidied[at:a] in ("", " ")
            at = b
        assert at == len(tidied)


def test_sentence_chunks_of_repeated_lines(spark, tmp_path):
    text = "The same line of the record is said here once more, again. " * 60
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["sentence_chunks"](spark, str(tmp_path)).collect()))
    assert len(got) > 3 and got[0][2] == 0 and got[-1][3] == len(text.strip())
    assert all(b[2] == a[3] + 1 for a, b in zip(got, got[1:], strict=False))
