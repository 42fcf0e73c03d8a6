import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from keelson.llm import lm, queries, secrets, toxicity
from tests.llm.test_decontaminate import brute
from tests.llm.test_secrets_pii import brute_secrets
from tests.llm.test_simhash import brute_print, brute_roots
from tests.llm.test_tokens_packing import check_packing

SMALL = lm.Shape(outer=4, inner=4, single=10, least_buckets=1 << 8, block=512)


def tokens_of(text):
    return lm.lowered_words(text) + [lm.END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows):
    c = Counter(t for i, text in rows if not held(i) for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    return {(i, held(i), len(own := tokens_of(text)), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), 6)) for i, text in rows}


def shown(df):
    return {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()}


ROWS = [(k, f"word{k % 5} Common common w{k}") for k in range(60)] + [(60, None), (61, ""), (None, "common word1"), (5, "again"), (5, "again"), (62, "long " * 70000), (63, "é x y\x0bz")]


@pytest.mark.parametrize("head", [4, 1000])
def test_base_equals_brute_force_with_any_head(spark, head):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in ROWS], "doc_id long, text string, score double").repartition(3)
    out = lm.scores(df, head=head, shape=SMALL)
    assert shown(out) == brute_base(ROWS) and out.count() == len(ROWS)
    assert all(r["score"] < 0 for r in out.collect())
    assert lm.scores(df.limit(0), shape=SMALL).count() == 0


def test_only_held_out_rows(spark):
    out = lm.scores(spark.createDataFrame([(k, "a b") for k in range(40) if held(k)], "doc_id long, text string"), shape=SMALL)
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in out.collect()} == {(0, 0, 0.0)}


def trained(texts, shape=SMALL, steps=None):
    c = Counter(t for text in texts for t in tokens_of(text))
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    head = lm.Head([t for t, _ in top], [n for _, n in top], shape)
    sizes = np.array([len(tokens_of(t)) for t in texts])
    codes = head.codes([t for text in texts for t in tokens_of(text)])[1]
    hashes, leaves = lm.looked_up(head, codes, sizes)
    flat = tuple(np.zeros(lm.FEATURES * shape.buckets(len(codes)) * w, np.int64) for w in (shape.outer, shape.inner))
    lm.counted(hashes, leaves, shape, flat)
    seen = tuple(x.reshape(-1, w) for x, w in zip(flat, (shape.outer, shape.inner), strict=True))
    share = np.bincount(leaves, minlength=shape.leaves)
    return head, hashes, leaves, seen, share, lm.Model.of(seen, share, shape, np.full((2, lm.FEATURES, lm.BINS), 0.5) if steps is None else steps)


TEXTS = [f"the w{k % 7} of the w{k % 11} w{k % 7} again and the x{k}" for k in range(80)]


def test_model_is_a_distribution_over_leaves():
    head, hashes, _, _, _, model = trained(TEXTS)
    each = sum(np.exp(model.log_probability(hashes, np.full(hashes.shape[1], k), SMALL)) for k in range(SMALL.leaves))
    assert each == pytest.approx(np.ones(hashes.shape[1]), abs=1e-4)
    assert all(0 <= head.leaf(np.array([head.codes([t])[1][0]]))[0] < SMALL.leaves for t in (b"", b"the", b"never seen", b"\xff"))


def test_counts_and_weights_equal_brute_force():
    _, hashes, leaves, seen, share, model = trained(TEXTS)
    buckets = len(seen[0]) // lm.FEATURES
    rows = lm.rows_of(hashes, leaves % 4, buckets, 4)
    for level, own in enumerate((leaves % 4, leaves // 4)):
        want = np.zeros_like(seen[level])
        for f in range(lm.FEATURES):
            assert (rows[level][f] // buckets == f).all()
            for r, k in zip(rows[level][f].tolist(), own.tolist(), strict=True):
                want[r, k] += 1
        assert (want == seen[level]).all()
    assert (rows[1] % 4 == leaves % 4).all()
    prior = ((share + 1) / (share.sum() + len(share))).reshape(4, 4).T
    r = int(rows[0][1][5])
    want = 0.5 * np.log((seen[0][r] + SMALL.smooth * prior.sum(axis=1)) / ((seen[0][r].sum() + SMALL.smooth) * prior.sum(axis=1)))
    assert model.tables[0][r] == pytest.approx(want, abs=1e-5)


def test_slopes_are_those_of_the_likelihood_without_the_own_token():
    _, hashes, leaves, seen, share, model = trained(TEXTS)
    gathered = np.zeros((2, 2, lm.FEATURES, lm.BINS))
    model.log_probability(hashes, leaves, SMALL, gathered)

    def likelihood(steps):  # every token with its own count taken away
        rows = lm.rows_of(hashes, leaves % 4, len(seen[0]) // lm.FEATURES, 4)
        prior = ((share + 1) / (share.sum() + len(share))).reshape(4, 4).T
        total = 0.0
        for t in range(len(leaves)):
            for level, own in enumerate((leaves[t] % 4, leaves[t] // 4)):
                p = prior.sum(axis=1) if level == 0 else prior[leaves[t] % 4] / prior[leaves[t] % 4].sum()
                z = np.log(p)
                for f in range(lm.FEATURES):
                    s = seen[level][rows[level][f][t]].astype(float)
                    n = s.sum()
                    s[own] -= 1
                    z = z + steps[level, f, lm.bin_of(np.array([n - 1]))[0]] / 0.5 * 0.5 * np.log((s + SMALL.smooth * p) / ((n - 1 + SMALL.smooth) * p))
                total += z[own] - np.log(np.exp(z).sum())
        return total

    at = np.unravel_index(np.argmax(gathered[:, 1]), gathered[:, 1].shape)
    same_bin = [lm.bin_of(np.array([n]))[0] == lm.bin_of(np.array([n - 1]))[0] for n in seen[at[0]].sum(axis=1) if n]
    steps = np.full((2, lm.FEATURES, lm.BINS), 0.5)
    up, down = steps.copy(), steps.copy()
    up[at] += 1e-3
    down[at] -= 1e-3
    slope = (likelihood(up) - likelihood(down)) / 2e-3  # of the step; gathered is of its relative change
    assert gathered[at[0], 0, at[1], at[2]] * lm.UNIT == pytest.approx(0.5 * slope, rel=0.1, abs=0.5 + 5 * same_bin.count(False) / len(same_bin))


def test_steps_follow_the_slopes():
    gathered = np.zeros((2, 2, lm.FEATURES, lm.BINS))
    gathered[0, 0, 0, 3], gathered[0, 1, 0, 3] = 1e6, 1e6
    gathered[1, 0, 2, 1], gathered[1, 1, 2, 1] = -1e9, 1e9
    steps = lm.moved(np.full((2, lm.FEATURES, lm.BINS), 0.5), gathered)
    assert steps[0, 0, 3] > 0.5 > steps[1, 2, 1] and (steps == 0.5).sum() == 2 * lm.FEATURES * lm.BINS - 2


def test_buckets_grow_with_the_input():
    assert [lm.Shape().buckets(n) for n in (0, 10**6, 10**9, 10**11)] == [1 << 15, 1 << 15, 1 << 16, 1 << 20]


def test_scores_do_not_depend_on_the_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [{r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm.scores(docs.repartition(n), shape=lm.Shape(least_buckets=1 << 10)).collect()} for n in (1, 7)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])


def test_query_learns_and_its_base_equals_brute_force(spark, sf_dir):
    rows = queries.QUERIES["op8_lm_scores"](spark, sf_dir).collect()
    out = [(x["score"], x["base_score"], x["n_tokens"]) for x in rows if x["held_out"]]
    assert sum(s - b for s, b, _ in out) / sum(n for _, _, n in out) > 0.05
    got = {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows}
    assert got == brute_base([(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_score_equals_the_model_by_hand(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    out = {r["doc_id"]: r["score"] for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, shape=SMALL).collect()}
    learn = [t for k, t in rows if not held(k)]
    head, _, leaves, _, _, model = trained(learn, steps=np.full((2, lm.FEATURES, lm.BINS), 0.55))
    c = Counter(t for text in learn for t in tokens_of(text))
    size, kinds = np.bincount(leaves, minlength=SMALL.leaves), np.bincount(head.leaves, minlength=SMALL.leaves)
    for k, text in rows[::9]:
        own = tokens_of(text)
        codes = head.codes(own)[1]
        hashes, leaf = lm.looked_up(head, codes, np.array([len(own)]))
        want = model.log_probability(hashes, leaf, SMALL).sum() / math.log(10) + sum(math.log10((c[t] + 1) / (size[j] + kinds[j] + 1)) for t, j in zip(own, leaf, strict=True))
        assert out[k] == pytest.approx(want, rel=1e-6)


def test_contexts_stay_in_their_document():
    codes = np.array([5, 6, 7, 0, 5, 6, 0], np.int32)
    f = lm.contexts(codes, lm.firsts(np.array([4, 3])))
    assert lm.firsts(np.array([4, 3, 1])).tolist() == [0, 1, 2, 2, 0, 1, 2, 0]
    assert f[:, 0].tolist() == f[:, 4].tolist() and f[:, 1].tolist() == f[:, 5].tolist() and f[:, 3].tolist() != f[:, 6].tolist()
    assert lm.contexts(codes[:0], lm.firsts(np.zeros(0, np.int64))).shape == (3, 0)


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    after = []
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.durable(stage(spark, df, sf_dir))
        assert df.columns == docs.columns
        after.append({r["doc_id"]: r for r in df.collect()})
    model = toxicity.train(docs, labels)
    assert set(after[0]) == {i for i, r in rows.items() if model.score(r["text"])[0] < 0.7}
    ids = sorted(after[0])
    roots = brute_roots([brute_print(rows[i]["text"]) for i in ids])
    least = {}
    for i, root in zip(ids, roots, strict=True):
        least.setdefault(root, i)
    assert set(after[1]) == set(least.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(after[2]) == {i for i in after[1] if not brute(rows[i]["text"], items)[4]}
    assert set(after[3]) == set(after[2])
    for i, r in after[3].items():
        assert r["n_chars"] == len(r["text"])
        if not brute_secrets(rows[i]["text"]) and secrets.MARK not in r["text"]:
            assert r["text"] == rows[i]["text"]
        else:
            assert secrets.MARK in r["text"] and not brute_secrets(r["text"].replace(secrets.MARK, ""))
    got = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()]
    check_packing([(i, r["text"]) for i, r in after[3].items()], got, 1024)


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf_dir):
    rows = [(1, "some clean words here", "en", "s", 5, "x"), (2, None, None, None, None, "y"), (3, "", "en", "s", 0, "z"), (None, "words without an id", "en", "s", 3, "w"), (1, "some clean words here", "en", "s", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, predicted string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.durable(stage(spark, df, sf_dir))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "predicted"]
    assert sorted(((r["doc_id"], r["predicted"]) for r in df.collect()), key=repr) == [(1, "x"), (2, "y"), (None, "w")]
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir) if stage is not corpus_pipeline.pack_sequences else empty
    assert empty.count() == 0 and corpus_pipeline.pack_sequences(spark, empty, sf_dir).count() == 0
