import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from keelson.llm import simhash


def brute_print(text):
    words = simhash.lowered_words(text)
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(codes, limit=3):
    root = list(range(len(codes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(codes))]


def cluster(seed, centres, each, flips):
    r = random.Random(seed)
    out = []
    for _ in range(centres):
        c = r.getrandbits(64)
        out += [c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, flips))) for _ in range(each)]
    return sorted(set(out))


def test_fingerprint_equals_brute_force():
    for text in ("", None, "one", "one two", "A b c", "a b c a b c a b c", "é \u00a0x y\tz \x0b q", "w " * 5000 + "tail end"):
        assert simhash.fingerprint(text, block=777) == brute_print(text)


def test_gray_rank_is_the_place_in_gray_order():
    codes = np.array([k ^ (k >> 1) for k in range(4096)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(4096))


def test_index_finds_exactly_the_near_pairs():
    codes = np.array(cluster(1, 12, 40, 3) + cluster(2, 300, 1, 0), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    got = Counter()
    for i, j in simhash.GrayIndex(codes, fan=4).pairs(3, block=100):
        got.update(zip(i.tolist(), j.tolist(), strict=True))
    assert set(got) == want and set(got.values()) == {1}


def test_a_search_for_one_lead_finds_just_its_pairs():
    codes = np.array(cluster(5, 6, 200, 4), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    near = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3]
    for lead in (0, 16, 52):
        got = {(a, b) for i, j in simhash.GrayIndex(codes).pairs(3, lead, block=500) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i, j in near if not lead or int(codes[i] ^ codes[j]) >> (64 - lead) == 0}
    assert list(simhash.GrayIndex(codes[:0]).pairs(3)) == []


def test_memory_of_a_search_does_not_follow_the_pairs():
    codes = np.array(sorted({int(c) for c in np.random.default_rng(1).integers(0, 1 << 12, 4000)}), np.uint64)
    sizes = [len(i) for i, _ in simhash.GrayIndex(codes[np.argsort(simhash.gray_rank(codes))]).pairs(3, 52, block=4096)]
    assert max(sizes) <= 4096 and sum(sizes) == sum(int((np.bitwise_count(codes[k + 1 :] ^ codes[k]) <= 3).sum()) for k in range(len(codes)))


def test_each_level_of_views_brings_every_near_pair_together(spark):
    near = cluster(6, 1, 60, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in near]
    codes = spark.createDataFrame([(1, c, c) for c in signed], "tree int, view long, code long")
    for level in simhash.steps(3)[:3]:
        rows = simhash.views(codes, level, 3).collect()
        meet, ranks = {}, {}
        for r in rows:
            meet.setdefault((r["tree"], r["lead"]), set()).add(r["code"] % (1 << 64))
            ranks.setdefault(r["tree"], []).append((r["rank"] % (1 << 64), r["code"] % (1 << 64)))
        want = {(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 3}
        assert want <= {(a, b) for held in meet.values() for a in held for b in held if a < b}
        for held in ranks.values():  # a view keeps the distances
            view = [r ^ (r >> 1) for r, _ in held]
            assert all((view[i] ^ view[0]).bit_count() == (held[i][1] ^ held[0][1]).bit_count() for i in range(len(held)))
        view_of = lambda u: u ^ (u >> 1)
        back = [(r["tree"], view_of(r["rank"] % (1 << 64)), r["code"]) for r in rows]
        codes = spark.createDataFrame([(t, v - (1 << 64) if v >> 63 else v, c) for t, v, c in back], "tree int, view long, code long")


def test_links_connect_what_is_linked_in_small_and_hot_ranges(spark):
    codes = cluster(3, 10, 60, 2) + cluster(4, 200, 1, 0) + cluster(9, 1, 700, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    want = brute_roots(codes)
    groups = {}
    for c, k in zip(signed, want, strict=True):
        groups.setdefault(k, set()).add(c)
    for hot in (64, 8192):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, hot=hot)).collect()}
        got = {}
        for c in signed:
            got.setdefault(found.get(c, c), set()).add(c)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {1001: 1000}
    assert simhash.components(df.limit(0)).count() == 0


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here into the deep dark wood " * 12
    rows = [(9, base, 1), (4, base, 1), (4, base, 1), (7, base.replace("lazy", "Lazy"), 2), (1, "", 0), (2, None, 0), (None, "alone here with words", 0), (5, "something else entirely it is", 0), (5, "another text that has the same id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    codes = [brute_print(t) for _, t, _ in rows]
    roots = brute_roots(codes)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((i, f"{c:016x}", least.get(r)) for (i, _, _), c, r in zip(rows, codes, roots, strict=True)), key=repr)
    kept = simhash.one_of_each(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([1, 4, 5, 5, None], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    codes = [brute_print(t) for _, t in rows]
    roots = brute_roots(codes)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    got = sorted(map(tuple, simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    assert got == sorted((i, f"{c:016x}", least[r]) for (i, _), c, r in zip(rows, codes, roots, strict=True))


def test_shared_folder_is_the_named_one_or_the_session_s(spark):
    from keelson.llm import common

    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default: default)

    class Cluster(Unset):
        class sparkContext:
            master = "yarn"

            class _jsc:
                sc = staticmethod(lambda: Cluster.sparkContext)

            class getCheckpointDir:
                isEmpty = staticmethod(lambda: True)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == (named or common.shared_dir(spark))
    assert common.shared_dir(Unset).startswith(("/", "file:", "hdfs:"))
    assert common.durable(spark.range(3)).count() == 3
