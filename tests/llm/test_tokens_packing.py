import struct
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import packing, queries, tokens

PATH = queries.byte_bpe_50k()
library = None


def reference_ids(text):
    global library
    if library is None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(PATH)
    return library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encode():
    return tokens.Encoder(tokens.read_definition(PATH))


ALPHABET = st.sampled_from(list("ab eé ñß'stre.,!?0123<|>\n\t  ") + ["<|endoftext|>", "'ll", "日本", "\u00a0", "\u2003", "\x1c", "\u200d", "Ω", "  \n", "don't", "\x85", "😀"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join))
def test_ids_equal_the_library(text):
    e = tokens.Encoder(tokens.read_definition(PATH)) if not hasattr(test_ids_equal_the_library, "e") else test_ids_equal_the_library.e
    test_ids_equal_the_library.e = e
    ids = e.ids(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=40, max_size=300).map("".join), st.sampled_from([40, 64, 100]), st.sampled_from([4, 20, 33]))
def test_spliced_counts_equal_the_whole(text, chunk, overlap):
    e = getattr(test_ids_equal_the_library, "e", None) or tokens.Encoder(tokens.read_definition(PATH))
    test_ids_equal_the_library.e = e
    assert e.count_spliced(text, chunk, overlap)[0] == len(reference_ids(text))


def test_one_endless_word_widens(encode):
    text = "a" * 500 + " " + "b" * 300
    n, _, widened = encode.count_spliced(text, 64, 16)
    assert n == len(reference_ids(text)) and widened


ROWS = [(1, "hello world", 5), (1, "hello world", 5), (2, None, 0), (3, "", 0), (None, "x y z", 1), (4, "the cat " * 9000, 2), (5, "it's <|endoftext|> end", 3)]
SCHEMA = "doc_id long, text string, n_tokens int"


def test_counts_of_odd_rows(spark):
    got = sorted(map(tuple, tokens.token_counts(spark.createDataFrame(ROWS, SCHEMA), PATH, chunk=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), (n := len(reference_ids(t or ""))), n > 512) for i, t, _ in ROWS), key=repr)
    assert got == want
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def check_packing(rows, got, capacity):
    want = Counter()
    for i, text in rows:
        ids = reference_ids(text or "") + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    assert Counter(r[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_is_a_partition_into_gapless_sequences(spark, capacity):
    rows = [(i, t) for i, t, _ in ROWS] + [(100 + k, "word " * (k % 23)) for k in range(120)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in packing.pack(df, PATH, capacity=capacity, rows_per_bucket=40).collect()]
    used = check_packing(rows, got, capacity)
    volume = sum(len(reference_ids(t or "")) + 1 for _, t in rows)
    assert used <= -(-volume // capacity) * 1.2 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8))
def test_bin_completion_never_loses_to_best_fit(counts):
    packed = packing.complete(counts, 30)
    held = Counter()
    for filling, n in packed:
        assert sum(filling) <= 30
        for k in filling:
            held[k] += n
    assert held == Counter(counts)
    bins = sum(n for _, n in packed)
    assert packing.lower_bound(counts, 30) <= bins <= sum(n for _, n in packing.best_fit(counts, 30))


def subsets(left):
    out = {()}
    for k, n in sorted(left.items(), reverse=True):
        out = {(*f, *([k] * m)) for f in out for m in range(n + 1)}
    return out


def packs(items, bins):
    if not items:
        return True
    return any(packs(items[1:], [*bins[:i], b - items[0], *bins[i + 1 :]]) for i, b in enumerate(bins) if b >= items[0])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 2), min_size=1, max_size=6), st.integers(1, 16))
def test_fillings_are_undominated_and_dominate_all_others(left, room):
    found = list(packing.fillings(room, left, effort=10**6))
    every = {f for f in subsets(left) if sum(f) <= room}
    assert set(found) <= every and len(set(found)) == len(found)
    assert [room - sum(f) for f in found] == sorted(room - sum(f) for f in found)
    for f in every:  # some filling found has room for its items, within its own items or beside them
        assert any(packs(f, [*g, room - sum(g)]) for g in found)
    for f in found:  # nothing that is left over can take the place of a part of it
        rest = Counter(left) - Counter(f)
        for n in range(len(f) + 1):
            for part in combinations(f, n):
                assert not any(rest[x] and sum(part) <= x <= sum(part) + room - sum(f) and (n > 1 or x > sum(part)) for x in rest)


def optimum(counts, capacity):
    items = sorted(Counter(counts).elements(), reverse=True)
    return next(n for n in range(packing.lower_bound(counts, capacity), len(items) + 1) if packs(items, [capacity] * n))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(2, 20), st.integers(1, 2), min_size=1, max_size=6))
def test_bin_completion_finds_the_optimum_of_small_tables(counts):
    assert sum(n for _, n in packing.complete(counts, 20)) == optimum(counts, 20)


def test_bin_completion_beats_best_fit_where_it_is_known_to_fail():
    # best-fit decreasing needs 3 for (6, 5, 4, 3, 2... ) style lists; completion finds the two full sequences
    counts = Counter([6, 5, 5, 4, 4, 3, 3])
    assert sum(n for _, n in packing.complete(counts, 15)) == 2


def test_pack_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(rows, [tuple(r) for r in queries.op10_best_fit_packing(spark, sf_dir).collect()], 1024)
