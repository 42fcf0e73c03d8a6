"""SimHash near-duplicates: a Gray-order hierarchical index over all distinct fingerprints, searched range by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, joined_by, lowered_words, only

def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, block: int = 32_768) -> int:
    """Each bit that is set in over half of the shingles' XXH64 values; repeats count; no words: 0."""
    from xxhash import xxh64_intdigest

    words = lowered_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):
        end = min(n, at + block)
        joined = map(b" ".join, zip(*(words[at + k : end + k] for k in range(shingle)), strict=True))
        hashes = np.array([xxh64_intdigest(x, seed) for x in joined], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: neighbours there tend to differ in few bits."""
    rank = codes.astype(np.uint64, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order. A node holds the bits that all below it share and no node above has."""

    def __init__(self, codes: np.ndarray, fan: int = 8):
        """codes: uint64, in Gray order."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.codes, self.fan = codes, fan
        masks, patterns = np.full(len(codes), full, np.uint64), codes
        levels = [(masks, patterns)]
        while len(patterns) > 1:
            at = np.arange(0, len(patterns), fan)
            first = np.repeat(patterns[at], np.diff(np.r_[at, len(patterns)]))
            differ = np.bitwise_or.reduceat(patterns ^ first, at)
            masks = np.bitwise_and.reduceat(masks, at) & ~differ
            patterns = patterns[at] & masks
            levels.append((masks, patterns))
        self.levels = []  # from the root: residual masks and patterns
        above = np.zeros(1, np.uint64)
        for masks, patterns in reversed(levels):
            parent = above[np.arange(len(masks)) // fan] if self.levels else above
            self.levels.append((masks & ~parent, patterns))
            above = masks

    def pairs(self, limit: int, lead: int = 0, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of codes that differ in at most ``limit`` bits, and in none of the first ``lead`` bits.

        All codes go down the tree together. What a code and a node differ in is added up on the way, and a group is left
        as soon as the sum is over the limit. At most about ``block`` (code, node) pairs are looked at at once, the
        deepest first, so memory does not depend on how many pairs there are.
        """
        fixed = ~np.uint64(0) << np.uint64(64 - lead) if lead else np.uint64(0)
        if not len(self.codes):
            return
        last = len(self.levels) - 1
        waiting = [(0, at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)) for at in np.array_split(np.arange(len(self.codes)), -(-len(self.codes) // block))]
        while waiting:
            depth, query, node, differ = waiting.pop()
            masks, patterns = self.levels[depth]
            off = (self.codes[query] ^ patterns[node]) & masks[node]
            differ = differ + np.bitwise_count(off)
            near = (differ <= limit) & (off & fixed == 0)
            query, node, differ = query[near], node[near], differ[near]
            if depth == last:
                later = node > query
                yield query[later], node[later]
                continue
            span, below = self.fan ** (last - depth - 1), self.levels[depth + 1][0]
            for at in range(0, len(query), max(1, block // self.fan)):
                part = slice(at, at + max(1, block // self.fan))
                asked = np.repeat(query[part], self.fan)
                child = (node[part, None] * self.fan + np.arange(self.fan)).ravel()
                there = (child < len(below)) & ((child + 1) * span > asked + 1)  # only partners after the code
                waiting.append((depth + 1, asked[there], child[there], np.repeat(differ[part], self.fan)[there]))


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def star(codes: np.ndarray, limit: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, least place that i is connected with), for codes in Gray order that agree in their first ``lead`` bits."""
    root, every = np.arange(len(codes)), np.arange(len(codes))
    for i, j in GrayIndex(codes).pairs(limit, lead):
        new = root[i] != root[j]
        if new.any():
            root = roots_of(len(codes), np.r_[every, i[new]], np.r_[root, j[new]])
    linked = np.flatnonzero(root != every)
    return linked, root[linked]


def steps(limit: int) -> list[tuple[int, int, int]]:
    """(bits led so far, bits left, bits of a part), level by level: the bits left are cut into limit + 1 equal parts.

    Codes that differ in ``limit`` bits or fewer agree in a whole part, which then leads with the bits that led before.
    """
    out, led = [], 0
    while (64 - led) // (limit + 1):
        out.append((led, 64 - led, (64 - led) // (limit + 1)))
        led += out[-1][2]
    return out


def unsigned_right(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, k) if k else c


def turned(view: Column, left: int, by: int) -> Column:
    """``view`` with its last ``left`` bits rotated, so that the ones ``by`` further on lead."""
    low = (1 << left) - 1
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    rest = view.bitwiseAND(signed(low))
    return view.bitwiseAND(signed(~low & (1 << 64) - 1)).bitwiseOR(F.shiftleft(rest, by).bitwiseOR(unsigned_right(rest, left - by)).bitwiseAND(signed(low))) if by else view


def gray_rank_of(view: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        view = view.bitwiseXOR(F.shiftrightunsigned(view, k))
    return view


def views(codes: DataFrame, level: tuple[int, int, int], limit: int) -> DataFrame:
    """(tree, lead, rank, code): each (tree, view, code) in ``limit`` + 1 views, each led by another part.

    rank: the place in Gray order; the codes of a tree with the same lead follow one another there.
    """
    led, left, part = level
    own = F.array(*[F.struct((F.col("tree") * (limit + 1) + k).cast("int").alias("tree"), turned(F.col("view"), left, k * part).alias("view")) for k in range(limit + 1)])
    dealt = codes.select("code", F.explode(own).alias("x")).select("x.tree", gray_rank_of(F.col("x.view")).alias("rank"), "code")
    return dealt.select("tree", F.shiftrightunsigned("rank", 64 - led - part).alias("lead"), "rank", "code")


def links(prints: DataFrame, limit: int = 3, hot: int = 8192) -> DataFrame:
    """(a, b): links that connect all distinct ``fingerprint`` values (long) that differ in ``limit`` bits or fewer.

    Every fingerprint is in ``limit`` + 1 trees, each led by another part of its bits: a linked pair agrees in one of
    the parts, and so shares a lead, that is a range of Gray ranks, in that tree. All rows are sorted by tree and Gray
    rank over the whole cluster; a task builds the index over its stretch of whole ranges and searches it. Pairs are
    not emitted: each stretch gives a spanning star of each connected set.

    Ranges are counted first (partial counts by lead). One of more than ``hot`` fingerprints is not searched but dealt
    out again, where it is read, by the parts of its bits that are left, and so on: each level makes the lead longer,
    until no range can have that many. So a task holds a bounded number of fingerprints, whatever the input.
    """
    codes = prints.select(F.lit(1).alias("tree"), F.col("fingerprint").alias("view"), F.col("fingerprint").alias("code"))
    searched, leads = None, {}
    for depth, level in enumerate(steps(limit)):
        dealt, lead = views(codes, level, limit), level[0] + level[2]
        leads[depth] = lead
        many = None
        if depth + 1 < len(steps(limit)) and 64 - lead > np.log2(hot):
            many = durable(dealt.groupBy("tree", "lead").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("tree", "lead"))
            many = many if many.head(1) else None
        fits = dealt if many is None else dealt.join(many, ["tree", "lead"], "left_anti")
        searched = fits if searched is None else searched.unionByName(fits)
        if many is None:
            break
        codes = durable(dealt.join(many, ["tree", "lead"], "left_semi").select("tree", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1)).alias("view"), "code"))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(tree: int, ranks: np.ndarray, own: np.ndarray):
            lead = leads[(int(tree).bit_length() - 1) // parts_bits - 1]
            i, j = star(ranks ^ (ranks >> np.uint64(1)), limit, lead)
            return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], names=["a", "b"])

        trees, heads, ranks, own = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            trees, heads, ranks, own = np.r_[trees, new[0]], np.r_[heads, new[1]], np.r_[ranks, new[2].view(np.uint64)], np.r_[own, new[3]]
            # whole ranges only: the last one may go on in the next batch
            begins = np.flatnonzero(np.r_[True, (trees[1:] != trees[:-1]) | (heads[1:] != heads[:-1])]) if len(trees) else np.zeros(1, np.int64)
            done = int(begins[-1])
            if done and (len(trees) >= stretch or done < len(trees) and trees[done] != trees[0]):
                edges = np.flatnonzero(np.r_[True, trees[1:done] != trees[: done - 1], True])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    yield found(trees[a], ranks[a:b], own[a:b])
                trees, heads, ranks, own = trees[done:], heads[done:], ranks[done:], own[done:]
        edges = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1], True]) if len(trees) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield found(trees[a], ranks[a:b], own[a:b])

    parts_bits, stretch = int(np.log2(limit + 1)), max(hot, 16_384)
    if 1 << parts_bits != limit + 1:
        raise ValueError("limit + 1 must be a power of two")
    stretches = searched.repartitionByRange("tree", "lead").sortWithinPartitions("tree", "rank")
    return durable(stretches.mapInArrow(search, "a long, b long").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) is connected with.

    The centre of a large component stands in most edges; its least neighbour is broadcast to them.
    Large-star and small-star steps in turn, each written to the shared folder, until the edges no longer change.
    """

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    def both(df: DataFrame) -> DataFrame:
        return df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_by(around, least, "a", "n", 2 * before[0]).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # what is left of an edge set is (a, b) with b < a
        large = durable(large.distinct())
        below = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_by(large, below, "a", "n", 2 * before[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = durable(small)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, fingerprint long) of every row, written to the shared folder."""
    source = only(docs, id=id_col, text=text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(made)], names=["id", "text_hash", "fingerprint"])

    kind = source.schema["id"].dataType.simpleString()
    return durable(source.mapInArrow(work, f"id {kind}, text_hash long, fingerprint long"))


def classed(docs: DataFrame, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their fingerprint, and (fingerprint, root): the least fingerprint that each is connected with."""
    held = fingerprints(docs, id_col, text_col)
    folded = durable(held.select("fingerprint").distinct())
    joined = components(links(folded, hot=hot))
    return held, folded.join(joined, folded["fingerprint"] == joined["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = 8192) -> DataFrame:
    """(id, fingerprint, component_id): one row per document, with the least id that it is connected with.

    Copies share a fingerprint and are folded before the search, so a group of copies costs one row there. Only
    fingerprints (8 bytes), hashes and ids are shuffled; components are found by joins, never on the driver. A
    fingerprint or a component that a third of all rows share is broadcast to its rows.

    Null and empty texts have the fingerprint 0 and are linked like any other. Repeated rows are returned each. A null
    id takes no part in the least id; a component of null ids only has a null component_id. Empty table: empty result.
    """
    held, classes = classed(docs, id_col, text_col, hot)
    least = durable(held.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(classes, "fingerprint"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("f"))
    size = least.agg(F.count("*").alias("f"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    named = durable(joined_by(least.select("fingerprint", "root", "n"), whole, "root", "f", size["f"]).select("fingerprint", "component_id", "n"))
    return joined_by(held, named, "fingerprint", "n", size["n"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = 8192) -> DataFrame:
    """The rows of ``docs`` with one document left of each component.

    The one with the least id stays (null ids come last), among rows that share it the one with the least text hash.
    Rows that repeat in id and text are kept once. Other columns are carried along.
    """
    held, classes = classed(docs, id_col, text_col, hot)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    first = held.groupBy("fingerprint", "id", "text_hash").agg(F.count("*").alias("n"))
    least = first.groupBy("fingerprint").agg(F.min(F.struct(order.alias("o"), "n")).alias("x")).join(classes, "fingerprint")
    kept = durable(least.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.o.id").alias("__id"), F.col("x.o.text_hash").alias("__hash"), F.col("x.n").alias("__n")))
    own = docs.withColumn("__own", F.xxhash64(F.col(f"`{text_col}`")))
    found = own.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    several = found.where("__n > 1").dropDuplicates(["__id", "__hash"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.where("__n = 1").select(*columns).unionByName(several.select(*columns))
