"""Language-model scores: hashed maximum entropy over word classes and words, beside the add-one unigram score."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, durable, forget, lowered_words, only

#: The end token; no word is empty.
END = b""
LN10 = float(np.log(10.0))
#: Odd multipliers that spread codes of the last two words over the buckets (fixed values of the model).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Buckets in one row of exchanged counts, so that rows stay at a few kB.
ROW = 16
#: Features of a token: the word before, both words before, the one before that (a skip).
FEATURES = 3
#: Bins of a bucket's count, by powers of two.
BINS = 24
#: Changes of a step size are added up in whole units of this, so that the sums do not depend on their order.
UNIT = 2.0**-16


@dataclass
class Shape:
    """Tokens are leaves of a tree of ``outer`` classes with ``inner`` leaves each.

    The ``single`` most frequent tokens are leaves of their own; all others share the other leaves by their last bytes.
    """

    outer: int = 32
    inner: int = 32
    single: int = 768
    least_buckets: int = 1 << 15
    smooth: float = 16.0
    block: int = 1 << 15

    @property
    def leaves(self) -> int:
        return self.outer * self.inner

    def leaf_of(self, token: bytes) -> int:
        return self.single + zlib.crc32(token[-2:]) % (self.leaves - self.single)

    def buckets(self, tokens: int) -> int:
        """Buckets of each feature: a power of two that grows with the root of the number of training tokens."""
        return max(self.least_buckets, 1 << int(np.ceil(np.log2(max(1.0, 2 * tokens**0.5)))))


class Head:
    """The most frequent tokens, by rank: their counts and leaves; the rest is worked out token by token."""

    def __init__(self, tokens: list[bytes], counts: list[int], shape: Shape):
        self.shape, self.place = shape, {t: k for k, t in enumerate(tokens)}
        self.logs = np.log10(np.array([*counts, 0], float) + 1)  # the last place stands for every other token
        self.leaves = np.array([k if k < shape.single else shape.leaf_of(t) for k, t in enumerate(tokens)], np.int32)
        self.shared = shape.leaves - shape.single
        self.room = (2**31 - 1 - len(tokens)) // self.shared

    def codes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1: none) and code of each token: its place, or beyond all places a number by its hash and leaf."""
        place = np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        code = place.astype(np.int32)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            rest = [tokens[k] for k in miss.tolist()]
            code[miss] = [len(self.leaves) + zlib.crc32(t) % self.room * self.shared + zlib.crc32(t[-2:]) % self.shared for t in rest]
        return place, code

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.leaves)
        own = self.leaves.take(np.minimum(codes, n - 1)) if n else np.zeros(len(codes), np.int32)
        return np.where(codes < n, own, self.shape.single + (codes - n) % self.shared)


def contexts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three hashes (uint64) for each token: of the word before, of both words before, and of the one before that.

    first: how many tokens of its document stand before it, at most 2.
    """
    with np.errstate(over="ignore"):
        a, b, c, d = (np.uint64(x) for x in MIX)
        own = codes.astype(np.uint64) + np.uint64(2)
        one = np.r_[np.uint64(0), own[:-1]][: len(own)]
        two = np.r_[np.uint64(0), np.uint64(0), own[:-2]][: len(own)]
        one, two = np.where(first >= 1, one, np.uint64(1)), np.where(first >= 2, two, np.uint64(1))
        mixed = np.stack([one * a, one * b + two * c, two * d + a])
        mixed ^= mixed >> np.uint64(31)
        mixed *= b
        return mixed ^ (mixed >> np.uint64(29))


def rows_of(hashes: np.ndarray, outer: np.ndarray, buckets: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the outer and the inner table for each feature: every feature has its own rows.

    The inner rows of a feature also belong to one outer class each: class k has those that are k modulo ``classes``.
    """
    shift = (np.arange(FEATURES) * buckets)[:, None]
    low = (hashes & np.uint64(buckets - 1)).astype(np.int64)
    with np.errstate(over="ignore"):
        again = (hashes ^ (outer.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[2])) * np.uint64(MIX[3])
    group = ((again >> np.uint64(40)) % np.uint64(buckets // classes)).astype(np.int64)
    return low + shift, group * classes + outer + shift


def firsts(sizes: np.ndarray) -> np.ndarray:
    """For each token of documents of these sizes, how many of its document stand before it, at most 2."""
    out = np.full(int(sizes.sum()), 2)
    begins = np.cumsum(sizes) - sizes
    begins = begins[sizes > 0]
    out[begins] = 0
    out[(begins + 1)[sizes[sizes > 0] > 1]] = 1
    return out


@dataclass
class Model:
    """P(outer class | context) * P(leaf | outer class, context): two softmaxes over hashed features.

    A row of ``tables`` holds the weights of a feature's bucket; ``priors`` are the classes' log shares. Weights are the
    log ratio of what was observed in a bucket and what the priors expect there, times a step size for each feature
    and count; zero where nothing was seen.
    """

    tables: tuple[np.ndarray, np.ndarray]
    totals: tuple[np.ndarray, np.ndarray]
    priors: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]  # the step size of each row
    smooth: float

    def __post_init__(self):
        self.bins = tuple(bin_of(np.maximum(n.astype(np.float64) - 1, 0)) for n in self.totals)  # without the token itself

    @staticmethod
    def of(counts: tuple[np.ndarray, np.ndarray], leaf_tokens: np.ndarray, shape: Shape, steps: np.ndarray) -> Model:
        """``counts``: (rows, classes) for the outer and the inner table."""
        share = ((leaf_tokens + 1) / (leaf_tokens.sum() + len(leaf_tokens))).reshape(shape.inner, shape.outer).T  # a row per outer class
        outer = share.sum(axis=1)
        inner = share / outer[:, None]
        tables, totals, sizes = [], [], []
        for level, seen in enumerate(counts):
            n = seen.sum(axis=1, dtype=np.int64)
            prior = outer[None, :] if level == 0 else inner[np.arange(len(seen)) % shape.outer]
            ratio = np.log((seen + shape.smooth * prior) / ((n + shape.smooth)[:, None] * prior)).astype(np.float32)
            feature = np.arange(len(seen)) // (len(seen) // FEATURES)
            sizes.append(steps[level][feature, bin_of(n)].astype(np.float32))
            ratio *= sizes[-1][:, None]
            tables.append(ratio)
            totals.append(n.astype(np.float32))
        return Model(tuple(tables), tuple(totals), (np.log(outer).astype(np.float32), np.log(inner).astype(np.float32)), tuple(sizes), shape.smooth)

    def parts(self) -> tuple:
        return self.tables, self.totals, self.priors, self.sizes, self.smooth

    def level(self, level: int, rows: np.ndarray, base: np.ndarray, own: np.ndarray, without_own: bool) -> tuple[np.ndarray, list]:
        """Log probability of the ``own`` class of each token, and the slope of each feature's step size.

        ``without_own``: the token itself is left out of what was observed; slopes are worked out only then, since a
        step size learned with it would trust what was seen once. That lowers its own class; what it changes in a whole
        row cancels out.
        """
        held = [self.tables[level].take(r, axis=0) for r in rows]
        z = base + held[0]
        for h in held[1:]:
            z += h
        at = np.arange(len(own)) * z.shape[1] + own
        mine = z.ravel().take(at)
        less, owns = [], []
        if without_own:
            prior = np.exp(np.broadcast_to(base, z.shape)[np.arange(len(own)), own])
            for h, r in zip(held, rows, strict=True):
                size, h_own = self.sizes[level].take(r), h.ravel().take(at)
                observed = prior * (self.totals[level].take(r) + np.float32(self.smooth)) * np.exp(h_own / size)  # and smoothed
                less.append(size * np.log1p(-1 / np.maximum(observed, np.float32(1.001))))
                owns.append(h_own)
            mine = mine + less[0] + less[1] + less[2]
            z.ravel()[at] = mine
        np.exp(z, out=z)
        total = z.sum(axis=1)
        share = np.exp(mine) / total if without_own else None
        slopes = [(h_own + d) - (np.einsum("ij,ij->i", z, h) / total + share * d) for h, h_own, d in zip(held, owns, less, strict=False)]
        return mine.astype(np.float64) - np.log(total.astype(np.float64)), slopes

    def log_probability(self, hashes: np.ndarray, leaves: np.ndarray, shape: Shape, gathered: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each token's leaf. ``gathered`` (level, slope or its square, feature, bin) adds up changes."""
        outer, inner = leaves % shape.outer, leaves // shape.outer
        buckets = len(self.tables[0]) // FEATURES
        out = np.zeros(len(leaves))
        for level, (rows, own) in enumerate(zip(rows_of(hashes, outer, buckets, shape.outer), (outer, inner), strict=True)):
            base = self.priors[0][None, :] if level == 0 else self.priors[1].take(outer, axis=0)
            found, slopes = self.level(level, rows, base, own, gathered is not None)
            out += found
            for f, slope in enumerate(slopes):
                bins = self.bins[level].take(rows[f])
                gathered[level, 0, f] += np.bincount(bins, np.rint(slope / UNIT), BINS)
                gathered[level, 1, f] += np.bincount(bins, np.rint(slope * slope / UNIT), BINS)
        return out


def bin_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1.0).astype(np.int64), BINS - 1)


def counted(hashes: np.ndarray, leaves: np.ndarray, shape: Shape, counts: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to ``counts`` (flat, a row of classes per bucket) what is observed: the class of each token in each of its rows."""
    outer, inner = leaves % shape.outer, leaves // shape.outer
    buckets = len(counts[0]) // FEATURES // shape.outer
    for level, (rows, own) in enumerate(zip(rows_of(hashes, outer, buckets, shape.outer), (outer, inner), strict=True)):
        width = shape.outer if level == 0 else shape.inner
        for f, r in enumerate(rows):  # the rows of a feature lie together
            held = counts[level][f * buckets * width : (f + 1) * buckets * width]
            np.add(held, np.bincount((r - f * buckets) * width + own, minlength=len(held)), out=held, casting="unsafe")


def moved(steps: np.ndarray, gathered: np.ndarray) -> np.ndarray:
    """Step sizes after a gradient update: each moves along its slope, scaled by the sum of squares and the features' number."""
    slope, curve = gathered[:, 0], gathered[:, 1]
    return np.clip(steps * (1 + np.clip(slope / (FEATURES * curve + 16 / UNIT), -0.5, 0.5)), 0.02, 1.5)


def token_counts(docs: DataFrame, bound: int = 250_000) -> DataFrame:
    """(token binary, c) over all texts; a task folds what it reads, at most ``bound`` tokens at a time."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(held: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

        forget()
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(lowered_words(text.as_py()))
                held[END] += 1
                if len(held) >= bound:
                    yield out(held)
                    held.clear()
        yield out(held)

    return durable(docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))


def most_frequent(vocabulary: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(token, count), the most frequent first: at most ``most``, and only those above a count that leaves none out.

    The count comes from a histogram of a few hundred steps, so no task sends more than its part of what is asked for.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    bins = sorted(((r["k"], r["n"]) for r in vocabulary.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, edge = 0, None
    for k, n in bins:
        if total + n > most:
            break
        total, edge = total + n, k
    if edge is None:
        return []
    found = vocabulary.where(step >= edge).collect()  # at most `most` rows
    return sorted(((bytes(r["token"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))


def leaf_sizes(vocabulary: DataFrame, shipped, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each leaf."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, n, v = shared_head(shipped, shape), np.zeros(shape.leaves, np.int64), np.zeros(shape.leaves, np.int64)
        for batch in batches:
            leaves = of.leaf(of.codes(batch.column("token").to_pylist())[1])
            n += np.bincount(leaves, batch.column("c").to_numpy(), shape.leaves).astype(np.int64)
            v += np.bincount(leaves, minlength=shape.leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape.leaves)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    n, v = np.zeros(shape.leaves, np.int64), np.zeros(shape.leaves, np.int64)
    for r in vocabulary.mapInArrow(work, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def shared_head(shipped, shape: Shape) -> Head:
    tokens, counts, version = shipped.value
    return cached("head", version, lambda: Head(tokens, counts, shape))


def groups_of(texts, tokens_at_once: int = 60_000) -> Iterator[tuple[list[bytes], list[int]]]:
    """(tokens, tokens of each document) for a few documents at a time."""
    tokens: list[bytes] = []
    sizes: list[int] = []
    for text in texts:
        own = lowered_words(text.as_py())
        own.append(END)
        tokens += own
        sizes.append(len(own))
        if len(tokens) >= tokens_at_once:
            yield tokens, sizes
            tokens, sizes = [], []
    if sizes:
        yield tokens, sizes


def encoded(source: DataFrame, shipped, sizes: np.ndarray, shape: Shape) -> DataFrame:
    """(row, id, learn, n_tokens, known, logs, within, codes, rest) of (id, text, learn), in the shared folder.

    codes: 4 bytes a token. logs: the sum of log10(count + 1) over the tokens of the head; rest: all other tokens.
    within: the sum over all tokens of log10 of the add-one size of their leaf.
    """
    logs_of = np.log10(sizes + 1.0)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        of, row = shared_head(shipped, shape), TaskContext.get().partitionId() << 33
        rest_type = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            at = 0
            for tokens, lengths in groups_of(batch.column("text")):
                place, codes = of.codes(tokens)
                starts, known = np.cumsum([0, *lengths[:-1]]), place >= 0
                rests = [[{"token": t, "n": k} for t, k in Counter(tokens[k] for k in (np.flatnonzero(~known[a : a + size]) + a).tolist()).items()] for a, size in zip(starts.tolist(), lengths, strict=True)]
                part, n = batch.slice(at, len(lengths)), len(lengths)
                at += n
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), of.logs[place], logs_of[of.leaf(codes)])]
                offsets = pa.array(np.r_[starts, len(codes)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column("id"), part.column("learn"), pa.array(lengths, pa.int64()), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, pa.array(codes)), pa.array(rests, rest_type)],
                    names=["row", "id", "learn", "n_tokens", "known", "logs", "within", "codes", "rest"],
                )
                row += n

    kind = source.schema["id"].dataType.simpleString()
    return durable(source.mapInArrow(work, f"row long, id {kind}, learn boolean, n_tokens long, known long, logs double, within double, codes array<int>, rest array<struct<token:binary,n:bigint>>"))


def stretches(column, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, tokens of each document) of an Arrow list column, whole documents at a time."""
    offsets = column.offsets.to_numpy()
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + at_once, side="right")) - 1)
        yield column.values.slice(int(offsets[begin]), int(offsets[end] - offsets[begin])).to_numpy(), np.diff(offsets[begin : end + 1])
        begin = end


def looked_up(of: Head, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return contexts(codes, firsts(sizes)), of.leaf(codes)


def observed(texts: DataFrame, shipped, shape: Shape, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes seen in each bucket: the gradient at zero weights, less what the priors expect there.

    A task adds up what it reads; rows of a few kB, in the fewest bytes a number that hold them and without those of
    zeros, are then added up by row. The sums are whole numbers, so they do not depend on how the input is split.
    """
    widths = (shape.outer, shape.inner)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, counts = shared_head(shipped, shape), tuple(np.zeros(FEATURES * buckets * w, np.int32) for w in widths)  # of one task
        for batch in batches:
            for codes, sizes in stretches(batch.column("codes")):
                counted(*looked_up(of, codes, sizes), shape, counts)
        for level, own in enumerate(counts):
            rows = own.reshape(-1, ROW * widths[level])
            most = rows.max(axis=1)
            for begin in range(0, len(rows), 1024):
                at = np.flatnonzero(most[begin : begin + 1024]) + begin
                data = [rows[k].astype(np.uint8 if most[k] < 1 << 8 else np.uint16 if most[k] < 1 << 16 else np.int64).tobytes() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at), pa.array(data, pa.binary())], names=["level", "row", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for level, row, data in zip(batch.column("level").to_pylist(), batch.column("row").to_pylist(), batch.column("counts"), strict=True):
                own = numbers(data.as_buffer(), ROW * widths[level])
                before = held.get((level, row))
                held[level, row] = own.astype(np.int64) if before is None else before + own
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int64()), pa.array([held[k].astype(np.int64 if held[k].max() >= 1 << 31 else np.int32).tobytes() for k in keys], pa.binary())], names=["level", "row", "counts"])

    parts = texts.select("codes").mapInArrow(count, "level int, row long, counts binary")
    sums = parts.repartition("level", "row").mapInArrow(add, "level int, row long, counts binary")
    out = tuple(np.zeros((FEATURES * buckets // ROW, ROW * w), np.int64) for w in widths)
    for r in sums.toLocalIterator():  # in all, the size of the tables
        out[r["level"]][r["row"]] = numbers(r["counts"], ROW * widths[r["level"]])
    return tuple(x.reshape(-1, w) for x, w in zip(out, widths, strict=True))


def numbers(data, n: int) -> np.ndarray:
    """``n`` whole numbers from bytes; how many bytes each has follows from the length."""
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[len(data) // n])


def gradients(texts: DataFrame, shipped, model, shape: Shape) -> np.ndarray:
    """Slopes of the step sizes and their squares, over all rows, each token left out of its own counts."""
    places = 2 * 2 * FEATURES * BINS

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, own = shared_head(shipped, shape), Model(*model.value)
        gathered = np.zeros((2, 2, FEATURES, BINS))
        for batch in batches:
            for codes, sizes in stretches(batch.column("codes"), shape.block):
                hashes, leaves = looked_up(of, codes, sizes)
                for at in range(0, len(codes), shape.block):
                    own.log_probability(hashes[:, at : at + shape.block], leaves[at : at + shape.block], shape, gathered)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(places)), pa.array(gathered.ravel().astype(np.int64))], names=["k", "v"])

    out = np.zeros(places)
    for r in texts.select("codes").mapInArrow(work, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out.reshape(2, 2, FEATURES, BINS)


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, head: int = 1 << 17, rounds: int = 1, shape: Shape | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Rows whose crc32(id) modulo ``modulus`` is ``held`` are held out; counts and weights are learned from all others.
    ``base_score`` is the add-one unigram log10 probability. ``score`` is the model's: log10 of P(class | words before)
    * P(leaf | class, words before) * P(token | leaf). The first two factors are softmaxes of hashed n-gram and skip
    features, so context reaches each of the ``Shape.single`` most frequent tokens; the last is add-one within the
    leaf, with one place for unseen tokens.

    Training is a first gradient step from zero weights over all rows, whose counts give every weight, and ``rounds`` of
    gradient updates of the step sizes over all rows. All sums are of whole numbers: scores do not depend on how the
    input is split. Buckets grow with the root of the training tokens (``Shape.buckets``); a process holds
    2 * 3 * buckets * classes weights of 4 bytes.

    Counts of the most frequent tokens, at most ``head`` (131,072), are broadcast; all other tokens of a text go
    to an exact join with the whole vocabulary, where no token can be frequent.

    Null text counts as empty and scores its end token. A null id counts as the empty text for the fold. Repeated rows
    count and score each. Without training rows every count is 0. An empty table gives an empty result.
    """
    spark, shape = docs.sparkSession, shape or Shape()
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    source = only(docs, id=id_col, text=text_col).withColumn("learn", fold % modulus != held)
    vocabulary = token_counts(source.where("learn"))
    top = most_frequent(vocabulary, head)
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_types = int(totals["n"]), int(totals["v"])
    tokens, counts = [t for t, _ in top], [c for _, c in top]
    shipped = spark.sparkContext.broadcast((tokens, counts, zlib.crc32(b"\n".join(tokens)) * 31 + sum(counts)))
    n, v = leaf_sizes(vocabulary, shipped, shape)
    rows = encoded(source, shipped, n + v, shape)
    seen = observed(rows.where("learn"), shipped, shape, shape.buckets(n_train))
    steps = np.full((2, FEATURES, BINS), 0.55)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model.of(seen, n, shape, steps).parts())
        steps = moved(steps, gradients(rows.where("learn"), shipped, model, shape))
        model.unpersist()
    model = spark.sparkContext.broadcast(Model.of(seen, n, shape, steps).parts())

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, own = shared_head(shipped, shape), Model(*model.value)
        for batch in batches:
            out = []
            for codes, sizes in stretches(batch.column("codes"), shape.block):
                hashes, leaves = looked_up(of, codes, sizes)
                found = [own.log_probability(hashes[:, at : at + shape.block], leaves[at : at + shape.block], shape) for at in range(0, len(codes), shape.block)]
                out.append(np.add.reduceat(np.concatenate(found), np.cumsum(sizes) - sizes) / LN10)
            by_leaf = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(by_leaf)], names=["row", "id", "n_tokens", "known", "logs", "within", "by_leaf"])

    kind = source.schema["id"].dataType.simpleString()
    scored = rows.select("row", "id", "n_tokens", "known", "logs", "within", "codes").mapInArrow(work, f"row long, id {kind}, n_tokens long, known long, logs double, within double, by_leaf double")
    rest = rows.select("row", F.explode("rest").alias("x")).select("row", "x.token", "x.n").join(vocabulary, "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col), (fold % modulus == held).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.log10(F.lit(float(n_train + n_types + 1)))).alias("base_score"), (logs - F.col("within") + F.col("by_leaf")).alias("score"),
    )
