"""Packing documents into sequences: bin completion with branch and bound over the lengths' histogram."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, only
from .tokens import encoder, read_definition

#: A way to fill sequences: the lengths in it, longest first, and how many sequences are filled that way.
Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram of lengths; equal sequences are handled together."""
    open_: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for times, n in ((full, each), (1 if rest else 0, rest)):
                    if times:
                        open_.setdefault(capacity - n * length, Counter())[(length,) * n] += times
                left = 0
                continue
            held = open_[room]
            filling, n = next(iter(held.items()))
            times = min(n, left)
            if times == n:
                del held[filling]
            else:
                held[filling] -= times
            if not held:
                del open_[room]
            open_.setdefault(room - length, Counter())[(*filling, length)] += times
            left -= times
    return [(filling, n) for held in open_.values() for filling, n in held.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The sequences that any packing needs: by volume, and by the lengths over capacity - a with what must lie beside them."""
    volume = -(-sum(k * n for k, n in counts.items()) // capacity)
    most = volume
    lengths = sorted(counts)
    for a in [0, *[x for x in lengths if x <= capacity // 2]]:
        alone = sum(n for k, n in counts.items() if k > capacity - a)
        half = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - a]
        beside = sum(k * n for k, n in counts.items() if a <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in half)
        most = max(most, alone + sum(n for _, n in half) + max(0, -(-(beside - room) // capacity)))
    return most


def fillings(room: int, left: dict[int, int], effort: int = 200) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of ``room`` from the lengths that are ``left``, by waste, one at a time.

    A filling is dominated when items of it (or none) can be swapped for one longer or equal length that is left over
    and still fits: what is set free packs wherever that length would have. The sums of its parts and the lengths left
    over are sets of bits, so the test is a few operations, and it cuts a filling as soon as a part of it is dominated:
    lengths are taken in descending order, so whatever a sum could be swapped for is settled by then. All are listed
    unless there are more than ``effort`` parts of fillings to look at.
    """
    usable = sorted(k for k, n in left.items() if n and k <= room)
    reach, bits, mask = [], 1, (1 << (room + 1)) - 1
    for k in usable:
        reach.append(bits)
        size, rest = 1, min(left[k], room // k)
        while rest > 0:
            take = min(size, rest)
            bits |= bits << (k * take) & mask
            rest -= take
            size *= 2
    free = sum(1 << k for k in usable)

    def longer(over: int, waste: int) -> int:
        """Sums that a length left over exceeds by 1 to ``waste``."""
        out, reached = over >> 1 if waste else 0, min(1, waste)
        while reached < waste:
            step = min(reached, waste - reached)
            out |= out >> step
            reached += step
        return out

    def build(at: int, total: int, waste: int, over: int, sums: int, several: int, found: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """over: lengths left over; sums, several: sums of any, and of two or more, of the items found."""
        nonlocal effort
        effort -= 1
        if not total:
            if not longer(over, waste) & 1:  # nothing left over fits beside them
                yield found
            return
        while at >= 0 and usable[at] > total:
            at -= 1
        for at in range(at, -1, -1):
            k = usable[at]
            n, own_sums, own_several, own_found, rest = 0, sums, several, found, total
            while n < left[k] and rest >= k and effort > 0:  # one more of this length
                n += 1
                own_several |= (own_sums & ~1) << k
                own_sums |= own_sums << k
                own_found, rest = (*own_found, k), rest - k
                own_over = over & ~(1 << k) if n == left[k] else over
                if own_several & own_over or own_sums & ~1 & longer(own_over >> k << k, waste):
                    break
                if reach[at] >> rest & 1:
                    yield from build(at - 1, rest, waste, own_over, own_sums, own_several, own_found)
            if effort <= 0 or not (reach[at] >> total) & 1:
                return  # without this length, the smaller ones cannot fill what is left

    for waste in range(room + 1):
        if effort > 0 and bits >> (room - waste) & 1:
            yield from build(len(usable) - 1, room - waste, waste, free, 1, 0, ())


def few_first(room: int, found: Iterator[tuple[int, ...]], slack: int, look: int = 8) -> Iterator[tuple[int, ...]]:
    """``found`` with the next ``look`` of at most ``slack`` waste in another order: those of the fewest items first.

    Short documents fill any room, so they are worth more later than a little waste now.
    """
    begun = list(islice(found, look))
    near = [f for f in begun if room - sum(f) <= slack]
    yield from sorted(near, key=lambda f: (len(f), room - sum(f), [-k for k in f]))
    yield from begun[len(near) :]
    yield from found


def complete(counts: dict[int, int], capacity: int, nodes: int = 3000, single: int = 400, slacks: tuple[int, ...] = (8, 32, 0)) -> list[Pattern]:
    """Bin completion: fill around the longest length left, branch over undominated fillings, prune by waste.

    Best-fit decreasing is the first incumbent. A branch is cut when its waste leaves no room for a better packing, or
    when the sequences that what is left needs at least do not either. While more than ``single`` documents are left,
    equal sequences are filled together, so a descent has about as many steps as there are distinct lengths, however
    many documents there are; below, every sequence is a step of its own.

    The search ends with a packing that meets the lower bound, or when it has seen everything, or after about ``nodes``
    steps: they are shared by depth-first searches that order fillings by different slacks. A search has at least two
    steps for each distinct length, so that its first descent ends.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    volume = sum(k * n for k, n in counts.items())
    best, least = best_fit(counts, capacity), lower_bound(counts, capacity)
    best_bins = sum(n for _, n in best)

    def search(slack: int, steps: int) -> bool:
        """Depth first; whether everything was seen."""
        nonlocal best, best_bins
        frames: list[tuple] = []
        path: list[Pattern] = []

        def enter(left: dict[int, int], waste: int) -> None:
            top = max(left)
            rest = dict(left)
            rest[top] -= 1
            frames.append((left, waste, top, few_first(capacity - top, fillings(capacity - top, rest), slack)))

        enter(counts, 0)
        while frames and best_bins > least:
            left, waste, top, choices = frames[-1]
            filling, allowed = next(choices, None), (best_bins - 1) * capacity - volume
            if filling is None:
                frames.pop()
                if path:
                    path.pop()
                continue
            filling = (top, *filling)
            need, many = Counter(filling), sum(left.values()) > single
            times = min(left[k] // n for k, n in need.items()) if many else 1
            steps -= 1
            rest = {k: n - need[k] * times for k, n in left.items() if n > need[k] * times}
            path.append((filling, times))
            waste += (capacity - sum(filling)) * times
            if not rest and sum(n for _, n in path) < best_bins:
                best, best_bins = list(path), sum(n for _, n in path)
            if not rest or waste > allowed or not many and sum(n for _, n in path) + lower_bound(rest, capacity) >= best_bins:
                path.pop()
            else:
                enter(rest, waste)
            if steps <= 0:
                return False
        return True

    for slack in slacks:
        if best_bins <= least or search(slack, max(nodes // len(slacks), 2 * len(counts))):
            break
    merged = Counter()
    for filling, n in best:
        merged[tuple(sorted(filling, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, place): documents of a length, by rank, fill these in order."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for filling, times in patterns:
        place = 0
        for length in filling:
            rows.setdefault(length, []).append((used[length], sequence, place))
            used[length] += times
            place += length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_ids, sums): the ids of each whole text and the crc32 of each of its pieces."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    source = only(docs, id=id_col, text=text_col)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(shipped)
        ending = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            lengths, sums = [], []
            for text in batch.column("text"):
                ids = encode.ids(text.as_py() or "") + ending
                n = len(ids) // 4
                first = 4 * (n % capacity or capacity) if n > capacity else len(ids)
                view = memoryview(ids)
                sums.append([zlib.crc32(view[:first]), *(zlib.crc32(view[k : k + 4 * capacity]) for k in range(first, len(ids), 4 * capacity))])
                lengths.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["id", "n_ids", "sums"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, n_ids long, sums array<bigint>")


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, nodes: int = 3000, rows_per_bucket: int = 5_000) -> DataFrame:
    """Sequences of at most ``capacity`` tokens: (id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    A document is its ids and ``end_id``. One longer than ``capacity`` is cut into full pieces after a shorter first one;
    full pieces are sequences of their own. All others are packed together: the histogram of their lengths, which has at
    most ``capacity`` rows however many documents there are, is solved on the driver; a document finds its place by its
    rank among those of its length. Ranks come from counts by (length, bucket of ids) and a row number inside, so one
    length that holds a third of all documents is still spread over many tasks. No packing across documents is lost:
    the histogram covers the whole table.

    Null text counts as empty (just the end token). Repeated rows are packed each. Null ids stay null. An empty table
    gives an empty result. Further columns are not read.
    """
    spark = docs.sparkSession
    held = durable(tokenized(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("sums")), F.lit(0)).alias("most")).first()
    buckets, most = max(1, -(-total["n"] // rows_per_bucket)), int(total["most"]) + 1
    item = F.when(F.col("n_ids") <= capacity, F.col("n_ids")).otherwise(F.col("n_ids") % capacity)
    rows = held.withColumns({"item": item.cast("int"), "bucket": F.pmod(F.xxhash64("id", "n_ids", "sums"), F.lit(buckets)).cast("int")})
    groups = rows.groupBy("item", "bucket").agg(F.count("*").alias("n"))
    counts = {r["item"]: r["n"] for r in groups.groupBy("item").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    patterns = complete({k: n for k, n in counts.items() if k}, capacity, nodes)
    bins = sum(n for _, n in patterns)
    bases = dict(zip(sorted(counts), np.cumsum([0, *(counts[k] for k in sorted(counts))]).tolist(), strict=False))
    shipped = spark.sparkContext.broadcast((slots(patterns), bases))  # bounded by the capacity, not by the documents
    before = Window.partitionBy("item").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases_of = groups.select("item", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("item", "bucket").orderBy("id", "n_ids", "sums")
    ranked = rows.withColumn("row", F.row_number().over(own) - 1).join(bases_of, ["item", "bucket"]).select("id", "n_ids", "sums", "item", (F.col("row") + F.col("base")).alias("rank"))
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, bases = shipped.value
        for batch in batches:
            ids, n_ids, sums, items, ranks = (batch.column(k) for k in range(5))
            n, item, rank = n_ids.to_numpy(), items.to_numpy(), ranks.to_numpy()
            each = np.diff(sums.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            short = np.where(item > 0, item, capacity)[doc]  # the first piece
            length = np.where(piece == 0, short, capacity)
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            number = np.array([bases[int(k)] for k in item], dtype=np.int64) + rank
            sequence = bins + number[doc] * most + piece
            offset = np.zeros(len(doc), np.int64)
            firsts = np.flatnonzero((piece == 0) & (item[doc] > 0))
            for k in np.unique(item[doc[firsts]]):
                at = firsts[item[doc[firsts]] == k]
                slot = table[int(k)]
                row = np.searchsorted(slot[:, 0], rank[doc[at]], side="right") - 1
                sequence[at] = slot[row, 1] + rank[doc[at]] - slot[row, 0]
                offset[at] = slot[row, 2]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int64)), sums.flatten(), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
