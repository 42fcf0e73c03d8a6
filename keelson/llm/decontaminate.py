"""Benchmark decontamination: Wu-Manber search for the word windows of test items."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cached, durable, only

#: A-Z lowered; the other ASCII characters that are no digit or letter end a word; bytes from 0x80 belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that choose a bucket of patterns by their last words.
SUFFIX = 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WuManber:
    """Patterns of one length m, over words: shifts for blocks of two words, buckets by the hash of the last words.

    A block that is in no pattern lets the search go on m - 1 words further; one whose last place in any pattern is j
    lets it go on m - 1 - j. At shift 0 the bucket of the last words holds the patterns to compare with directly.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[int, ...]], m: int):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict[tuple[bytes, ...], dict] = {}
        self.suffix = min(SUFFIX, m)
        for pattern, items in patterns.items():
            for j in range(self.block - 1, m):
                block = pattern[j - self.block + 1 : j + 1]
                self.shift[block] = min(self.shift.get(block, self.default), m - 1 - j)
            self.buckets.setdefault(pattern[m - self.suffix :], {})[pattern] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """The start of every occurrence, and the items that have the pattern."""
        m, shift, default, suffix, buckets = self.m, self.shift, self.default, self.suffix, self.buckets
        n, at, two = len(words), m - 1, self.block == 2
        while at < n:
            step = shift.get((words[at - 1], words[at]) if two else (words[at],), default)
            if step:
                at += step
                continue
            bucket = buckets.get(tuple(words[at - suffix + 1 : at + 1]))
            if bucket is not None:
                items = bucket.get(tuple(words[at - m + 1 : at + 1]))
                if items is not None:
                    yield at - m + 1, items
            at += 1


def searches(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """One search for each pattern length: ``window`` words, or an item's own length where it has fewer."""
    by: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(words[at : at + m]), set()).add(number)
    return [WuManber({p: tuple(sorted(x)) for p, x in patterns.items()}, m) for m, patterns in sorted(by.items())]


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, one at a time on the driver; one block at least."""
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        found = (items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)).collect()
        yield sorted((r["id"], r["text"]) for r in found)


class Block:
    """A block of items, broadcast; each process builds its search tables once and holds those of one block at a time."""

    def __init__(self, spark: SparkSession, items: list[tuple[str, str | None]], window: int):
        self.items, self.window = spark.sparkContext.broadcast(items), window
        self.version = zlib.crc32(repr((items, window)).encode())

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, merged runs of its hit words, and the ids of the items that occur."""
        names, finders = cached("items", self.version, lambda: ([i for i, _ in self.items.value], searches(self.items.value, self.window)))
        words = words_of(text)
        runs, found = [], set()
        for finder in finders:
            for at, numbers in finder.find(words):
                runs.append((at, at + finder.m))
                found.update(numbers)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, sorted(names[k] for k in found)


def searched(source: DataFrame, block: Block) -> DataFrame:
    """All columns of ``source`` but ``__text``, and (n_words, runs, items): one narrow pass."""
    keep = [c for c in source.columns if c != "__text"]

    def search(batches: Iterator) -> Iterator:
        for batch in batches:
            out = [block.search(text.as_py()) for text in batch.column("__text")]
            runs = pa.array([[{"a": a, "b": b} for a, b in r] for _, r, _ in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            made = [pa.array([n for n, _, _ in out], pa.int64()), runs, pa.array([i for _, _, i in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "n_words", "runs", "items"])

    run = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    more = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("items", T.ArrayType(T.StringType()))]
    return source.mapInArrow(search, T.StructType([source.schema[c] for c in keep] + more))


def asked_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(items, id=id_col, text=text_col).where(F.col("id").isNotNull() & F.col("text").isNotNull()).select(F.col("id").cast("string").alias("id"), "text").distinct()


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = 8_000_000) -> DataFrame:
    """Words of each document that lie in an occurrence of a test item's window.

    Returns (id, n_words, n_hit, n_items, items_sha256, contaminated): ``contaminated`` when n_hit > 0 and
    ``share`` * n_hit >= n_words.

    Test items are the stated query set: they are read in blocks of ``block_bytes``, whose size is measured first. One
    block is searched in one narrow pass, without a shuffle. Of several, each has a pass of its own over the documents,
    and a process holds the tables of one block only; the runs that the passes find are put together by row, without
    the texts, and only for the rows that have any.

    Null and empty texts have no words and are not contaminated. Items without words have no window; items whose id is
    null are left out; an item that is repeated counts once. Repeated documents give repeated results. Windows that
    share words count a word once. Empty tables give empty results or no hits.
    """
    blocks = [Block(docs.sparkSession, block, window) for block in blocks_of(asked_items(items, item_id_col, item_text_col), block_bytes)]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text"))
    if len(blocks) == 1:
        found = searched(source, blocks[0])
    else:
        keyed = source.withColumn("text_hash", F.sha2(F.col("__text"), 256))
        passes = [durable(searched(keyed, block)) for block in blocks]
        hits = [p.where(F.size("runs") > 0).select(F.lit(k).alias("block"), "id", "text_hash", "runs", "items").distinct() for k, p in enumerate(passes)]
        together = reduce(DataFrame.unionByName, hits).groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.flatten(F.collect_list("runs")).alias("__runs"), F.flatten(F.collect_list("items")).alias("__items"))  # a row per block
        words = passes[0].select("id", "text_hash", "n_words")
        found = words.join(together, words["id"].eqNullSafe(F.col("__id")) & (words["text_hash"] == F.col("__hash")), "left").select("id", "n_words", F.coalesce("__runs", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("runs"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    hit = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n")), lambda acc: acc["n"])
    counted = found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items")
    return counted.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows and columns of ``docs`` that ``contamination`` does not find contaminated.

    One block of items is a filter where the rows are read: only texts go to Python, and only the verdicts come back.
    With several blocks, the contaminated texts (by their hash) are looked up. Null and empty texts stay, repeated rows
    stay or go together, an empty table stays empty, and without items all rows stay.
    """
    asked = asked_items(items, item_id_col, item_text_col)
    blocks = list(islice(blocks_of(asked, block_bytes), 2))
    text = F.col(f"`{text_col}`")
    if len(blocks) > 1:
        texts = docs.select(F.sha2(text, 256).alias("hash"), text.alias("text")).where(F.col("hash").isNotNull())
        bad = contamination(texts, asked, id_col="hash", item_id_col="id", window=window, share=share, block_bytes=block_bytes).where("contaminated").select(F.col("hash").alias("__bad")).distinct()
        return docs.join(bad, F.sha2(text, 256) == F.col("__bad"), "left_anti")
    block = Block(docs.sparkSession, blocks[0], window)

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            n, runs, _ = block.search(t.as_py())
            hit = sum(b - a for a, b in runs)
            out.append(not hit or share * hit < n)
        return pa.array(out, pa.bool_())

    return docs.where(F.arrow_udf(clean, "boolean")(text))


CONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
x AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM x JOIN p ON x.m = p.m AND x.g = p.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
