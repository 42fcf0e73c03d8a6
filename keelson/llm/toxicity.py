"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
import warnings
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cached, forget, only

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of each piece up to and with its closing marks or line end; white space alone is none."""
    for m in SENTENCE.finditer(text or ""):
        if not m[0].isspace():
            yield m.start(), m.end()


def words(sentence: str) -> list[str]:
    return WORD.findall(sentence.lower())


def features(word: str) -> list[str]:
    """The word itself and, for what stems share, its beginnings of 3 to 6 letters."""
    return [word, *(word[:k] + "-" for k in range(3, min(6, len(word) - 1) + 1))]


def document_features(text: str) -> set[str]:
    return {f for w in set(words(text)) for f in features(w)}


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << 22) - 1)


@dataclass
class Model:
    """A sentence's log-odds are the bias and its distinct words' weights; a word weighs what its features weigh."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    bound: int = 300_000

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def weigh(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.known) < self.bound:
                self.known[word] = found
        return found

    def score(self, text: str | None) -> tuple[float, int, int, int, float]:
        """Document score, sentences, start and end of the worst sentence, and its score.

        A document without sentences has the score 0, and -1 for the places.
        """
        weigh, bias = self.weigh, self.bias
        quiet, clean, n, worst, start, end = -math.log1p(math.exp(bias)), 0.0, 0, -math.inf, -1, -1
        for a, b in sentences(text):
            n += 1
            z = bias
            for word in set(words(text[a:b])):
                z += weigh(word)
            z = max(-500.0, min(500.0, z))
            clean += quiet if z == bias else -(z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z)))
            if z > worst:
                worst, start, end = z, a, b
        return (-math.expm1(clean), n, start, end, 1 / (1 + math.exp(-worst))) if n else (0.0, 0, -1, -1, 0.0)


def fit(rows: list[tuple[str, int]], min_docs: int = 5, steps: int = 150, rate: float = 0.15, shrink: float = 2e-3, l2: float = 2e-5) -> Model:
    """Adam on the noisy-or likelihood of the documents' labels, over features in at least ``min_docs`` distinct texts.

    Copies of a text count once, so that what a group of copies shares is not taken for a sign.
    """
    rows = sorted({text: label for text, label in sorted(rows)}.items())
    if len({y for _, y in rows}) < 2:
        return Model()
    labels = np.array([y for _, y in rows], float)
    # Most features are seen once. A table of hashed counts, which can only count too much, keeps them out of the exact
    # counts, so that memory follows the frequent features and not the words of the sample.
    rough = np.zeros(1 << 22, np.int32)
    for text, _ in rows:
        rough[np.array([hashed(f) for f in document_features(text)], np.int64)] += 1
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for text, y in rows:
        of = [f for f in document_features(text) if rough[hashed(f)] >= min_docs]
        seen.update(of)
        if y:
            toxic.update(of)
    share = float(labels.mean())
    prior = math.log(share / (1 - share))
    lift_of = lambda f: math.log((toxic[f] + 0.5) / (seen[f] - toxic[f] + 0.5)) - prior
    vocabulary = sorted(f for f, n in seen.items() if n >= min_docs and abs(lift_of(f)) > 0.7)
    index = {f: k for k, f in enumerate(vocabulary)}
    doc, sentence, feature, n = array("l"), array("l"), array("l"), 0
    for d, (text, _) in enumerate(rows):
        for a, b in sentences(text):
            doc.append(d)
            for w in sorted(set(words(text[a:b]))):
                for f in features(w):
                    if f in index:
                        sentence.append(n)
                        feature.append(index[f])
            n += 1
    doc, sentence, feature = (np.array(x, np.int64) for x in (doc, sentence, feature))
    weight = np.array([lift_of(f) for f in vocabulary])
    theta = np.r_[np.where(weight > 3, weight, 0.0), -7.0]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], n)
        soft = np.logaddexp(0, z)
        q = -np.bincount(doc, soft, len(rows))
        lift = np.exp(np.minimum(q, -1e-9))
        # loss = -(y log(1 - e^q) + (1 - y) q): its slope in q is y e^q / (1 - e^q) - (1 - y)
        g_doc = labels * lift / (1 - lift) - (1 - labels)
        g_sent = g_doc[doc] * -np.exp(z - soft)
        grad = np.r_[np.bincount(feature, g_sent[sentence], len(vocabulary)), g_sent.sum()] / len(rows)
        grad[:-1] += 2 * l2 * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - shrink, 0)
    return Model(float(theta[-1]), {f: float(v) for f, v in zip(vocabulary, theta, strict=False) if abs(v) > 0.05})


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int, max_bytes: int, long_bytes: int = 1_000_000) -> list[tuple[str, int]]:
    """At most ``max_rows`` usable labelled documents with together at most ``max_bytes`` of text, by hash order of ids.

    ``docs`` has id and text, ``labels`` id and label. A document with several labels counts as toxic if one says so.
    Documents of more than ``long_bytes`` come after all others. One that no longer fits is passed over, not those after it.
    """
    asked = labels.where(usable & F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    asked = asked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    own = docs.where(usable).join(F.broadcast(asked), "id")  # max_rows rows of two numbers
    sizes = own.groupBy("id").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    rows, held, chosen = 0, 0, []
    for r in sizes.orderBy(F.col("bytes") > long_bytes, F.xxhash64("id"), "id").limit(max_rows).collect():
        if rows + r["rows"] <= max_rows and held + r["bytes"] <= max_bytes:
            rows, held = rows + r["rows"], held + r["bytes"]
            chosen.append((r["id"],))
    fits = docs.sparkSession.createDataFrame(chosen, T.StructType([own.schema["id"]]))
    return sorted((r["text"] or "", int(r["label"] > 0)) for r in own.join(F.broadcast(fits), "id").select("text", "label").collect())


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = 6000, max_bytes: int = 40_000_000, long_bytes: int = 1_000_000) -> Model:
    """A model learned on the driver from a bounded sample of labelled documents whose crc32(id) mod 3 is not 1.

    Without documents of both classes nothing can be learned: a warning says so, and the model finds nothing toxic.
    """
    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    rows = labelled_sample(only(docs, id=id_col, text=text_col), only(labels, id=label_id_col, label=label_col), usable, max_rows, max_bytes, long_bytes)
    if len({y for _, y in rows}) < 2:
        warnings.warn(f"a sample of {len(rows)} labelled documents lacks a class; no text will be predicted toxic", stacklevel=2)
    return fit(rows)


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score) of every whole text.

    ``worst_start`` and ``worst_end`` locate the most offending sentence in code points. One narrow pass; the model is a
    bounded dictionary of words.

    Null and empty texts and texts of white space score 0 and have the places -1. A null id counts as the empty text
    for ``held_out``. Repeated rows give repeated results; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    held = (F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    source = docs.select(F.col(f"`{text_col}`").alias("__text"), F.col(f"`{id_col}`"), held)

    def work(batches: Iterator) -> Iterator:
        forget()
        of = Model(*shipped.value)
        for batch in batches:
            found = [of.score(t.as_py()) for t in batch.column(0)]
            score, n, start, end, worst = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 5
            ints = [pa.array(x.astype(np.int64)) for x in (n, start, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32)), *ints, pa.array(worst.astype(float))], names=[id_col, "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"])

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[T.StructField(k, T.LongType()) for k in ("n_sentences", "worst_start", "worst_end")], T.StructField("worst_score", T.DoubleType())]
    return source.mapInArrow(work, T.StructType([source.schema[c] for c in (id_col, "held_out")] + more))


def not_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows and columns of ``docs`` that ``toxicity`` does not predict to be toxic.

    A filter where the rows are read: only texts go to Python, and only the verdicts come back. Null and empty texts
    stay, repeated rows stay or go together, an empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def mild(texts: pa.Array) -> pa.Array:
        of = cached("toxicity", hash((shipped.value[0], len(shipped.value[1]))), lambda: Model(*shipped.value))
        return pa.array([of.score(t.as_py())[0] < threshold for t in texts], pa.bool_())

    return docs.where(F.arrow_udf(mild, "boolean")(F.col(f"`{text_col}`")))
