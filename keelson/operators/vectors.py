"""Exact vector search and vector aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Norms below this count as this, so that a zero vector scores 0 with everything.
FLOOR = 1e-12
#: Scores are compared at nine decimals, so that equal vectors tie whatever the order of summation.
DIGITS = 9
#: More anchor rows than this are refused: they are held by every task.
MAX_ANCHORS = 200_000


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow list column of equal lengths as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), FLOOR)


def prepared(df: DataFrame, id_col: str, vector_col: str, domain: Column | None, time: Column | None) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
        (domain if domain is not None else F.lit(0)).cast("long").alias("domain"), (time if time is not None else F.lit(0)).cast("long").alias("time"),
    ).where("id IS NOT NULL AND vector IS NOT NULL")


def knn(items: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", causal: str | None = None, same_domain: bool = False, exclude_self: bool = True, excluded: dict[int, list[int]] | None = None, most: float | None = None, margin: int = 0, queries_per_block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k best visible items of each query by (score desc, domain, id).

    ``items`` and ``queries`` come from ``prepared``. Filters hold before the ranking: ``causal`` is "strict"
    (item.time < query.time) or "inclusive" (<=), ``same_domain`` asks for the query's domain, ``excluded`` names items
    by query, scores over ``most`` do not count. With a ``margin`` scores are worked out in single precision first, and
    only the k + margin best of a batch exactly. The queries are a stated set: they are read in blocks and broadcast against all items; a task sends at
    most k rows for a query.
    """
    n = queries.count()
    blocks = max(1, -(-n // queries_per_block))
    out = None
    for block in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).collect()
        found = _knn_block(items, rows, k, metric, causal, same_domain, exclude_self, excluded or {}, most, margin)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain", "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, score, domain, id), the k best of each query by (score desc, domain, id), in that order."""
    q, s, d, i = rows
    order = np.lexsort((i, d, -s, q))
    q = q[order]
    begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])[: len(q)]
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) if len(q) else q
    order = order[place < k]
    return [c[order] for c in rows]


def _knn_block(items: DataFrame, rows: list, k: int, metric: str, causal: str | None, same_domain: bool, exclude_self: bool, excluded: dict[int, list[int]], most: float | None, margin: int) -> DataFrame:
    rows = sorted(rows, key=lambda r: r["id"])
    keys = np.array([r["vector"] for r in rows], np.float64) if rows else np.zeros((0, 0))
    keys = unit(keys) if metric == "cosine" and len(rows) else keys
    state = items.sparkSession.sparkContext.broadcast((keys, *(np.array([r[c] for r in rows], np.int64) for c in ("id", "domain", "time")), {int(q): np.array(v, np.int64) for q, v in excluded.items()}))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, ids, domains, times, excluded = state.value
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query, score, domain, id
        for batch in batches:
            own, domain, time = (batch.column(c).to_numpy() for c in ("id", "domain", "time"))
            x = matrix(batch.column("vector"))
            for begin in range(0, len(own) if len(ids) else 0, 4096):
                i, d, t = (c[begin : begin + 4096] for c in (own, domain, time))
                part = x[begin : begin + 4096]
                part = unit(part) if metric == "cosine" else part
                scores = (keys.astype(np.float32) @ part.astype(np.float32).T).astype(np.float64) if margin else np.round(keys @ part.T, DIGITS)
                hidden = np.zeros(scores.shape, bool)
                if exclude_self:
                    hidden |= i[None] == ids[:, None]
                if same_domain:
                    hidden |= d[None] != domains[:, None]
                if causal:
                    hidden |= (t[None] >= times[:, None]) if causal == "strict" else (t[None] > times[:, None])
                if most is not None:
                    hidden |= scores > most
                for q in np.flatnonzero(np.isin(ids, list(excluded))):
                    hidden[q] |= np.isin(i, excluded[int(ids[q])])
                scores[hidden] = -np.inf
                if margin and scores.shape[1] > k + margin:
                    at = np.argpartition(scores, scores.shape[1] - k - margin, axis=1)[:, -(k + margin) :]
                    near = np.round(np.einsum("qd,qmd->qm", keys, part[at]), DIGITS)
                    seen = np.isfinite(np.take_along_axis(scores, at, axis=1))
                    scores = np.full(scores.shape, -np.inf)
                    np.put_along_axis(scores, at, np.where(seen, near, -np.inf), axis=1)
                    hidden = ~np.isfinite(scores)
                elif margin:
                    scores = np.where(hidden, -np.inf, np.round(keys @ part.T, DIGITS))
                if scores.shape[1] > k:  # what may be among the k best, ties included
                    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    hidden |= scores < edge[:, None]
                q, at = np.nonzero(~hidden)
                held = best([np.concatenate(c) for c in zip(held, (q, scores[q, at], d[at], i[at]), strict=True)], k)
        q, s, d, i = held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q] if len(ids) else q), pa.array(i), pa.array(d), pa.array(s)], names=["query_id", "id", "domain", "score"])

    return items.mapInArrow(search, "query_id long, id long, domain long, score double")


def _bounded(rows: DataFrame) -> list:
    """The rows of a bounded table, by id; more than MAX_ANCHORS are refused."""
    found = rows.limit(MAX_ANCHORS + 1).collect()
    if len(found) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors: ask in blocks")
    return sorted(found, key=lambda r: r["id"])


def folded(items: DataFrame, queries: DataFrame, sums: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """(query_id, a column for each of ``sums``): sums over all other items of functions of (cosines, same domain).

    The queries are a stated, bounded set. Each task adds up what it reads and sends one row per query.
    """
    rows = _bounded(queries)
    state = items.sparkSession.sparkContext.broadcast((np.array([r["vector"] for r in rows], np.float64) if rows else np.zeros((0, 0)), np.array([r["id"] for r in rows], np.int64), np.array([r["domain"] for r in rows], np.int64)))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, ids, domains = state.value
        total = {name: np.zeros(len(ids)) for name in sums}
        for batch in batches:
            own, domain, x = batch.column("id").to_numpy(), batch.column("domain").to_numpy(), matrix(batch.column("vector"))
            for begin in range(0, len(own) if len(ids) else 0, 1024):
                part = slice(begin, begin + 1024)
                score = np.round(unit(keys) @ unit(x[part]).T, DIGITS)
                other, same = own[part][None] != ids[:, None], domain[part][None] == domains[:, None]
                for name, value in sums.items():
                    total[name] += np.where(other, value(score, same), 0.0).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(t) for t in total.values()]], names=["query_id", *total])

    parts = items.mapInArrow(work, "query_id long, " + ", ".join(f"{name} double" for name in sums))
    return parts.groupBy("query_id").agg(*[F.sum(name).alias(name) for name in sums])


def scored(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_domain, id, domain, score): cosine of a stated, bounded set of queries with every other item."""
    return _against(items, queries, None, exclude_self=True).select(F.col("anchor").alias("query_id"), F.col("anchor_domain").alias("query_domain"), "id", "domain", "score")


def nearest(items: DataFrame, anchors: DataFrame, c: int, distance: bool = False) -> DataFrame:
    """(id, domain, anchor, score, place): the c nearest anchors of each item, ties to the lower anchor.

    ``score`` is the cosine, or the negative squared distance. Anchors are a bounded table (refused beyond MAX_ANCHORS).
    """
    return _against(items, anchors, c, distance=distance).drop("anchor_domain")


def _against(items: DataFrame, anchors: DataFrame, c: int | None, exclude_self: bool = False, distance: bool = False) -> DataFrame:
    rows = _bounded(anchors)
    state = items.sparkSession.sparkContext.broadcast((np.array([r["vector"] for r in rows], np.float64) if rows else np.zeros((0, 0)), np.array([r["id"] for r in rows], np.int64), np.array([r["domain"] for r in rows], np.int64)))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, ids, domains = state.value
        for batch in batches:
            own, domain = batch.column("id").to_numpy(), batch.column("domain").to_numpy()
            x = matrix(batch.column("vector"))
            for begin in range(0, len(own) if len(ids) else 0, 1024):
                part = slice(begin, begin + 1024)
                if distance:
                    score = -((x[part] ** 2).sum(1)[:, None] - 2 * x[part] @ keys.T + (keys**2).sum(1)[None])
                else:
                    score = unit(x[part]) @ unit(keys).T
                score = np.round(score, DIGITS)
                if c is None:
                    i, a = np.nonzero(own[part][:, None] != ids[None]) if exclude_self else np.nonzero(np.ones(score.shape, bool))
                    place = np.zeros(len(i), np.int32)
                else:
                    a = np.argsort(-score, axis=1, kind="stable")[:, :c]
                    place = np.tile(np.arange(1, a.shape[1] + 1, dtype=np.int32), len(score))
                    i, a = np.repeat(np.arange(len(score)), a.shape[1]), a.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(own[part][i]), pa.array(domain[part][i]), pa.array(ids[a]), pa.array(domains[a]), pa.array(score[i, a]), pa.array(place)], names=["id", "domain", "anchor", "anchor_domain", "score", "place"])

    return items.mapInArrow(work, "id long, domain long, anchor long, anchor_domain long, score double, place int")


def knn_distances(items: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, id, score): the k nearest items of each anchor by squared distance (negative), k rows per task and anchor."""
    rows = _bounded(anchors)
    state = items.sparkSession.sparkContext.broadcast((np.array([r["vector"] for r in rows], np.float64) if rows else np.zeros((0, 0)), np.array([r["id"] for r in rows], np.int64)))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, ids = state.value
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # anchor, score, none, id
        for batch in batches:
            x, own = matrix(batch.column("vector")), batch.column("id").to_numpy()
            for begin in range(0, len(own) if len(ids) else 0, 1024):
                part, i = x[begin : begin + 1024], own[begin : begin + 1024]
                score = np.round(-((keys**2).sum(1)[:, None] - 2 * keys @ part.T + (part**2).sum(1)[None]), DIGITS)
                if score.shape[1] > k:
                    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    q, at = np.nonzero(score >= edge[:, None])
                else:
                    q, at = np.nonzero(np.ones(score.shape, bool))
                held = best([np.concatenate(c) for c in zip(held, (q, score[q, at], np.zeros(len(q), np.int64), i[at]), strict=True)], k)
        q, s, _, i = held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q] if len(ids) else q), pa.array(i), pa.array(s)], names=["anchor", "id", "score"])

    found = items.mapInArrow(work, "anchor long, id long, score double")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def means(items: DataFrame, weight: Column | None = None) -> DataFrame:
    """(id, vector, domain, time, mass) per domain: the weighted mean vector; a domain without mass has zeros."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    parts = items.select("domain", w.alias("w"), F.posexplode("vector").alias("at", "x"))
    by_at = parts.groupBy("domain", "at").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("n"), F.sum("w").alias("mass"))
    value = F.when(F.col("mass") > 0, F.col("n") / F.col("mass")).otherwise(0.0)
    found = by_at.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("x")))), lambda s: s["x"]).alias("vector"), F.max("mass").alias("mass"))
    return found.select(F.col("domain").alias("id"), "vector", "domain", F.lit(0).cast("long").alias("time"), "mass")


def shares(pairs: DataFrame, tau: Column | float) -> DataFrame:
    """``pairs`` (id, anchor, score) with ``share``: softmax of tau * score over each id's anchors; shares sum to one."""
    own = Window.partitionBy("id")
    weight = F.exp((tau if isinstance(tau, Column) else F.lit(tau)) * (F.col("score") - F.max("score").over(own)))
    return pairs.withColumn("__w", weight).withColumn("share", F.col("__w") / F.sum("__w").over(own)).drop("__w")


def occurrences(neighbors: DataFrame, items: DataFrame) -> DataFrame:
    """(id, n): how often each item is retrieved, never included."""
    return items.select("id").join(neighbors.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def hubness(counts: DataFrame) -> DataFrame:
    """Skewness (population third moment over the cubed sample deviation), Gini, never-retrieved and largest share.

    The Gini index comes from the histogram of counts, so no global order of the items is made.
    """
    stats = counts.agg(F.count("*").alias("m"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.sum("n").alias("total"), F.max("n").alias("most"))
    bins = counts.groupBy("n").agg(F.count("*").alias("c"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # items of equal count hold the ranks below + 1 .. below + c, whose sum is c * below + c (c + 1) / 2
    ranked = bins.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn("ranks", F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2)
    joined = ranked.join(F.broadcast(stats))  # one row
    return joined.agg(
        (F.sum(F.col("c") * F.pow(F.col("n") - F.col("mean"), F.lit(3))) / F.max("m") / F.pow(F.greatest(F.max("sd"), F.lit(FLOOR)), F.lit(3))).alias("skewness"),
        (F.sum((2 * F.col("ranks") - (F.col("m") + 1) * F.col("c")) * F.col("n")) / F.greatest(F.max("m") * F.max("total"), F.lit(FLOOR))).alias("gini"),
        (F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)) / F.max("m")).alias("never_retrieved"),
        (F.max("most") / F.greatest(F.max("total"), F.lit(FLOOR))).alias("max_share"),
    )
