"""Exact top-k by inner product: global score histograms locate each query's kth score, a filter does the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

#: A histogram has at most this many bins; each refinement splits one bin into as many.
BINS = 256
#: Sums of products below this are exact in float64.
EXACT = 2.0**53


def quantized(rows, scale: int) -> tuple[np.ndarray, list[int]]:
    """floor(scale * x) of the usable vectors, as rows of float64, and their places; by the first usable vector's width."""
    out, at = [], []
    for k, row in enumerate(rows):
        if row is not None and len(row) and None not in row:
            v = np.floor(np.asarray(row, dtype=np.float64) * scale)
            if np.isfinite(v).all():
                out.append(v)
                at.append(k)
    return out, at


def by_width(vectors: list[np.ndarray], at: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of different lengths have no product: width -> (matrix, places)."""
    widths: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        widths.setdefault(len(v), []).append(k)
    return {w: (np.stack([vectors[k] for k in ks]), np.array([at[k] for k in ks])) for w, ks in widths.items()}


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by float64 where every sum stays below 2^53, else by Python's integers."""
    bound = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0)
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    wide = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64, queries_per_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` best other rows.

    Ties go to the smaller id. Scores are integer inner products of floor(scale * x). The queries are read in blocks of
    about ``queries_per_block`` rows, each broadcast against all rows: a stated query set, not a join of all pairs.

    For each block every row is scored, and partial histograms of the scores are added up by query; the bin that holds
    the kth score is split again until it is one score wide. A last pass keeps scores above it and, at it, the ``k``
    smallest ids of each task: each task sends at most a few bins or 2 * k rows for a query, whatever it reads, and a
    vector that a third of all rows repeat is cut to k rows where it is read.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor does a null id. Vectors of
    different lengths are not compared. Rows with a query's own id are not its candidates; of repeated query rows one is
    asked (the least vector); repeated candidates are each ranked. Products beyond a long are cut to its range.
    """
    source = only(vectors, id=id_col, vector=vector_col).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    asked = source.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // queries_per_block))
    out = None
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).collect()  # about queries_per_block
        one = {}
        for row in sorted((r for r in rows), key=lambda r: (r["id"], repr(r["vector"]))):
            if row["id"] not in one and quantized([row["vector"]], scale)[1]:
                one[row["id"]] = row["vector"]
        found = block_top_k(source, one, k, scale)
        out = found if out is None else out.unionByName(found)
    return out


def block_top_k(source: DataFrame, asked: dict[int, list[float]], k: int, scale: int) -> DataFrame:
    spark = source.sparkSession
    ids = np.array(list(asked), dtype=np.int64)
    groups = by_width(*quantized(asked.values(), scale))
    shipped = spark.sparkContext.broadcast((ids, groups))

    def scored(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of the queries, ids of the rows, scores with the own row's marked by a mask)."""
        ids, groups = shipped.value
        for batch in batches:
            column = batch.column("vector")
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            widths = np.diff(offsets)
            own = batch.column("id").to_numpy()
            if flat.null_count == 0 and column.null_count == 0 and len(widths) and (widths == widths[0]).all():
                values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1) * scale)
                fine = np.isfinite(values).all(axis=1) & (widths > 0)
                rows = {int(widths[0]): (values[fine], np.flatnonzero(fine))}
            else:
                rows = by_width(*quantized(column.to_pylist(), scale))
            for width, (matrix, at) in rows.items():
                if width in groups and len(at):
                    queries, places = groups[width]
                    for begin in range(0, len(at), 2048):
                        part = slice(begin, begin + 2048)
                        yield places, own[at[part]], products(queries, matrix[part])

    def batch_of(schema: list[tuple[str, np.ndarray]]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x) for _, x in schema], names=[n for n, _ in schema])

    def ranges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[int, float] = {}
        for batch in batches:
            for width, (matrix, _) in by_width(*quantized(batch.column("vector").to_pylist(), scale)).items():
                best[width] = max(best.get(width, 0.0), float(np.abs(matrix).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], names=["width", "most"])

    # Ranges of each query's scores, from the lengths of the vectors alone: no score lies outside.
    norms = source.mapInArrow(ranges, "width int, most double").groupBy("width").agg(F.max("most").alias("most"))
    most = {r["width"]: r["most"] for r in norms.collect()} if len(ids) else {}  # a row per vector length
    low = np.zeros(len(ids), dtype=object)  # the bin that holds the kth score: [low, low + size)
    size = np.ones(len(ids), dtype=object)
    above = np.zeros(len(ids), np.int64)  # scores above that bin
    settled = np.zeros(len(ids), bool)  # fewer than k candidates in all: everything is kept
    for width, (queries, places) in groups.items():
        for q, at in zip(queries, places, strict=True):
            reach = min(int(np.abs(q).sum()) * int(most.get(width, 0)) + 1, 2**63 - 1)
            low[at], size[at] = -reach, 2 * reach + 1
    while len(ids) and any(size[~settled] > 1):
        step = np.array([-(-int(s) // BINS) for s in size], dtype=object)
        state = spark.sparkContext.broadcast((low.copy(), step, size.copy(), above.copy(), settled.copy()))

        def histogram(batches: Iterator, state=state) -> Iterator:
            own_ids = shipped.value[0]
            low, step, size, above, settled = state.value
            low64 = np.array([max(int(x), -(2**63)) for x in low], np.int64)
            step64, span = np.array([int(x) for x in step], np.float64), np.array([float(x) for x in size])
            counts = np.zeros((len(low), BINS), np.int64)
            for places, rows, scores in scored(batches):
                # whole steps fit float64 only roughly for huge ranges; integers decide there
                if float(span.max()) < 2**52:
                    bins = (scores - low64[places][:, None]) // step64[places][:, None].astype(np.int64)
                    inside = (scores >= low64[places][:, None]) & (scores - low64[places][:, None] < span[places][:, None])
                else:
                    offset = scores.astype(object) - low[places][:, None]
                    inside = ((offset >= 0) & (offset < size[places][:, None])).astype(bool)
                    bins = (offset // step[places][:, None]).clip(-1, BINS).astype(np.int64)
                inside &= (own_ids[places][:, None] != rows[None, :]) & ~settled[places][:, None]
                q, r = np.nonzero(inside)
                counts += np.bincount(places[q] * BINS + bins[q, r], minlength=counts.size).reshape(counts.shape)
            # Bins below the one where this task alone has k more cannot hold the kth score.
            at_least = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            higher = at_least - counts
            q, b = np.nonzero((counts > 0) & (higher < (k - above)[:, None]))
            yield batch_of([("q", q.astype(np.int32)), ("bin", b.astype(np.int32)), ("n", counts[q, b])])

        sums = source.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        base = sums.withColumn("upto", F.sum("n").over(down))
        wanted = {r["q"]: r for r in base.groupBy("q").agg(F.collect_list(F.struct("bin", "n", "upto")).alias("bins")).collect()}  # under BINS numbers for each query of the block
        for q in range(len(ids)):
            if settled[q]:
                continue
            bins = sorted(wanted[q]["bins"], key=lambda x: -x["bin"]) if q in wanted else []
            hit = next((x for x in bins if above[q] + x["upto"] >= k), None)
            if hit is None:
                settled[q] = True
                low[q] = -(2**63)
                continue
            above[q] += hit["upto"] - hit["n"]
            end = int(low[q]) + int(size[q])
            low[q] = int(low[q]) + hit["bin"] * int(step[q])
            size[q] = min(int(step[q]), end - int(low[q]))
    state = spark.sparkContext.broadcast(np.array([max(int(x), -(2**63)) for x in low], np.int64))

    def keep(batches: Iterator) -> Iterator:
        own_ids, kth = shipped.value[0], state.value
        held: dict[int, list[tuple[int, int]]] = {}
        for places, rows, scores in scored(batches):
            q, r = np.nonzero((scores >= kth[places][:, None]) & (own_ids[places][:, None] != rows[None, :]))
            for p, of, score in zip(places[q].tolist(), rows[r].tolist(), scores[q, r].tolist(), strict=True):
                mine = held.setdefault(p, [])
                mine.append((-score, of))
                if len(mine) > 4 * k:
                    mine.sort()
                    del mine[k:]
        found = [(int(own_ids[p]), of, -score) for p, mine in held.items() for score, of in sorted(mine)[:k]]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        yield batch_of([(n, np.array(x, np.int64)) for n, x in zip(("query_id", "vec_id", "score"), columns, strict=True)])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = source.mapInArrow(keep, "query_id long, vec_id long, score long")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
