"""Vector search, ranks, soft fields and geometry over ``embeddings``.

Queries of a search are the rows whose id is divisible by 50; label stands for the domain and the id for the time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from .registry import query, table

#: In SQL: unit-free vectors with norms, and the scores of the asked rows with all others.
VEC = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS nrm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, round(list_dot_product(q.e, c.e) / (q.nrm * c.nrm), 9) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)"""
TOP = "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM {of} {where} QUALIFY rank <= {k}"


def items(spark, sf_dir):
    return V.prepared(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label"), F.col("vec_id"))


def asked(df):
    return df.where("id % 50 = 0")


def shown(df):
    return df.withColumn("score", F.round("score", 6))


@query("T01 T04 T05 T09 V27 S26 F06", VEC + TOP.format(of="s", where="", k=10))
def knn_topk(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 10))


@query("T07", VEC + TOP.format(of="s", where="", k=10))
def knn_margin(spark, sf_dir):
    """The same by single precision first: 64 more than asked for are then scored exactly and ordered."""
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 10, margin=64))


@query("T01 T02", VEC.replace("/ (q.nrm * c.nrm)", "") + TOP.format(of="s", where="", k=10))
def knn_dot(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 10, metric="dot"))


@query("F03 T04", VEC + TOP.format(of="s", where="WHERE id < query_id", k=10))
def knn_causal_strict(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 10, causal="strict"))


@query("F01 T01", VEC.replace("AND q.vec_id <> c.vec_id", "") + TOP.format(of="s", where="WHERE id <= query_id", k=10))
def knn_causal_inclusive(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 10, causal="inclusive", exclude_self=False))


@query("T03 T06 F04", VEC + TOP.format(of="s", where="WHERE ql = cl", k=5))
def knn_per_domain(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.knn(x, asked(x), 5, same_domain=True))


@query("T03 T08 U01 F05 F25", VEC + "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cl, id) AS INTEGER) AS rank FROM s WHERE cl IN (1, 3, 5) QUALIFY rank <= 10")
def knn_federated(spark, sf_dir):
    """Each allowed domain is searched on its own; the lists are merged by (score, domain, id)."""
    x = items(spark, sf_dir)
    parts = [V.knn(x.where(F.col("domain") == d), asked(x), 10).withColumn("domain", F.lit(d)) for d in (1, 3, 5)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain", "id")
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("query_id", "id", "score", "rank"))


@query("T06 T11 F21 F22 J24", VEC + TOP.format(of="s", where="WHERE id % 3 <> query_id % 3", k=10))
def knn_exclude(spark, sf_dir):
    """Rows that share the query's remainder by 3 are excluded before the ranking."""
    x = items(spark, sf_dir)
    q, own = asked(x).withColumn("domain", F.col("id") % 3), x.withColumn("domain", F.col("id") % 3)
    parts = [V.knn(own.where(F.col("domain") != d), q.where(F.col("domain") == d), 10) for d in range(3)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return shown(out.withColumn("rank", F.row_number().over(best)))


@query("P48 T05 J19", VEC + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
b AS (SELECT query_id, 1 AS step, id, score, r FROM a WHERE r <= 4 UNION ALL SELECT query_id, 2, id, score, r - 4 FROM a WHERE r > 4 AND r <= 8)
SELECT query_id, CAST(step AS INTEGER) AS step, id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM b""")
def knn_two_step_session(spark, sf_dir):
    """The second read of a session excludes what the first one returned."""
    x = items(spark, sf_dir)
    first = V.knn(x, asked(x), 4)
    taken: dict[int, list[int]] = {}
    for r in first.select("query_id", "id").collect():  # 4 rows for each query of the stated set
        taken.setdefault(r["query_id"], []).append(r["id"])
    second = V.knn(x, asked(x), 4, excluded=taken)
    return shown(first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2))).select("query_id", "step", "id", "score", "rank"))


CENTRES = """, m AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY label, i),
c AS (SELECT label AS anchor, list(x ORDER BY i) AS ce FROM m GROUP BY label),
cs AS (SELECT vec_id AS id, n.label AS domain, anchor, round(list_dot_product(e, ce) / (nrm * greatest(sqrt(list_dot_product(ce, ce)), 1e-12)), 9) AS score, round(-(list_dot_product(e, e) - 2 * list_dot_product(e, ce) + list_dot_product(ce, ce)), 9) AS d FROM n, c),
top3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, anchor) AS INTEGER) AS place FROM cs QUALIFY place <= 3)"""
SHARES = CENTRES + ", sh AS (SELECT id, anchor, domain, score, exp(8 * (score - max(score) OVER (PARTITION BY id))) AS w, place FROM top3), f AS (SELECT id, anchor, domain, score, place, w / sum(w) OVER (PARTITION BY id) AS share FROM sh)"


def field(spark, sf_dir):
    """Each vector's shares over its three nearest label centres."""
    x = items(spark, sf_dir)
    return V.shares(V.nearest(x, V.means(x), 3), 8.0)


@query("T10 V02", VEC + CENTRES + " SELECT id, anchor, round(score, 6) AS score FROM top3 WHERE place = 1")
def nearest_centroid_argmax(spark, sf_dir):
    x = items(spark, sf_dir)
    return shown(V.nearest(x, V.means(x), 1).select("id", "anchor", "score"))


@query("V04 V06 V07", VEC + SHARES + " SELECT id, anchor, round(share, 6) AS share FROM f")
def soft_field_shares(spark, sf_dir):
    return field(spark, sf_dir).select("id", "anchor", F.round("share", 6).alias("share"))


@query("V05 V08 V09", VEC + SHARES + " SELECT anchor, count(*) AS n, round(sum(share), 5) AS mass, max(id) AS time FROM f GROUP BY anchor")
def field_mass(spark, sf_dir):
    return field(spark, sf_dir).groupBy("anchor").agg(F.count("*").alias("n"), F.round(F.sum("share"), 5).alias("mass"), F.max("id").alias("time"))


@query("V24", VEC + CENTRES + ", d2 AS (SELECT id, anchor, d FROM cs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC, anchor) <= 2), w AS (SELECT *, exp((d - max(d) OVER (PARTITION BY id)) / 0.5) AS w FROM d2) SELECT id, anchor, round(w / sum(w) OVER (PARTITION BY id), 6) AS share FROM w")
def distance_field(spark, sf_dir):
    x = items(spark, sf_dir)
    return V.shares(V.nearest(x, V.means(x), 2, distance=True), 2.0).select("id", "anchor", F.round("share", 6).alias("share"))


@query("V25", VEC + CENTRES + """, k AS (SELECT anchor, greatest(-min(d), 1e-6) AS scale FROM (SELECT anchor, d FROM cs QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d DESC, id) <= 8) GROUP BY anchor),
d2 AS (SELECT id, anchor, d / scale AS d, d AS raw FROM cs JOIN k USING (anchor)), d3 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY raw DESC, anchor) <= 2),
w AS (SELECT *, exp(d - max(d) OVER (PARTITION BY id)) AS w FROM d3) SELECT id, anchor, round(w / sum(w) OVER (PARTITION BY id), 6) AS share FROM w""")
def adaptive_field(spark, sf_dir):
    """Each centre's bandwidth is its squared distance to its 8th nearest input: kept as 8 rows per centre and task."""
    x = items(spark, sf_dir)
    centres = V.means(x)
    near = V.knn_distances(x, centres, 8)
    scale = near.groupBy("anchor").agg(F.greatest(-F.min("score"), F.lit(1e-6)).alias("scale"))
    pairs = V.nearest(x, centres, 2, distance=True).join(F.broadcast(scale), "anchor")  # a row per centre
    return V.shares(pairs.withColumn("score", F.col("score") / F.col("scale")), 1.0).select("id", "anchor", F.round("share", 6).alias("share"))


@query("V10 V13 A04", VEC + SHARES + " SELECT anchor, domain, round(sum(share) / sum(sum(share)) OVER (PARTITION BY anchor), 5) AS part FROM f GROUP BY anchor, domain")
def row_composition(spark, sf_dir):
    """What part of each row's mass comes from each label."""
    by = field(spark, sf_dir).groupBy("anchor", "domain").agg(F.sum("share").alias("s"))
    return by.select("anchor", "domain", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("anchor")), 5).alias("part"))


@query("V22 V10", VEC + SHARES + " SELECT id, anchor FROM f WHERE place = 1 AND anchor NOT IN (2, 4)")
def leaf_holder(spark, sf_dir):
    """The row that holds most of each leaf, minus banned rows."""
    best = field(spark, sf_dir).groupBy("id").agg(F.max_by("anchor", F.struct("share", -F.col("anchor"))).alias("anchor"))
    return best.where("anchor NOT IN (2, 4)")


@query("V11 V12 V21", VEC + SHARES + ", c2 AS (SELECT domain, anchor, sum(share) AS s FROM f GROUP BY domain, anchor) SELECT domain, anchor, round(s, 5) AS share, CAST(row_number() OVER (PARTITION BY domain ORDER BY round(s, 9) DESC, anchor) AS INTEGER) AS place FROM c2 QUALIFY place <= 4")
def covering_rows(spark, sf_dir):
    """For the leaves of a label: the rows that cover them, the largest share first."""
    by = field(spark, sf_dir).groupBy("domain", "anchor").agg(F.sum("share").alias("s"))
    order = Window.partitionBy("domain").orderBy(F.desc(F.round("s", 9)), "anchor")
    return by.withColumn("place", F.row_number().over(order)).where("place <= 4").select("domain", "anchor", F.round("s", 5).alias("share"), "place")


@query("V14", VEC + SHARES + ", a AS (SELECT anchor, count(*) AS leaves FROM f GROUP BY anchor) SELECT count(*) AS rows_filled, max(leaves) AS most, min(leaves) AS least, CAST(sum(leaves) AS BIGINT) AS links FROM a")
def field_stats(spark, sf_dir):
    by = field(spark, sf_dir).groupBy("anchor").agg(F.count("*").alias("leaves"))
    return by.agg(F.count("*").alias("rows_filled"), F.max("leaves").alias("most"), F.min("leaves").alias("least"), F.sum("leaves").alias("links"))


@query("J16 J18", VEC + ", a AS (SELECT query_id, id, score FROM s WHERE score <= 0.9995) SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM a QUALIFY rank <= 5")
def knn_self_join_dedup(spark, sf_dir):
    """Neighbours that are no duplicates: scores over 0.9995, the row itself included, are cut before the ranking."""
    x = items(spark, sf_dir)
    return shown(V.knn(x.withColumn("domain", F.lit(0).cast("long")), asked(x), 5, most=0.9995).select("query_id", "id", "score", "rank"))


HUB = VEC + """, t AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 16), c AS (SELECT vec_id, count(query_id) AS n FROM v LEFT JOIN t ON vec_id = id GROUP BY vec_id),
g AS (SELECT avg(n) AS mean, stddev_samp(n) AS sd, count(*) AS m, sum(n) AS total FROM c), r AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM c)"""


@query("A15 A16 E10", HUB + """ SELECT round((SELECT sum(pow(n - mean, 3)) / max(m) / pow(max(sd), 3) FROM c, g), 5) AS skewness, round((SELECT sum((2 * r - m - 1) * n) / (max(m) * max(total)) FROM r, g), 5) AS gini,
round((SELECT avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END) FROM c), 5) AS never_retrieved, round((SELECT max(n) / max(total) FROM c, g), 5) AS max_share""")
def hubness_stats(spark, sf_dir):
    x = items(spark, sf_dir)
    out = V.hubness(V.occurrences(V.knn(x, asked(x), 16), x))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


RANKS = VEC + ", r AS (SELECT query_id, id, count(*) OVER (PARTITION BY query_id ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, ql = cl AS positive FROM s)"


def ranks(spark, sf_dir):
    """Pessimistic ranks of each query's positives (its label): ties rank last."""
    x = items(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return V.scored(x, asked(x)).withColumn("rank", F.count("*").over(order)).where("query_domain = domain").select("query_id", "id", "rank")


@query("W01", RANKS + " SELECT query_id, id, rank FROM r WHERE positive")
def support_rank_pessimistic(spark, sf_dir):
    return ranks(spark, sf_dir)


@query("A14 J20", RANKS + ", b AS (SELECT query_id, min(rank) AS best, max(rank) AS worst FROM r WHERE positive GROUP BY query_id) SELECT count(*) AS sites, round(avg(CASE WHEN best <= 16 THEN 1.0 ELSE 0 END), 6) AS any_support, round(avg(CASE WHEN worst <= 256 THEN 1.0 ELSE 0 END), 6) AS all_support, round(avg(CASE WHEN best <= 256 THEN 1.0 ELSE 0 END), 6) AS recall_at_256, list_sort(list(best))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median_best FROM b")
def recall_summary(spark, sf_dir):
    """The median of the best rank is the upper one."""
    b = ranks(spark, sf_dir).groupBy("query_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    out = b.agg(F.count("*").alias("sites"), share(F.col("best") <= 16).alias("any_support"), share(F.col("worst") <= 256).alias("all_support"), share(F.col("best") <= 256).alias("recall_at_256"), F.sort_array(F.collect_list("best")).alias("all"))
    return out.select("sites", "any_support", "all_support", "recall_at_256", F.get("all", F.floor(F.col("sites") / 2).cast("int")).alias("median_best"))


@query("A47", RANKS + ", b AS (SELECT query_id, max(rank) AS worst FROM r WHERE positive GROUP BY query_id) SELECT median(worst) AS median_rank, round(avg(1.0 / worst), 6) AS mrr, round(avg(CASE WHEN worst <= 8 THEN 1.0 ELSE 0 END), 6) AS recall_8, round(avg(CASE WHEN worst <= 128 THEN 1.0 ELSE 0 END), 6) AS recall_128 FROM b")
def mrr_recall(spark, sf_dir):
    b = ranks(spark, sf_dir).groupBy("query_id").agg(F.max("rank").alias("worst"))
    share = lambda n: F.round(F.avg(F.when(F.col("worst") <= n, 1.0).otherwise(0.0)), 6)
    return b.agg(F.median("worst").alias("median_rank"), F.round(F.avg(1.0 / F.col("worst")), 6).alias("mrr"), share(8).alias("recall_8"), share(128).alias("recall_128"))


@query("V15 A20", VEC + ", m AS (SELECT label, i, sum((1 + vec_id % 7) * e[i]) / sum(1 + vec_id % 7) AS x, sum(1 + vec_id % 7) AS mass FROM (SELECT vec_id, label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY label, i), z AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS l FROM m GROUP BY label) SELECT label, CAST(i - 1 AS INTEGER) AS at, round(x / l, 6) AS x, CAST(mass AS DOUBLE) AS mass FROM m JOIN z USING (label)")
def weighted_mean_key(spark, sf_dir):
    """The unit mean key of each label under masses, with the mass carried along."""
    m = V.means(items(spark, sf_dir), 1 + F.col("id") % 7)
    length = F.greatest(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), F.lit(V.FLOOR))
    return m.select(F.col("id").cast("int").alias("label"), "mass", F.posexplode(F.transform("vector", lambda x: F.round(x / length, 6))).alias("at", "x")).select("label", "at", "x", "mass")


@query("A18", VEC + ", m AS (SELECT i, avg(e[i] / nrm) AS x FROM (SELECT e, nrm, unnest(range(1, len(e) + 1)) AS i FROM n) GROUP BY i), d AS (SELECT list(x ORDER BY i) AS me, greatest(sqrt(sum(x * x)), 1e-12) AS ml FROM m) SELECT round(avg(list_dot_product(e, me) / (nrm * ml)), 6) AS cosine FROM n, d")
def mean_direction_cosine(spark, sf_dir):
    """Mean cosine to the mean direction: the length of the mean of unit vectors, so one pass over dimensions."""
    x = items(spark, sf_dir)
    norm = F.greatest(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))), F.lit(V.FLOOR))
    parts = x.withColumn("norm", norm).select("norm", F.posexplode("vector").alias("at", "y")).groupBy("at").agg(F.avg(F.col("y").cast("double") / F.col("norm")).alias("m"))
    return parts.agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("cosine"))


@query("A19", VEC + " SELECT round(ln(avg(exp(-2 * (2 - 2 * score)))), 6) AS uniformity FROM s")
def uniformity(spark, sf_dir):
    x = items(spark, sf_dir)
    by = V.folded(x, asked(x), {"e": lambda s, _: np.exp(-2 * (2 - 2 * s)), "n": lambda s, _: np.ones(s.shape)})
    return by.agg(F.round(F.ln(F.sum("e") / F.sum("n")), 6).alias("uniformity"))


LSE = VEC + ", z AS (SELECT query_id, ql = cl AS positive, exp(10 * (score - max(score) OVER (PARTITION BY query_id))) AS w FROM s), l AS (SELECT query_id, -ln(sum(w) FILTER (positive) / sum(w)) AS loss FROM z GROUP BY query_id)"


@query("A36 T19", LSE + " SELECT query_id, round(loss, 6) AS loss FROM l")
def softmax_retrieval_loss(spark, sf_dir):
    """-log of the softmax mass on a query's positives; partial sums at a shared scale (no score is over 1)."""
    x = items(spark, sf_dir)
    by = V.folded(x, asked(x), {"p": lambda s, own: own * np.exp(10 * (s - 1)), "all": lambda s, _: np.exp(10 * (s - 1))})
    return by.where("p > 0").select("query_id", F.round(-F.ln(F.col("p") / F.col("all")), 6).alias("loss"))


@query("A37 A40", VEC + ", z AS (SELECT query_id, 10 * score AS a, 5 * score AS b FROM s), y AS (SELECT query_id, a - ln(sum(exp(a)) OVER (PARTITION BY query_id)) AS la, b - ln(sum(exp(b)) OVER (PARTITION BY query_id)) AS lb FROM z) SELECT query_id, round(sum(exp(la) * (la - lb)), 6) AS kl FROM y GROUP BY query_id")
def teacher_kl(spark, sf_dir):
    """KL of the softmaxes of teacher and student scores over the same field: all sums in one aggregation."""
    x = items(spark, sf_dir)
    by = V.folded(x, asked(x), {"za": lambda s, _: np.exp(10 * s), "zb": lambda s, _: np.exp(5 * s), "g": lambda s, _: np.exp(10 * s) * 5 * s})
    return by.select("query_id", F.round(F.col("g") / F.col("za") - F.ln("za") + F.ln("zb"), 6).alias("kl"))


@query("A41 A42", VEC + ", z AS (SELECT query_id, ql = cl AS positive, exp(10 * score) AS a, exp(5 * score) AS b FROM s), p AS (SELECT query_id, sum(a) FILTER (positive) / sum(a) AS pa, sum(b) FILTER (positive) / sum(b) AS pb FROM z GROUP BY query_id) SELECT query_id, round(-ln(1 - (1 - pa) * (1 - pb)), 6) AS loss FROM p WHERE pa IS NOT NULL")
def union_field_loss(spark, sf_dir):
    """-log(1 - prod(1 - p)) over two spaces of the same field."""
    x = items(spark, sf_dir)
    by = V.folded(x, asked(x), {"a": lambda s, own: own * np.exp(10 * s), "b": lambda s, own: own * np.exp(5 * s), "za": lambda s, _: np.exp(10 * s), "zb": lambda s, _: np.exp(5 * s)})
    by = by.where("a > 0").select("query_id", (F.col("a") / F.col("za")).alias("pa"), (F.col("b") / F.col("zb")).alias("pb"))
    return by.select("query_id", F.round(-F.ln(1 - (1 - F.col("pa")) * (1 - F.col("pb"))), 6).alias("loss"))


@query("J17 N14", VEC + """, a AS (SELECT query_id, id, 0 AS src, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 6),
b AS (SELECT query_id, id, 1 AS src, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE ql = cl QUALIFY r <= 6),
u AS (SELECT query_id, id, min(r * 2 + src) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, id) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS place FROM u QUALIFY place <= 8""")
def interleaved_candidates(spark, sf_dir):
    """Two ranked lists taken in turn, the first sight of an item counts, cut at 8."""
    x = items(spark, sf_dir)
    a, b = V.knn(x, asked(x), 6).withColumn("src", F.lit(0)), V.knn(x, asked(x), 6, same_domain=True).withColumn("src", F.lit(1))
    first = a.unionByName(b).groupBy("query_id", "id").agg(F.min(F.col("rank") * 2 + F.col("src")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first")
    return first.withColumn("place", F.row_number().over(order)).where("place <= 8").select("query_id", "id", "place")


@query("V03", VEC + ", c AS (SELECT label, count(*) AS n FROM v GROUP BY label), q AS (SELECT label, n, 37.0 * n / sum(n) OVER () AS want FROM c), f AS (SELECT label, floor(want) AS base, want - floor(want) AS rest FROM q), r AS (SELECT *, row_number() OVER (ORDER BY round(rest, 9) DESC, label) AS k, 37 - sum(base) OVER () AS left_ FROM f) SELECT label, CAST(base + CASE WHEN k <= left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def bucket_quotas(spark, sf_dir):
    """Largest-remainder quotas of 37 rows over the labels; the windows run over one row per label."""
    c = items(spark, sf_dir).groupBy(F.col("domain").cast("int").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    f = c.withColumn("want", 37.0 * F.col("n") / F.sum("n").over(every)).withColumn("base", F.floor("want")).withColumn("rest", F.round(F.col("want") - F.col("base"), 9))
    r = f.withColumn("k", F.row_number().over(Window.orderBy(F.desc("rest"), "label"))).withColumn("left", 37 - F.sum("base").over(every))
    return r.select("label", (F.col("base") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))
