"""Headline queries at one scale; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Queries whose whole result is worked out; each runs once to warm up on the smallest tables.
HEADLINE = (
    "knn_topk knn_per_domain hubness_stats support_rank_pessimistic soft_field_shares adaptive_field bm25_topk tfidf_eligible_topk benchmark_contamination exact_duplicates "
    "scd2_supersede as_of_latest gc_retained interval_overlaps interval_cover event_commit_accepts quantile_rules effective_counts lineage_composition cascade_delete "
    "group_disjoint_split capped_sample grouping_sets_report multiset_sql_equal cluster_substitution token_windows html_text"
).split()


def knn_200k(spark, sf_dir):
    """64 queries over 200,000 vectors: the table's own, repeated with a small shift that depends on the copy."""
    from pyspark.sql import functions as F

    from keelson.operators import vectors

    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding")
    n = own.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(-(-200_000 // max(n, 1)) - 1))).alias("copy")
    many = own.select("*", copies).select((F.col("copy") * n + F.col("vec_id")).alias("id"), F.transform("embedding", lambda x, k: (x + F.col("copy") * 0.0001 * ((k % 7) - 3)).cast("float")).alias("v"))
    path = os.path.join(tempfile.mkdtemp(prefix="keelson-bench-"), "vectors")
    many.where("id < 200000").repartition(int(CPUS)).write.parquet(path)
    items = vectors.prepared(spark.read.parquet(path), "id", "v", None, None)
    return items, items.where("id % 3125 = 0"), vectors


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from keelson.plans import catalog

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    took: dict[str, float] = {}
    for name in HEADLINE:
        run = catalog.QUERIES[name]
        if os.path.isdir(small):
            run(spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    items, asked, vectors = knn_200k(spark, SF_DIR)
    for _ in range(2):  # the first run warms up; the table is on disk either way
        began = time.perf_counter()
        vectors.knn(items, asked, 16).write.format("noop").mode("overwrite").save()
        took["knn_200k_64_queries"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
