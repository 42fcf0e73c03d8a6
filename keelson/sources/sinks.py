"""Corpus sinks: checks first, then files, then a manifest that makes them count."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bank import digest


class Refused(ValueError):
    """The rows do not fit together."""


def unique_records(records: DataFrame) -> DataFrame:
    """One row per record_id; the same id with two creation times or texts is an error, not a duplicate."""
    by = records.groupBy("record_id").agg(F.countDistinct("created_at").alias("times"), F.countDistinct("text").alias("texts"), F.max_by(F.struct(*records.columns), F.struct("created_at", "text")).alias("row"))
    clash = F.raise_error(F.concat(F.lit("one identity with two creation times or texts: "), "record_id"))
    return by.withColumn("row", F.when((F.col("times") > 1) | (F.col("texts") > 1), clash).otherwise(F.col("row"))).select("row.*")


def missing_supports(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """Support ids that no record has."""
    return episodes.select(F.explode("supports").alias("s")).select("s.record_id").distinct().join(records.select("record_id"), "record_id", "left_anti")


def gold_histogram(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(F.size("required_ids").alias("gold")).agg(F.count("*").alias("episodes"))


def write_corpus(records: DataFrame, splits: dict[str, DataFrame], out: str, filters: dict[str, int] | None = None) -> dict:
    """Records and episode splits as parquet, and a manifest with counts and digests, written last.

    Refused when an episode names a record that is not there, or when a group is in two splits.
    """
    spark = records.sparkSession
    unique_records(records).write.mode("overwrite").parquet(f"{out}/sources")
    kept = spark.read.parquet(f"{out}/sources")
    manifest: dict = {"sources": {"rows": kept.count(), "digest": digest(kept)}, "filters": filters or {}, "splits": {}}
    for name, df in splits.items():
        if not missing_supports(kept, df).isEmpty():
            raise Refused(f"{name}: supports without a record")
        df.write.mode("overwrite").parquet(f"{out}/episodes-{name}")
        held = spark.read.schema(df.schema).parquet(f"{out}/episodes-{name}")
        manifest["splits"][name] = {"rows": held.count(), "digest": digest(held), "gold": {str(r["gold"]): r["episodes"] for r in gold_histogram(held).collect()}}
    publish(spark, out, manifest)
    return manifest


def publish(spark, out: str, manifest: dict) -> None:
    """The manifest appears under its name only when it is whole."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, now = path(f"{out}/manifest.json.pending"), path(f"{out}/manifest.json")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    fs.delete(now, False)
    fs.rename(new, now)


def mix(base: DataFrame, others: dict[str, DataFrame], cap: int, seed: int, key: str = "episode_id") -> DataFrame:
    """Base rows and at most ``cap`` of each other set by seeded hash order; ids may not be shared between sets."""
    out = base.withColumn("origin", F.lit("base"))
    for name, df in others.items():
        order = F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.col(key)), 256)
        first = df.orderBy(order, key).limit(cap).withColumn("origin", F.lit(name))  # a top-k: cap rows per task
        out = out.unionByName(first)
    twice = out.groupBy(key).agg(F.countDistinct("origin").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise Refused("one id in two sets")
    return out
