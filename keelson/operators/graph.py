"""Lineage and reachability over edge tables. Every round is a join whose result is cut off by a checkpoint or a file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return str(named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Its plan keeps the size that Spark guessed for ``df``: for rounds that join their own results, see ``stored``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its size is that of its files.

    A checkpoint hands on the guess, and for a join that is the product of both sides: where each round joins results of
    the last one with each other, the digits of that number double in every round, until the driver has no room for it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keelson-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(node): all that can be reached from the seeds along (parent, child); only new nodes go on."""
    seen = frontier = checkpointed(seeds.select("node").distinct())
    for _ in range(rounds):
        found = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = checkpointed(found.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # each round's part is written once
    raise RuntimeError("no end within the given rounds")


def composition(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(item, source, share): weighted lineage (item, contributor, weight) resolved to sources; shares sum to one.

    A contributor that is no item is a source. An item whose weights sum to 0 has no sources. A cycle is an error.
    """
    totals = edges.groupBy("item").agg(F.sum("weight").alias("total"))
    parts = checkpointed(edges.join(totals, "item").where("total > 0 AND weight <> 0").select("item", "contributor", (F.col("weight") / F.col("total")).alias("share")))
    items = checkpointed(edges.select(F.col("item").alias("contributor")).distinct())
    done = parts.join(items, "contributor", "left_anti")
    open_ = parts.join(items, "contributor", "left_semi")
    for _ in range(rounds):
        open_ = checkpointed(open_)
        if open_.isEmpty():
            return done.groupBy("item", F.col("contributor").alias("source")).agg(F.sum("share").alias("share"))
        below = parts.select(F.col("item").alias("contributor"), F.col("contributor").alias("next"), F.col("share").alias("s"))
        step = open_.join(below, "contributor").groupBy("item", F.col("next").alias("contributor")).agg(F.sum(F.col("share") * F.col("s")).alias("share"))
        step = checkpointed(step)
        done = checkpointed(done.unionByName(step.join(items, "contributor", "left_anti")))
        open_ = step.join(items, "contributor", "left_semi")
    raise ValueError("the lineage has a cycle")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node connected with each node of (a, b): large-star and small-star steps in turn.

    They end when all edges lead to a root, after few rounds also on long paths. Joins are merged: edges grow with the
    nodes, so none are collected by the driver to be broadcast. A null node has a null root and links nothing.
    """
    both = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    given = stored(edges.select("a", "b").distinct())
    stars = stored(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(stars.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty():
            own = both(given).select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("b").alias("root")))
            return own.groupBy("node").agg(F.min("root").alias("root"))
        around = both(stars)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(around.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = stored(small.select("e.*").where("a <> b").distinct())
    raise RuntimeError("no end within the given rounds")
