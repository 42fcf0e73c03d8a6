"""Registered queries: a name, a builder over the standard tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Which operators of the survey a query exercises.
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None):
    """Register a builder under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(covers.split())
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer splits than that: small tables only, large ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)
