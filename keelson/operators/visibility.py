"""Versions, snapshots and causal predicates. The two causal rules differ and both stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(born: Column, dead: Column, cursor: Column | int) -> Column:
    """A version is seen from its birth until its death; 0 is alive."""
    return (born <= cursor) & ((dead == 0) | (dead > cursor))


def before(created: Column, query_time: Column | int) -> Column:
    """The record store's rule: strictly earlier."""
    return created < query_time


def until(time: Column, query_time: Column | int) -> Column:
    """The knowledge-base store's rule: up to and with."""
    return time <= query_time


def versions(df: DataFrame, key: str, order: list[str], born: str) -> DataFrame:
    """``df`` with version (from 1) and dead (the birth of the next version, 0 for the current one)."""
    own = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("version", F.row_number().over(own)).withColumn("dead", F.coalesce(F.lead(born).over(own), F.lit(0)))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key: a partial maximum, no sort and no window."""
    best = F.max(F.struct(*[F.col(c) for c in order], F.struct(*columns).alias("__row"))).alias("__m")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__m.__row.{c}").alias(c) for c in columns])


def retained(journal: DataFrame, key: str, cursor: str, floor: int | Column) -> DataFrame:
    """What garbage collection keeps: every revision from the floor on, and each key's newest one at or below it."""
    newest = journal.where(F.col(cursor) <= floor).groupBy(key).agg(F.max(cursor).alias(cursor))
    return journal.where(F.col(cursor) > floor).unionByName(journal.join(newest, [key, cursor], "left_semi"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)
