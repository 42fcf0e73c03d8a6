"""What the corpus operators share: durable tables, per-process caches, byte-level words."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z lowered, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in if driver and executors are one process; on a cluster that is an
    error, since each machine would write to a disk of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-shared-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return str(named).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: whatever is lost later is read again from the shared folder, not computed again. All tables of an
    application lie in one folder under its id, which can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """A dictionary that lives as long as this (Python worker) process."""
    module = sys.modules.setdefault("_keelson_llm_process_cache", types.ModuleType("_keelson_llm_process_cache"))
    return module.__dict__.setdefault("held", {})


def cached(name: str, version: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, held in this process until anything else is asked for: a process holds one thing at a time."""
    held = process_cache()
    if name not in held or held[name][0] != version:
        held.clear()
        held[name] = (version, make())
    return held[name][1]


def forget() -> None:
    """Drops what this process holds; for tasks that need none of it, since Python workers are used again."""
    process_cache().clear()


def lowered_words(text: str | None) -> list[bytes]:
    """The UTF-8 words of ``text`` with A-Z lowered, split at space, tab, LF, VT, FF and CR only."""
    return (text or "").encode().translate(LOWER).split()


def joined_by(rows: DataFrame, named: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``named`` (a row per ``key``), whatever key most rows hold.

    ``counts`` says how many rows hold each key, ``total`` at least how many rows there are. Keys of more than a
    thousandth of the total are fewer than a thousand, so they are broadcast; all other keys are small and are shuffled.
    """
    hot = F.col(counts) * 1000 > total
    few = F.broadcast(named.where(hot).drop(counts))
    rest = rows.join(few.select(key), key, "left_anti").join(named.where(~hot).drop(counts), key)
    return rows.join(few, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the columns an operator works on, under its own names, so that further columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
