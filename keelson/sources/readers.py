"""Scans with explicit schemas. Nothing is inferred; rows that break a rule go to a quarantine with the reason."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("created_at", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("provenance", T.StringType())])
SUPPORT = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("created_at", T.LongType()), T.StructField("kind", T.StringType())])
EPISODE = T.StructType([
    T.StructField("episode_id", T.StringType()), T.StructField("environment", T.StringType()), T.StructField("query", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("query_time", T.LongType()),
    T.StructField("required_ids", T.ArrayType(T.StringType())), T.StructField("sufficient_groups", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("supports", T.ArrayType(SUPPORT)), T.StructField("task_family", T.StringType()), T.StructField("verify", T.StringType()),
])


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One top-level array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet(spark: SparkSession, path: str | list[str], columns: list[str], where: Column | None = None) -> DataFrame:
    """Projection and filter reach the scan."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    return (df if where is None else df.where(where)).select(*columns)


def episode_fault() -> Column:
    """The first rule that an episode breaks, or null."""
    ids = F.transform("supports", lambda s: s["record_id"])
    return (
        F.when(F.col("episode_id").isNull() | (F.col("episode_id") == ""), "no_id")
        .when(F.col("supports").isNull() | (F.size("supports") == 0), "no_supports")
        .when(F.exists("supports", lambda s: s["created_at"] >= F.col("query_time")), "support_not_before_query")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated_support")
        .when(F.size(F.array_except(F.coalesce("required_ids", F.array().cast("array<string>")), ids)) > 0, "required_missing")
        .when(F.col("choices").isNotNull() & (F.size("choices") > 0) & ~F.array_contains("choices", F.col("answer")), "answer_not_in_choices")
    )


def episodes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with ``reason``); ids that occur twice and supports with two identities are faults as well."""
    own = Window.partitionBy("episode_id")
    marked = raw.withColumn("__n", F.count("*").over(own)).withColumn("reason", F.when(F.col("__n") > 1, "repeated_id").otherwise(episode_fault())).drop("__n")
    shared = marked.where("reason IS NULL").select(F.explode("supports").alias("s")).groupBy("s.record_id").agg(F.countDistinct("s.text", "s.created_at").alias("n")).where("n > 1").select(F.col("record_id").alias("__two"))
    touched = marked.select("episode_id", F.explode("supports").alias("s")).join(shared, F.col("s.record_id") == F.col("__two"), "left_semi").select("episode_id").distinct().withColumn("__bad", F.lit(True))
    full = marked.join(touched, "episode_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__bad"), "support_with_two_identities"))).drop("__bad")
    return full.where("reason IS NULL").drop("reason"), full.where("reason IS NOT NULL")


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Rows that do not parse are kept in ``_bad`` instead of being lost."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").csv(path, sep=sep, header=header, encoding=encoding, quote='"', escape='"')


def described_columns(spark: SparkSession, path: str) -> DataFrame:
    """(column, description) keyed by lower-case name: UTF-8 with or without a mark, else Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    lines = raw.select(F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n")).alias("n", "line")).where("n > 0 AND line <> ''")
    parts = F.from_csv("line", F.lit("column STRING, description STRING"))
    return lines.select(parts.alias("p")).select(F.lower(F.trim("p.column")).alias("column"), F.trim("p.description").alias("description"))


def dated_base64(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(date, split text, whole text) of gzip or plain tab-separated lines with base64 fields, and malformed lines counted."""
    fields = F.split("value", "\t", -1)
    lines = spark.read.text(path).select("value", F.size(fields).alias("n"), fields.alias("f"))
    fine = lines.where("n = 3").select(F.to_date(F.col("f")[0], "yyyyMMdd").alias("date"), F.try_to_binary(F.col("f")[1], F.lit("base64")).cast("string").alias("split_text"), F.try_to_binary(F.col("f")[2], F.lit("base64")).cast("string").alias("text"))
    bad = lines.where("n <> 3").agg(F.count("*").alias("malformed"))
    return fine.where("text IS NOT NULL AND date IS NOT NULL"), bad


def members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(archive, member, content): matching files of tar archives, plain or gzip or bzip2, read as streams."""
    wanted = re.compile(pattern)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                head = content[:3]
                stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if head[:2] == b"\x1f\x8b" else bz2.BZ2File(io.BytesIO(content)) if head == b"BZh" else io.BytesIO(content)
                with tarfile.open(fileobj=stream, mode="r|") as tar:
                    for member in tar:
                        if member.isfile() and wanted.search(member.name):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.name]), pa.array([tar.extractfile(member).read()], pa.binary())], names=["archive", "member", "content"])

    return files.mapInArrow(work, "archive string, member string, content binary")


def numbered_stories(lines: DataFrame) -> DataFrame:
    """(story, line, text, question, answer, support): numbered lines; 1 starts a story, tabs divide a question.

    ``lines`` has ``file``, ``n`` (the place in the file) and ``value``.
    """
    number = F.regexp_extract("value", "^(\\d+) ", 1).cast("int")
    rest = F.regexp_replace("value", "^\\d+ ", "")
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split("rest", "\t")
    told = lines.withColumn("line", number).withColumn("rest", rest).where("line IS NOT NULL").withColumn("story", F.sum(F.when(F.col("line") == 1, 1).otherwise(0)).over(order))
    asks = F.size(parts) >= 2
    return told.select("file", "story", "line", F.when(~asks, F.trim("rest")).alias("text"), F.when(asks, F.trim(parts[0])).alias("question"), F.when(asks, F.trim(parts[1])).alias("answer"), F.when(asks, F.transform(F.split(F.trim(F.get(parts, F.lit(2))), " "), lambda x: x.cast("int"))).alias("support"))


def sqlite_tables(spark: SparkSession, path: str, values: int = 8, rows: int = 5) -> DataFrame:
    """(database, tab, create_sql, n_rows, col, kind, distinct_values, sample): the catalog of SQLite files.

    A file is opened in the memory of its task; at most ``values`` + 1 distinct values and ``rows`` samples are read of a
    column, as the catalog's definition says. Columns with more distinct values have none listed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator) -> Iterator:
        import sqlite3

        import pyarrow as pa

        names = ["database", "tab", "create_sql", "n_rows", "col", "kind", "distinct_values", "sample"]
        for batch in batches:
            out = []
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                for tab, create in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                    own = '"' + tab.replace('"', '""') + '"'
                    n = db.execute(f"SELECT count(*) FROM {own}").fetchone()[0]
                    for _, col, kind, *_ in db.execute(f"PRAGMA table_info({own})").fetchall():
                        c = '"' + col.replace('"', '""') + '"'
                        found = [str(r[0]) for r in db.execute(f"SELECT DISTINCT {c} FROM {own} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT {values + 1}")]
                        sample = [str(r[0]) for r in db.execute(f"SELECT {c} FROM {own} LIMIT {rows}")]
                        out.append((file, tab, create, n, col, kind, found if len(found) <= values else None, sample))
                db.close()
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(work, "database string, tab string, create_sql string, n_rows long, col string, kind string, distinct_values array<string>, sample array<string>")


def first_file_wins(chunks: DataFrame, document: str, order: str, file_rank: str, text: str) -> DataFrame:
    """(document, text): chunk rows put together in order; of a document in several files, the first file's rows count."""
    first = chunks.groupBy(document).agg(F.min(file_rank).alias(file_rank))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return chunks.join(first, [document, file_rank], "left_semi").groupBy(document).agg(F.array_join(parts, "\n").alias("text"))
