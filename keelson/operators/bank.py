"""An append-only versioned bank on parquet: commits, snapshots, rewrites, compaction and rollback.

A commit writes its rows and its deaths as new files, then a manifest of its own; files that no manifest names do not
exist for a reader, so a lost writer leaves nothing to undo. A cursor is the number of a commit.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, vectors, visibility

#: Shares of an input may miss one by this; they are then made to sum to one.
TOLERANCE = 1e-4

ITEM = T.StructType([
    T.StructField("space", T.StringType()), T.StructField("id", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("born", T.LongType()),
    T.StructField("time", T.LongType()), T.StructField("mass", T.FloatType()), T.StructField("key", T.ArrayType(T.FloatType())), T.StructField("values", T.ArrayType(T.ArrayType(T.FloatType()))),
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("lineage", T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("share", T.DoubleType())]))),
    T.StructField("derived", T.BooleanType()),
])
DEATH = T.StructType([T.StructField("space", T.StringType()), T.StructField("id", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("dead", T.LongType())])


@dataclass
class Bank:
    spark: SparkSession
    root: str

    # -- manifest -------------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        """The newest manifest: the one of the last turn."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/manifest-*.json"))
        if not found:
            raise FileNotFoundError(self.root)
        stream = fs.open(max((f.getPath() for f in found), key=lambda p: p.getName()))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The manifest that follows the one it was made from: written aside, then renamed to a name that must not exist.

        Older manifests stay, so a reader finds one at any time. Of two writers that follow the same one the second fails.
        """
        fs, path = self._fs()
        sc, turn = self.spark.sparkContext, manifest.get("turn", 0) + 1
        manifest = manifest | {"turn": turn}
        new, now = path(f"{self.root}/_manifest-{uuid.uuid4().hex}"), path(f"{self.root}/manifest-{turn:012}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        hadoop = sc._jvm.org.apache.hadoop.fs
        to = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            to.rename(fs.makeQualified(new), fs.makeQualified(now), sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            fs.delete(new, False)
            raise RuntimeError("another writer has committed") from e

    @classmethod
    def create(cls, spark: SparkSession, root: str, dataset: str, spaces: list[str]) -> Bank:
        bank = cls(spark, root.rstrip("/"))
        fs, path = bank._fs()
        if fs.globStatus(path(f"{bank.root}/manifest-*.json")):
            raise FileExistsError(bank.root)
        fs.mkdirs(path(bank.root))
        bank._publish({"dataset": dataset, "spaces": sorted(spaces), "cursor": 0, "commits": []})
        return bank

    # -- reading --------------------------------------------------------------
    def _read(self, kind: str, schema: T.StructType, cursor: int | None) -> DataFrame:
        m = self.manifest()
        limit = m["cursor"] if cursor is None else cursor
        if not 0 <= limit <= m["cursor"]:
            raise ValueError(f"cursor {limit} of {m['cursor']}")
        files = [f"{self.root}/{c[kind]}" for c in m["commits"] if c["cursor"] <= limit and c.get(kind)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def items(self, cursor: int | None = None) -> DataFrame:
        """All versions up to a cursor, with ``dead`` (0: alive)."""
        return self._read("rows", ITEM, cursor).join(self._read("deaths", DEATH, cursor), ["space", "id", "version"], "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))

    def current(self, cursor: int | None = None) -> DataFrame:
        """What is visible at a cursor."""
        at = self.manifest()["cursor"] if cursor is None else cursor
        return self.items(cursor).where(visibility.visible(F.col("born"), F.col("dead"), at))

    def read(self, space: str, ids: DataFrame, cursor: int | None = None) -> DataFrame:
        """The visible version of each asked id; an id that has none is an error."""
        found = ids.select("id").distinct().join(self.current(cursor).where(F.col("space") == space), "id", "left")
        return found.withColumn("space", F.when(F.col("space").isNull(), F.raise_error(F.concat(F.lit("no visible item "), "id"))).otherwise(F.col("space")))

    def search(self, space: str, queries: DataFrame, k: int, *, cursor: int | None = None, causal: str | None = "inclusive") -> DataFrame:
        """Exact nearest visible items; string ids are numbered by a hash of 63 bits for the ranking and put back."""
        number = F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
        own = self.current(cursor).where(F.col("space") == space).withColumn("n", number)
        rows = vectors.prepared(own, "n", "key", None, F.col("time"))
        names = own.select("n", "id")
        found = vectors.knn(rows, queries, k, causal=causal, exclude_self=False)
        return found.withColumnRenamed("id", "n").join(names, "n").select("query_id", "id", "score", "rank")

    # -- writing --------------------------------------------------------------
    def _commit(self, rows: DataFrame | None, deaths: DataFrame | None, note: str) -> int:
        m = self.manifest()
        at = m["cursor"] + 1
        entry = {"cursor": at, "note": note}
        for kind, df, schema, stamp in (("rows", rows, ITEM, "born"), ("deaths", deaths, DEATH, "dead")):
            if df is not None:
                name = f"{kind}-{at}-{uuid.uuid4().hex}"
                full = df.withColumn(stamp, F.lit(at).cast("long"))
                full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.root}/{name}")
                entry[kind] = name
                entry[f"{kind}_digest"] = digest(self.spark.read.schema(schema).parquet(f"{self.root}/{name}"))
        before = m["commits"][-1]["chain"] if m["commits"] else ""
        entry["chain"] = hashlib.sha256((before + json.dumps(entry, sort_keys=True)).encode()).hexdigest()
        self._publish(m | {"cursor": at, "commits": [*m["commits"], entry]})
        return at

    def append(self, rows: DataFrame) -> int:
        """New ids at version 1: valid, of known spaces, not there before, once per space."""
        known = self.manifest()["spaces"]
        bad = rows.where(~F.col("space").isin(known) | F.col("id").isNull() | (F.col("id") == "") | F.col("id").contains("\n") | F.exists("key", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        twice = rows.groupBy("space", "id").count().where("count > 1").select("space", "id")
        again = rows.select("space", "id").join(self.items().select("space", "id").distinct(), ["space", "id"], "left_semi")
        for what, df in (("invalid", bad), ("repeated", twice), ("already there", again)):
            if not df.isEmpty():
                raise ValueError(f"rows {what}")
        return self._commit(filled(rows).withColumn("version", F.lit(1)), None, "append")

    def supersede(self, rows: DataFrame) -> int:
        """The next version of current items: never earlier than the old one, with its sources when none are named."""
        old = self.current().select("space", "id", F.col("version").alias("__v"), F.col("time").alias("__t"), F.col("sources").alias("__s"))
        both = filled(rows).drop("version").join(old, ["space", "id"], "left")
        if not both.where("__v IS NULL").isEmpty():
            raise ValueError("rows that are not current")
        new = both.withColumn("version", F.col("__v") + 1).withColumn("time", F.greatest("time", "__t")).withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.col("__s")))
        return self._commit(new, both.select("space", "id", F.col("__v").alias("version")), "supersede")

    def rewrite(self, outputs: DataFrame, shares: DataFrame) -> int:
        """n current inputs become m outputs: shares (space, input, output, share) of an input sum to one.

        An output's mass is the shares' part of its inputs' masses, its time their latest, its sources their union.
        """
        sums = shares.groupBy("space", "input").agg(F.sum("share").alias("total"))
        old = self.current().select("space", F.col("id").alias("input"), "version", "time", "mass", "sources")
        if not sums.join(old, ["space", "input"], "left_anti").isEmpty() or not sums.where(F.abs(F.col("total") - 1) > TOLERANCE).isEmpty():
            raise ValueError("inputs that are not current, or shares that do not sum to one")
        parts = shares.join(sums, ["space", "input"]).withColumn("share", F.col("share") / F.col("total")).join(old, ["space", "input"])
        made = parts.groupBy("space", F.col("output").alias("id")).agg(
            F.max("time").alias("time"), F.sum(F.col("share") * F.col("mass")).cast("float").alias("mass"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
            F.sort_array(F.collect_list(F.struct(F.concat_ws("@", "input", "version").alias("ref"), "share"))).alias("lineage"),
        )
        rows = filled(outputs).drop("time", "mass", "sources", "lineage", "derived", "version").join(made, ["space", "id"]).withColumn("derived", F.lit(True)).withColumn("version", F.lit(1))
        return self._commit(rows, parts.select("space", F.col("input").alias("id"), "version").distinct(), "rewrite")

    def delete(self, ids: DataFrame, cascade: bool = True) -> int:
        """Items (space, id) go, and with ``cascade`` every current item made from them, however far."""
        alive = graph.checkpointed(self.current().select("space", "id", "version", "lineage"))
        gone = ids.select("space", "id")
        if cascade:
            edges = alive.select("space", "id", F.explode("lineage").alias("l")).select(F.concat_ws("\x1f", "space", F.substring_index("l.ref", "@", 1)).alias("parent"), F.concat_ws("\x1f", "space", "id").alias("child"))
            found = graph.reachable(edges, gone.select(F.concat_ws("\x1f", "space", "id").alias("node")))
            gone = found.select(F.split("node", "\x1f")[0].alias("space"), F.split("node", "\x1f")[1].alias("id"))
        return self._commit(None, alive.join(gone, ["space", "id"], "left_semi").select("space", "id", "version"), "delete")

    def rollback(self, cursor: int) -> None:
        """Later commits are no longer named; their files stay until they are collected."""
        m = self.manifest()
        if not 0 <= cursor <= m["cursor"]:
            raise ValueError(f"cursor {cursor} of {m['cursor']}")
        self._publish(m | {"cursor": cursor, "commits": [c for c in m["commits"] if c["cursor"] <= cursor]})

    def compact(self, root: str) -> tuple[Bank, DataFrame]:
        """A new bank with the current rows, and the history that it leaves out (without vectors)."""
        m = self.manifest()
        other = Bank.create(self.spark, root, m["dataset"], m["spaces"])
        other._commit(self.current(), None, "compact")
        return other, self.items().where("dead > 0").select("space", "id", "version", "born", "dead", "time", "lineage")

    def lineage(self, cursor: int | None = None) -> DataFrame:
        """(item, contributor, weight): what each visible item was made from; others come from their sources equally.

        Weights are share times input mass, or the shares alone where all inputs are massless.
        """
        every, now = self.items(cursor), self.current(cursor)
        mass = every.select(F.col("space"), F.concat_ws("@", "id", "version").alias("ref"), "mass")
        chain = every.where(F.size("lineage") > 0).select("space", F.concat_ws("@", "id", "version").alias("item"), F.explode("lineage").alias("l")).select("space", "item", "l.ref", "l.share")
        weighed = chain.join(mass, ["space", "ref"], "left").withColumn("w", F.col("share") * F.coalesce("mass", F.lit(0.0)))
        total = weighed.groupBy("space", "item").agg(F.sum("w").alias("t"))
        made = weighed.join(total, ["space", "item"]).select("space", "item", F.col("ref").alias("contributor"), F.when(F.col("t") > 0, F.col("w")).otherwise(F.col("share")).alias("weight"))
        own = every.where(F.size("lineage") == 0).select("space", F.concat_ws("@", "id", "version").alias("item"), F.explode("sources").alias("contributor")).withColumn("weight", F.lit(1.0))
        return made.unionByName(own)

    def composition(self, space: str, cursor: int | None = None) -> DataFrame:
        """(item, source, share) of the visible items of a space."""
        edges = self.lineage(cursor).where(F.col("space") == space).drop("space")
        now = self.current(cursor).where(F.col("space") == space).select(F.concat_ws("@", "id", "version").alias("item"))
        return graph.composition(edges).join(now, "item", "left_semi")

    def verify(self) -> list[str]:
        """What does not hold: digests, the chain of commits, and that what died was born."""
        wrong, before = [], ""
        for c in self.manifest()["commits"]:
            for kind, schema in (("rows", ITEM), ("deaths", DEATH)):
                if c.get(kind) and digest(self.spark.read.schema(schema).parquet(f"{self.root}/{c[kind]}")) != c[f"{kind}_digest"]:
                    wrong.append(f"{kind} of commit {c['cursor']}")
            body = {k: v for k, v in c.items() if k != "chain"}
            if hashlib.sha256((before + json.dumps(body, sort_keys=True)).encode()).hexdigest() != c["chain"]:
                wrong.append(f"chain at commit {c['cursor']}")
            before = c["chain"]
        if not self._read("deaths", DEATH, None).join(self._read("rows", ITEM, None), ["space", "id", "version"], "left_anti").isEmpty():
            wrong.append("deaths without births")
        return wrong

    def stats(self) -> DataFrame:
        return self.items().groupBy("space").agg(F.count("*").alias("items"), F.sum(F.when(F.col("dead") == 0, 1).otherwise(0)).alias("current"), F.sum(F.size("values")).alias("positions"))


def filled(rows: DataFrame) -> DataFrame:
    """All columns of an item; those that are left out get their neutral value."""
    empty = {"time": F.lit(0), "mass": F.lit(1.0), "values": F.array(), "sources": F.array(), "lineage": F.array(), "derived": F.lit(False)}
    return rows.withColumns({k: v.cast(ITEM[k].dataType) for k, v in empty.items() if k not in rows.columns})


def digest(df: DataFrame) -> str:
    """Of the rows as a multiset: a sum of row hashes needs no order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"
