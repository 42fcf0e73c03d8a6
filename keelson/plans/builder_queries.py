"""Corpus builders as plans over the tables at hand: what each chooses, drops, pairs and counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import lexical as L
from ..operators import ordered
from ..sources import readers, sinks
from .registry import query, spread, table
from .text_queries import TERMS


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def sha(*parts):
    return F.sha2(F.concat_ws("|", *parts), 256)


@query("P14", """
SELECT 'schema' AS kind, 'nation' AS tbl, 'nation: n_nationkey, n_name, n_regionkey' AS record UNION ALL SELECT 'schema', 'region', 'region: r_regionkey, r_name'
UNION ALL SELECT 'value', 'nation', 'nation.n_name = ' || n_name FROM (SELECT DISTINCT n_name FROM nation ORDER BY n_name LIMIT 8)
UNION ALL SELECT 'value', 'region', 'region.r_name = ' || r_name FROM (SELECT DISTINCT r_name FROM region ORDER BY r_name LIMIT 8)
UNION ALL SELECT 'row', 'nation', 'nation: ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5)
UNION ALL SELECT 'row', 'region', 'region: ' || r_regionkey || ' | ' || r_name FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 5)
""")
def database_records(spark, sf_dir):
    """Records of a database: a schema line per table, the first distinct names, and sample rows."""
    out = None
    for name, columns, named in (("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_name"), ("region", ["r_regionkey", "r_name"], "r_name")):
        df = table(spark, sf_dir, name).select(*columns)
        one = lambda kind, rows, record, name=name: rows.select(F.lit(kind).alias("kind"), F.lit(name).alias("tbl"), record.alias("record"))
        found = one("schema", spark.range(1), F.lit(f"{name}: {', '.join(columns)}"))
        found = found.unionByName(one("value", df.select(named).distinct().orderBy(named).limit(8), F.concat(F.lit(f"{name}.{named} = "), F.col(named))))
        found = found.unionByName(one("row", df.orderBy(columns[0]).limit(5), F.concat(F.lit(f"{name}: "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]))))
        out = found if out is None else out.unionByName(found)
    return out


@query("P13", """
WITH q AS (SELECT p_partkey, p_size, substr(sha256('variant|' || p_partkey), 1, 1) < '8' AS variant, p_partkey % 5 = 0 AS two FROM part)
SELECT p_partkey, CASE WHEN variant AND two THEN 'quoted_literal_ambiguous' END AS reason, CASE WHEN variant AND NOT two THEN 'SELECT label FROM item JOIN lineitem ON p_partkey = l_partkey WHERE extent = ' || p_size
  WHEN NOT variant THEN 'SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = ' || CASE WHEN two THEN '"p_brand"' ELSE CAST(p_size AS VARCHAR) END END AS statement,
  CASE WHEN variant AND two THEN NULL ELSE 'lineitem,part' END AS required FROM q
""")
def statement_corpus(spark, sf_dir):
    """Questions with their statement, in every other case under other names; what cannot be renamed is rejected by reason.

    Required are the schema records of the tables that the statement names: a join with the catalog.
    """
    from .check_queries import rewritten

    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    sql = F.concat(F.lit("SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = "), F.when(F.col("p_partkey") % 5 == 0, F.lit('"p_brand"')).otherwise(size))
    q = table(spark, sf_dir, "part").select("p_partkey", sql.alias("sql"), (F.substr(sha(F.lit("variant"), key), F.lit(1), F.lit(1)) < "8").alias("variant"))
    new = q.withColumn("new", F.when(F.col("variant"), rewritten("statement")("sql")).otherwise(F.col("sql")))
    bad = F.col("new").isin("quoted_literal_ambiguous", "alias_collision", "alias_roundtrip", "left over")
    judged = new.withColumn("reason", F.when(bad, F.col("new"))).withColumn("statement", F.when(~bad, F.col("new")))
    catalog = spark.createDataFrame([(t,) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")], "tbl string")
    names = judged.select("p_partkey", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"(?:from|join)\s+(\w+)"), F.lit(1)))).alias("tbl")).join(F.broadcast(catalog), "tbl")  # a row per table
    required = names.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_list("tbl")), ",").alias("required"))
    return judged.join(required, "p_partkey").select("p_partkey", "reason", "statement", F.when(~bad, F.col("required")).alias("required"))


@query("P15", "SELECT o_custkey, count(*) AS n_rows, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS answer FROM orders GROUP BY o_custkey HAVING count(*) <= 3 AND length(string_agg(o_orderpriority, ', ')) <= 24")
def short_answers(spark, sf_dir):
    """Questions whose executed answer has few rows and few characters; larger results are folded to a count before they are cut."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    few = by.groupBy("o_custkey").agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("o_orderpriority", "n")).alias("x")).where("n_rows <= 3")  # at most as many as priorities
    answer = F.array_join(F.flatten(F.transform(F.array_sort("x"), lambda x: F.array_repeat(x["o_orderpriority"], x["n"].cast("int")))), ", ")
    return few.select("o_custkey", "n_rows", answer.alias("answer")).where(F.length("answer") <= 24)


CLEANED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query("C03", f"SELECT doc_id, CAST(len(string_split(regexp_replace({CLEANED}, '([.!?]) ([A-Z0-9\"])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS BIGINT) AS n FROM documents WHERE {CLEANED} <> ''")
def capital_sentences(spark, sf_dir):
    """Sentences that end where a capital, a digit or a quote follows."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", X.clean(F.col("text")).alias("t")).where("t <> ''")
    return d.select("doc_id", F.size(F.split("t", '(?<=[.!?]) (?=[A-Z0-9"])')).cast("long").alias("n"))


@query("P10 C15", f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace({CLEANED}, '([.!?]) ([A-Z0-9"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents WHERE {CLEANED} <> ''),
u AS (SELECT doc_id, unnest(p) AS cue, unnest(range(1, len(p) + 1)) AS place, len(p) AS n FROM s), w AS (SELECT *, len(string_split(cue, ' ')) AS words, least(4, len(list_filter(string_split(cue, ' ')[2:], lambda x: regexp_matches(x, '^[A-Z0-9]')))) AS own FROM u),
c AS (SELECT doc_id, place, n, cue FROM w WHERE words BETWEEN 6 AND 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, sha256(doc_id || '|' || place), place) = 1)
SELECT doc_id, CAST(coalesce(c.place, 0) AS INTEGER) AS place, sha256(coalesce(c.cue, array_to_string(string_split(array_to_string(s.p, ' '), ' ')[1:12], ' '))) AS cue, CAST(len(s.p) - CASE WHEN c.place IS NULL THEN 0 ELSE 1 END AS INTEGER) AS rest FROM s LEFT JOIN c USING (doc_id)
""")
def inverse_cloze(spark, sf_dir):
    """A sentence of each document as its cue: of 6 to 40 words, the most specific, then by hash; else its first words.

    The record to find is the text without the cue. A document is decided in its own row.
    """
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", X.clean(F.col("text")).alias("t")).where("t <> ''").withColumn("p", F.split("t", '(?<=[.!?]) (?=[A-Z0-9"])'))
    words = lambda c: F.split(c, " ")
    own = lambda c: F.least(F.lit(4), F.size(F.filter(F.slice(words(c), 2, F.greatest(F.size(words(c)) - 1, F.lit(0))), lambda x: x.rlike("^[A-Z0-9]"))))
    all_ = F.transform("p", lambda c, k: F.struct((-own(c)).alias("own"), sha(F.col("doc_id").cast("string"), (k + 1).cast("string")).alias("h"), (k + 1).alias("place"), c.alias("cue"), F.size(words(c)).alias("words")))
    best = d.withColumn("best", F.array_min(F.filter(all_, lambda x: x["words"].between(6, 40))))
    cue = F.coalesce(F.col("best.cue"), F.array_join(F.slice(words(F.col("t")), 1, 12), " "))
    return best.select("doc_id", F.coalesce("best.place", F.lit(0)).cast("int").alias("place"), F.sha2(cue, 256).alias("cue"), (F.size("p") - F.when(F.col("best").isNull(), 0).otherwise(1)).cast("int").alias("rest"))


@query("P11", """WITH h AS (SELECT doc_id, lang, source, sha256(source || '|' || doc_id) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3)
SELECT source, lang, doc_id, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS INTEGER) AS place FROM h QUALIFY place <= 4""")
def paraphrase_cues(spark, sf_dir):
    """Up to four members of each group by hash order, held-out ones left out; a large group is cut in parts first."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id % 10 <> 3").select("source", "lang", "doc_id", sha(F.col("source"), F.col("doc_id").cast("string")).alias("h"))
    first = ordered.capped(d, ["source", "lang"], [F.col("h"), F.col("doc_id")], 4)
    return ordered.ranked(first, ["source", "lang"], [F.col("h"), F.col("doc_id")], "place").select("source", "lang", "doc_id", "place")


@query("P12", """WITH t AS (SELECT conv_id, turn // 2 AS exchange, role, text FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, exchange, max(text) FILTER (role = 'user') AS a, max(text) FILTER (role = 'assistant') AS b FROM t GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT conv_id, exchange, sha256(CASE WHEN flip THEN b ELSE a END) AS cue, sha256(CASE WHEN flip THEN a ELSE b END) AS target FROM (SELECT *, substr(sha256(conv_id || '|' || exchange), 1, 1) < '8' AS flip FROM p) WHERE a <> b""")
def version_cues(spark, sf_dir):
    """Two versions of the same passage: one, by hash, is the cue, the other the target; equal ones are no cue."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("exchange"), "role", "text")
    p = t.groupBy("conv_id", "exchange").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("b")).where("a <> b")
    flip = F.substr(sha(F.col("conv_id").cast("string"), F.col("exchange").cast("string")), F.lit(1), F.lit(1)) < "8"
    return p.select("conv_id", "exchange", F.sha2(F.when(flip, F.col("b")).otherwise(F.col("a")), 256).alias("cue"), F.sha2(F.when(flip, F.col("a")).otherwise(F.col("b")), 256).alias("target"))


@query("P02", f"""
WITH w AS (SELECT doc_id, source, string_split({CLEANED}, ' ') AS w FROM documents WHERE {CLEANED} <> ''), t AS (SELECT doc_id, source, len(w) AS n, array_to_string(w[1:6], ' ') AS title FROM w),
f AS (SELECT * FROM t WHERE n >= 80 QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1)
SELECT doc_id, CASE WHEN substr(sha256('split|' || doc_id), 1, 1) = '0' THEN 'validation' ELSE 'train' END AS split, CAST(1 + greatest(0, ceil((n - 64) / 48.0)) AS BIGINT) AS windows, CAST(greatest(0, ceil((n - 64) / 48.0)) * 48 AS BIGINT) AS last_start FROM f
""")
def recall_windows(spark, sf_dir):
    """Documents of enough words, one per title, split by hash, and the windows of 64 words at a stride of 48 that cover each."""
    words = F.split(X.clean(F.col("text")), " ")
    t = spread(table(spark, sf_dir, "documents")).where(X.clean(F.col("text")) != "").select("doc_id", F.size(words).alias("n"), F.array_join(F.slice(words, 1, 6), " ").alias("title")).where("n >= 80")
    one = t.groupBy("title").agg(F.min(F.struct("doc_id", "n")).alias("k")).select("k.doc_id", "k.n")
    more = F.greatest(F.lit(0), F.ceil((F.col("n") - 64) / 48.0))
    split = F.when(F.substr(sha(F.lit("split"), F.col("doc_id").cast("string")), F.lit(1), F.lit(1)) == "0", "validation").otherwise("train")
    return one.select("doc_id", split.alias("split"), (1 + more).cast("long").alias("windows"), (more * 48).cast("long").alias("last_start"))


@query("P05 J30", """
WITH c AS (SELECT l_suppkey AS book, year(l_shipdate) AS chapter, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
k AS (SELECT book, count(*) AS chapters, count(*) FILTER (a = b) AS equal FROM c GROUP BY book HAVING count(*) FILTER (a = b) * 5 >= count(*))
SELECT c.book, c.chapter, c.a AS verses, k.chapters, CASE WHEN substr(sha256(c.book || '|' || c.chapter), 1, 1) < '4' THEN 'validation' ELSE 'train' END AS split FROM c JOIN k USING (book) WHERE c.a = c.b AND c.a > 0
""")
def aligned_chapters(spark, sf_dir):
    """Chapters with as many verses in both versions, of books with enough of them; one pass counts both versions."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.year("l_shipdate").cast("long").alias("chapter"), "l_returnflag")
    c = li.groupBy("book", "chapter").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    k = c.groupBy("book").agg(F.count("*").alias("chapters"), F.count_if(F.col("a") == F.col("b")).alias("equal")).where("equal * 5 >= chapters")
    split = F.when(F.substr(sha(F.col("book").cast("string"), F.col("chapter").cast("string")), F.lit(1), F.lit(1)) < "4", "validation").otherwise("train")
    return c.where("a = b AND a > 0").join(k.drop("equal"), "book").select("book", "chapter", F.col("a").alias("verses"), "chapters", split.alias("split"))


@query("P29", """
WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS s FROM lineitem), c AS (SELECT q, max(s) AS removed, count(*) AS n FROM p WHERE substr(sha256('contrast|' || q), 1, 2) < '08' GROUP BY q),
b AS (SELECT DISTINCT removed AS s FROM c), r AS (SELECT q, count(*) AS supports, count(b.s) AS forbidden FROM p LEFT JOIN b USING (s) WHERE q NOT IN (SELECT q FROM c) GROUP BY q)
SELECT q, 'contrast' AS kind, n - 1 AS supports FROM c WHERE n > 1 UNION ALL SELECT q, 'kept', supports FROM r WHERE forbidden = 0
""")
def contrast_sets(spark, sf_dir):
    """Contrast questions lose one support, which then no other question may use: their sets are anti joins on what was removed."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s")).distinct()
    contrast = F.substr(sha(F.lit("contrast"), F.col("q").cast("string")), F.lit(1), F.lit(2)) < "08"
    c = p.where(contrast).groupBy("q").agg(F.max("s").alias("removed"), F.count("*").alias("n"))
    rest = p.where(~contrast)
    touched = rest.join(c.select(F.col("removed").alias("s")).distinct(), "s", "left_semi").select("q").distinct()
    kept = rest.groupBy("q").agg(F.count("*").alias("supports")).join(touched, "q", "left_anti")
    return c.where("n > 1").select("q", F.lit("contrast").alias("kind"), (F.col("n") - 1).alias("supports")).unionByName(kept.select("q", F.lit("kept").alias("kind"), "supports"))


@query("P22", """
WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS s FROM lineitem), f AS (SELECT s, min(q) AS q FROM p GROUP BY s), n AS (SELECT p.q, count(*) AS passages, count(f.q) AS fresh FROM p LEFT JOIN f ON f.s = p.s AND f.q = p.q GROUP BY p.q),
r AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY q) AS BIGINT) AS upto FROM n) SELECT q, passages, fresh, passages - fresh AS shared, upto FROM r WHERE upto <= 1500
""")
def haystacks(spark, sf_dir):
    """Questions in order until their haystacks together have so many sources; a passage is new where it is first seen."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s")).distinct()
    first = p.groupBy("s").agg(F.min("q").alias("q")).groupBy("q").agg(F.count("*").alias("fresh"))
    n = p.groupBy("q").agg(F.count("*").alias("passages")).join(first, "q", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    r = ordered.running(n.withColumn("all", F.lit(0)), ["all"], "q", F.col("fresh"), "sum", 4096, "before").withColumn("upto", F.coalesce("before", F.lit(0)) + F.col("fresh"))
    return r.where("upto <= 1500").select("q", "passages", "fresh", (F.col("passages") - F.col("fresh")).alias("shared"), "upto")


@query("P24", f"""
WITH b AS (SELECT item_id, list_distinct({TERMS.format('text')}) AS w FROM benchmark), t AS (SELECT item_id, len(w) AS own, unnest(w) AS term FROM b), d AS (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents),
o AS (SELECT item_id, doc_id, own, count(*) AS seen FROM t JOIN d USING (term) GROUP BY item_id, doc_id, own HAVING count(*) * 5 >= own * 3), g AS (SELECT item_id, count(*) AS places, min(doc_id) AS first_doc FROM o GROUP BY item_id)
SELECT item_id % 40 AS question, count(*) AS facts, count(g.item_id) AS located, count(g.item_id) = count(*) AS kept, min(first_doc) AS first_doc FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN g USING (item_id) GROUP BY question
""")
def located_facts(spark, sf_dir):
    """Facts of a question are located where a document has 60 % of their words; a question with a lost fact is rejected."""
    items = table(spark, sf_dir, "benchmark")
    b = items.select("item_id", F.array_distinct(X.terms(F.col("text"))).alias("w")).select("item_id", F.size("w").alias("own"), F.explode("w").alias("term"))
    d = L.held_terms(spread(table(spark, sf_dir, "documents")), b, "doc_id", X.terms(F.col("text")))
    o = b.join(d, "term").groupBy("item_id", "id", "own").agg(F.count("*").alias("seen")).where("seen * 5 >= own * 3")
    g = o.groupBy("item_id").agg(F.min("id").alias("first_doc"))
    full = items.select("item_id").distinct().join(g, "item_id", "left").withColumn("question", F.col("item_id") % 40)
    return full.groupBy("question").agg(F.count("*").alias("facts"), F.count("first_doc").alias("located"), (F.count("first_doc") == F.count("*")).alias("kept"), F.min("first_doc").alias("first_doc"))


@query("P41", "SELECT doc_id, list_transform(range(1, 9), lambda k: 'n' || substr(sha256('novel|' || doc_id || '|' || k), 1, 6)) AS words FROM documents")
def novel_words(spark, sf_dir):
    """Words that no text has, by hash of the document and the place: the same everywhere, without a generator's state."""
    word = lambda k: F.concat(F.lit("n"), F.substr(sha(F.lit("novel"), F.col("doc_id").cast("string"), k.cast("string")), F.lit(1), F.lit(6)))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(1), F.lit(8)), word).alias("words"))


@query("P45", """
WITH t AS (SELECT p_partkey // 2 AS pair, p_brand AS family, p_partkey FROM part), w AS (SELECT pair, min(family) AS family, max(family) AS other FROM t GROUP BY pair HAVING count(*) = 2), r AS (SELECT pair, family, row_number() OVER (PARTITION BY family ORDER BY pair) AS turn FROM w WHERE family <> other)
SELECT pair, family, CAST(place AS INTEGER) AS place FROM (SELECT pair, family, row_number() OVER (ORDER BY turn, family) AS place FROM r) WHERE place <= 100
""")
def twin_rounds(spark, sf_dir):
    """Whole pairs only, families in turn until the budget; each family sends no more than the budget to the last order."""
    w = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("pair"), F.col("p_brand").alias("family")).groupBy("pair").agg(F.count("*").alias("n"), F.min("family").alias("family"), F.max("family").alias("other")).where("n = 2 AND family <> other")
    r = ordered.ranked(ordered.capped(w, ["family"], [F.col("pair")], 100), ["family"], [F.col("pair")], "turn")
    return r.withColumn("place", F.row_number().over(Window.orderBy("turn", "family"))).where("place <= 100").select("pair", "family", "place")


SEGMENT = "'x' || substr(sha256(c_nationkey || '|' || c_mktsegment), 1, 8)"


@query("Y19 N25 N26", f"""
WITH e AS (SELECT c_nationkey, c_custkey, c_mktsegment AS old, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN {SEGMENT} ELSE c_mktsegment END AS new FROM customer)
SELECT c_nationkey, old, new, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS first_key, old <> new AS edited FROM e GROUP BY ALL
""")
def renamed_values(spark, sf_dir):
    """A cell value renamed in all rows of its scope: groups and joins keep their sizes, other scopes get other names."""
    new = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("x"), F.substr(sha(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")), F.lit(1), F.lit(8)))).otherwise(F.col("c_mktsegment"))
    e = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("old"), new.alias("new"))
    return e.groupBy("c_nationkey", "old", "new").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key")).withColumn("edited", F.col("old") != F.col("new"))


@query("N23 N24", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'absent' ELSE 'no_argument' END AS outcome,
  CASE o_orderkey % 3 WHEN 0 THEN 'Use x_ship with x_to. {"name":"x_ship","arguments":{"x_to":"' || o_orderpriority || '","ship":1}}' WHEN 1 THEN 'Use close. {"name":"close","arguments":{"to":"ship"}}' ELSE 'Use ship. {"name":"ship","arguments":{}}' END AS text FROM orders
""")
def renamed_calls(spark, sf_dir):
    """A tool and its first argument renamed in the call and in its description; what cannot be edited says why.

    Only the words of those names change: a value or another key that is spelled alike stays.
    """
    kind = F.col("o_orderkey") % 3
    name = F.when(kind == 1, "close").otherwise("ship")
    arguments = F.when(kind == 0, F.concat(F.lit('{"to":"'), F.col("o_orderpriority"), F.lit('","ship":1}'))).when(kind == 1, F.lit('{"to":"ship"}')).otherwise(F.lit("{}"))
    about = F.when(kind == 0, F.lit("Use ship with to.")).when(kind == 1, F.lit("Use close.")).otherwise(F.lit("Use ship."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), arguments.alias("arguments"), about.alias("about"))
    first = F.regexp_extract("arguments", r'^\{"(\w+)":', 1)
    outcome = F.when(F.col("name") != "ship", "absent").when(first == "", "no_argument").otherwise("renamed")
    word = lambda text, old, new: F.regexp_replace(text, F.concat(F.lit("\\b"), old, F.lit("\\b")), new)
    done = outcome == "renamed"
    told = F.when(done, word(word(F.col("about"), F.col("name"), F.concat(F.lit("x_"), F.col("name"))), first, F.concat(F.lit("x_"), first))).otherwise(F.col("about"))
    called = F.concat(F.lit('{"name":"'), F.when(done, F.concat(F.lit("x_"), F.col("name"))).otherwise(F.col("name")), F.lit('","arguments":'), F.when(done, F.regexp_replace("arguments", r'^\{"', '{"x_')).otherwise(F.col("arguments")), F.lit("}"))
    return rows.select("o_orderkey", outcome.alias("outcome"), F.concat(told, F.lit(" "), called).alias("text"))


@query("C17", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '1 ' WHEN 1 THEN '2 ' WHEN 2 THEN '3 ' ELSE '' END || n_name AS title FROM nation")
def numbered_titles(spark, sf_dir):
    """A Roman numeral before a title as a figure."""
    roman = F.when(F.col("n_nationkey") % 4 == 0, "I ").when(F.col("n_nationkey") % 4 == 1, "II ").when(F.col("n_nationkey") % 4 == 2, "III ").otherwise("")
    figures = F.create_map(*[F.lit(x) for pair in (("I", "1"), ("II", "2"), ("III", "3"), ("IV", "4"), ("V", "5")) for x in pair])
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(roman, F.col("n_name")).alias("t"))
    head = F.regexp_extract("t", "^([IV]+) ", 1)
    return n.select("n_nationkey", F.when(figures[head].isNotNull(), F.concat(figures[head], F.substr("t", F.length(head) + 1))).otherwise(F.col("t")).alias("title"))


@query("C37", "SELECT c_custkey, 'market ' || c_nationkey AS place, ['lamp ' || (c_custkey % 5), 'box', 'key'] AS items FROM customer")
def sightings(spark, sf_dir):
    """Places and what is seen there, from sentences."""
    said = F.concat(F.lit("You arrive. On the market "), F.col("c_nationkey").cast("string"), F.lit(", you see a lamp "), (F.col("c_custkey") % 5).cast("string"), F.lit(", a box, and a key. Then you leave."))
    parts = lambda k: F.get(F.regexp_extract_all(said, F.lit(r"On the ([^,.]+), you see ([^.]+)\."), F.lit(k)), 0)
    items = F.transform(F.split(parts(2), r",\s*(?:and )?"), lambda x: F.regexp_replace(x, "^an? ", ""))
    return table(spark, sf_dir, "customer").select("c_custkey", parts(1).alias("place"), items.alias("items"))


@query("C27", """WITH d AS (SELECT doc_id, length(text) AS n, coalesce(nullif(instr(text, chr(10)), 0), 0) AS head FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, head, unnest(range(0, (n - head + 399) // 400)) AS k, n FROM d)
SELECT doc_id, CAST(k AS BIGINT) AS chunk FROM c WHERE k * 400 < 700 - head AND least(n - head, (k + 1) * 400) > 500 - head""")
def gold_chunks(spark, sf_dir):
    """Chunks of the text after its first line that overlap a span of the whole text: the span is shifted, not the chunks."""
    d = spread(table(spark, sf_dir, "documents")).where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), F.instr("text", "\n").alias("head"))
    chunks = F.sequence(F.lit(0), F.floor((F.col("n") - F.col("head") - 1) / 400).cast("int"))
    c = d.where("n > head").select("*", F.explode(chunks).alias("k"))
    return c.where((F.col("k") * 400 < 700 - F.col("head")) & (F.least(F.col("n") - F.col("head"), (F.col("k") + 1) * 400) > 500 - F.col("head"))).select("doc_id", F.col("k").cast("long").alias("chunk"))


@query("C51", """WITH q AS (SELECT p_partkey, p_name AS title, 'In ' || p_name || ', what is ' || p_size || ' of ' || p_brand || '?' AS question, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS answer FROM part)
SELECT p_partkey, CASE WHEN contains(lower(substr(question, length('In ' || title || ', ') + 1)), lower(answer)) THEN 'leak' ELSE 'located' END AS outcome FROM q""")
def located_questions(spark, sf_dir):
    """Questions that begin with their title; those whose rest has the answer are leaks."""
    q = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat(F.lit("In "), "p_name", F.lit(", what is "), F.col("p_size").cast("string"), F.lit(" of "), "p_brand", F.lit("?")).alias("question"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("answer"))
    prefix = F.concat(F.lit("In "), "title", F.lit(", "))
    rest = F.lower(F.substr("question", F.length(prefix) + 1))
    return q.select("p_partkey", F.when(~F.startswith("question", prefix), "not_located").when(F.contains(rest, F.lower("answer")), "leak").otherwise("located").alias("outcome"))


@query("T16", """WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_extendedprice) * pow(0.5, max(l_orderkey) % 7) AS norm FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_orderkey, l_linenumber, norm FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY norm DESC, l_orderkey, l_linenumber) > 6""")
def evicted(spark, sf_dir):
    """What falls out when each space keeps its six largest decayed norms: an anti join with what stays, which is found by salt."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg((F.max("l_extendedprice") * F.pow(F.lit(0.5), F.max("l_orderkey") % 7)).alias("norm"))
    stays = ordered.capped(g, ["l_suppkey"], [-F.col("norm"), F.col("l_orderkey"), F.col("l_linenumber")], 6)
    return g.join(stays.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_orderkey", "l_linenumber"], "left_anti")


@query("W24", """WITH r AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS s FROM lineitem), o AS (SELECT q, list(s ORDER BY sha256(q || '|' || s), s) AS found, min(s) AS gold FROM r GROUP BY q)
SELECT q, CASE WHEN list_contains(found[1:3], gold) THEN found[1:3] ELSE list_append(found[1:2], gold) END AS selection FROM o""")
def forced_selection(spark, sf_dir):
    """The first three by order, with the required one forced into the last place where it is not among them."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s")).distinct()
    first = ordered.capped(r.withColumn("h", sha(F.col("q").cast("string"), F.col("s").cast("string"))), ["q"], [F.col("h"), F.col("s")], 3)
    top = first.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "s"))), lambda x: x["s"]).alias("found"))  # three at most
    o = top.join(r.groupBy("q").agg(F.min("s").alias("gold")), "q")
    forced = F.concat(F.slice("found", 1, 2), F.array("gold"))
    return o.select("q", F.when(F.array_contains("found", F.col("gold")), F.col("found")).otherwise(forced).alias("selection"))


@query("K15", "SELECT l_suppkey AS q, l_partkey AS s, bool_or(l_returnflag = 'A') AS positive, count(*) AS n FROM lineitem GROUP BY ALL")
def positives_win(spark, sf_dir):
    """One row per pair of query and source: positive if any source of pairs says so."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey", F.lit(True).alias("p")).unionByName(li.where("l_returnflag <> 'A'").select("l_suppkey", "l_partkey", F.lit(False).alias("p")))
    return pairs.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("s")).agg(F.bool_or("p").alias("positive"), F.count("*").alias("n"))


@query("J35", """
WITH p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
f AS (SELECT * FROM p WHERE trim(answer) <> '' AND len(string_split(trim(answer), ' ')) <= 60 AND NOT contains(lower(question), lower(trim(answer)))), s AS (SELECT f.* FROM f JOIN documents d ON d.doc_id = f.conv_id)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id % 5 ORDER BY sha256(conv_id || '|' || turn), conv_id, turn) AS INTEGER) AS place FROM s QUALIFY place <= 20
""")
def answer_questions(spark, sf_dir):
    """Questions with a short answer that they do not give away, whose support is published; the first twenty of each corpus."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.trim("text").alias("answer"))
    p = a.join(b, ["conv_id", "turn"]).where((F.col("answer") != "") & (F.size(F.split("answer", " ")) <= 60) & ~F.contains(F.lower("question"), F.lower("answer")))
    s = p.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id")), "conv_id").select("conv_id", "turn", (F.col("conv_id") % 5).alias("corpus"), sha(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("h"))
    order = [F.col("h"), F.col("conv_id"), F.col("turn")]
    return ordered.ranked(ordered.capped(s, ["corpus"], order, 20), ["corpus"], order, "place").select("conv_id", "turn", "place")


@query("S11", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT item_id * 7 FROM benchmark)")
def prefiltered_lines(spark, sf_dir):
    """Needed rows of long JSON lines: the id is read from the first bytes by pattern, only lines that are needed are parsed."""
    lines = spread(table(spark, sf_dir, "documents")).select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("line"))
    needs = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id")).distinct()
    found = lines.withColumn("id", F.regexp_extract(F.substring("line", 1, 400), r'^\{"id":(\d+)', 1).cast("long")).join(needs, "id", "left_semi")
    return found.select(F.from_json("line", "id long, text string").alias("x")).select(F.col("x.id").alias("doc_id"), F.length("x.text").cast("long").alias("n"))


def supports(spark, sf_dir):
    """Episodes over orders: lines are supports, every third has a fault."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at"))
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"), F.lit("line").alias("text"), F.unix_timestamp("at").alias("created_at")))).alias("supports"))  # the lines of an order
    kind = F.col("o_orderkey") % 5
    o = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    latest = F.array_max(F.transform("supports", lambda x: x["created_at"]))
    return o.select(
        "o_orderkey", F.when(kind == 1, F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("episode_id"), F.when(kind == 2, latest).otherwise(latest + 1).alias("query_time"), "supports",
        F.when(kind == 3, F.array(F.lit("none"))).otherwise(F.array(F.col("supports")[0]["record_id"])).alias("required_ids"), F.array(F.lit("a"), F.lit("b")).alias("choices"), F.when(kind == 4, "c").otherwise("a").alias("answer"),
    )


@query("S01 S02", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN (SELECT CASE WHEN count(DISTINCT l_orderkey) > 1 THEN 'repeated_id' ELSE 'no_id' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 5 = 1) WHEN 2 THEN 'support_not_before_query' WHEN 3 THEN 'required_missing' WHEN 4 THEN 'answer_not_in_choices' END AS reason FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def episode_faults(spark, sf_dir):
    """Episodes by the first rule that they break; null: valid."""
    good, bad = readers.episodes(supports(spark, sf_dir))
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))


@query("K06 K07 K08", "SELECT l_orderkey || '-' || l_linenumber AS record_id, count(*) AS seen FROM lineitem GROUP BY ALL")
def unique_rows(spark, sf_dir):
    """One row per record id from all the places that name it, whose text and time agree."""
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"), F.lit("line").alias("text"), F.lit(0).alias("created_at"))
    return sinks.unique_records(li).join(li.groupBy("record_id").agg(F.count("*").alias("seen")), "record_id").select("record_id", "seen")


@query("S16", "SELECT conv_id, turn, CAST(1 AS BIGINT) AS story, CAST(turn + 1 AS INTEGER) AS line, role = 'assistant' AS asks FROM conversations")
def story_lines(spark, sf_dir):
    """Numbered lines read back as stories: a question has an answer after a tab."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    value = F.concat((F.col("turn") + 1).cast("string"), F.lit(" "), F.when(F.col("role") == "assistant", F.lit("Where?\tthere\t1")).otherwise(F.lit("Mary went there.")))
    told = readers.numbered_stories(c.select(F.col("conv_id").alias("file"), "n", value.alias("value")))
    return told.select(F.col("file").alias("conv_id"), (F.col("line") - 1).cast("long").alias("turn"), "story", "line", F.col("question").isNotNull().alias("asks"))


def scalar(kind, f):
    """A plain function of a row's values over Arrow batches."""

    @F.pandas_udf(kind)
    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return work


@query("F15 L15", """SELECT p_partkey, p_partkey % 3 <> 2 AS agree, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2.0 * len(string_split(p_name, ' ')) / (2 * len(string_split(p_name, ' ')) + 1), 6) ELSE 0.0 END AS ratio FROM part""")
def title_agreement(spark, sf_dir):
    """Titles that are equal but for case and marks, contained, or unlike; and how much two texts share as words."""
    from ..functions import payloads

    kind = F.col("p_partkey") % 3
    folded = F.when(kind == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(kind == 1, F.concat(F.col("p_name"), F.lit(" again"))).otherwise(F.lit("0 1 2 3 4 5"))
    other = F.when(kind == 0, F.col("p_name")).otherwise(folded)
    return table(spark, sf_dir, "part").select("p_partkey", scalar(T.BooleanType(), payloads.titles_agree)(F.col("p_name"), folded).alias("agree"), F.round(scalar(T.DoubleType(), payloads.similarity)(F.col("p_name"), other), 6).alias("ratio"))


@query("C29 C32", "SELECT o_orderkey, 'find ' || o_orderpriority AS need, ['ls -l ' || o_orderkey, 'SELECT ' || o_custkey] AS commands FROM orders")
def needs_and_commands(spark, sf_dir):
    """What a request asks for on the line of its last mark, and the commands of its blocks."""
    from ..functions import messages

    need = F.concat(F.lit("Task: old\nTask: find "), F.col("o_orderpriority"), F.lit("\nmore"))
    blocks = F.concat(F.lit("```bash\n# list\n$ ls \\\n  -l "), F.col("o_orderkey").cast("string"), F.lit("\n```\nand\n```sql\nSELECT "), F.col("o_custkey").cast("string"), F.lit("; SELECT "), F.col("o_custkey").cast("string"), F.lit("\n```"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar(T.StringType(), messages.need)(need, F.lit("Task:")).alias("need"), scalar(T.ArrayType(T.StringType()), lambda t, _: messages.commands(t))(blocks, F.lit("")).alias("commands"))


@query("V17", "SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2, 5) AS second, round(CAST(embedding[2] AS DOUBLE), 5) AS last FROM embeddings")
def resampled(spark, sf_dir):
    """Two positions resampled to three: the middle one is their mean."""
    from ..functions import payloads

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def work(v: pd.Series) -> pd.Series:
        return v.map(lambda x: payloads.resample([[float(x[0])], [float(x[1])]], 3).ravel().tolist())

    found = table(spark, sf_dir, "embeddings").select("vec_id", work("embedding").alias("x"))
    return found.select("vec_id", F.round(F.col("x")[1], 5).alias("second"), F.round(F.col("x")[2], 5).alias("last"))


@query("X10 X11", "SELECT p_brand, CASE WHEN lower(p_brand) < 'brand#3' THEN 'low' ELSE 'high' END AS half, true AS fresh, true AS again FROM (SELECT DISTINCT p_brand FROM part)")
def fresh_handles(spark, sf_dir):
    """Fresh names for a set of names: none of the old ones, none twice, the same for the same seed."""
    from ..functions import sqltext

    names = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect()]  # the names of one schema
    new, same = sqltext.fresh_names(names, 5), sqltext.fresh_names(sorted(names), 5)
    rows = [(n, "low" if n.lower() < "brand#3" else "high", new[n.lower()] not in {x.lower() for x in names} and len(set(new.values())) == len(new), new == same) for n in names]
    return spark.createDataFrame(rows, "p_brand string, half string, fresh boolean, again boolean")


@query("Q02 Q04 Q05 Y21", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'unknown_role' WHEN 4 THEN 'unknown_block' WHEN 5 THEN 'no_answer' END AS reason, CASE WHEN o_orderkey % 6 < 3 THEN ['user', 'assistant'] ELSE [] END AS roles,
  CASE o_orderkey % 6 WHEN 0 THEN 'done ' || o_orderpriority WHEN 1 THEN 'done ' || o_orderpriority WHEN 2 THEN '<tool_call>{"arguments": {"a": ' || o_orderkey || ', "b": 1}, "name": "f"}</tool_call>' END AS said,
  CASE WHEN o_orderkey % 6 = 2 THEN ['call_without_result'] ELSE [] END AS faults FROM orders
""")
def read_trajectories(spark, sf_dir):
    """Trajectories of three layouts as one schema, the reason for what does not fit, and what an audit finds in the rest."""
    from ..functions import messages

    kind, key, said = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string"), F.concat(F.lit("done "), F.col("o_orderpriority"))
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "'), said, F.lit('"}]}')))
        .when(kind == 1, F.concat(F.lit('{"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "'), said, F.lit('"}]}')))
        .when(kind == 2, F.concat(F.lit('{"query": "q", "answers": [{"name": "f", "arguments": {"b": 1, "a": '), key, F.lit("}}]}")))
        .when(kind == 3, F.lit('{"messages": [{"role": "alien", "content": "x"}]}'))
        .when(kind == 4, F.lit('{"messages": [{"role": "user", "content": [{"type": "image"}]}]}'))
        .otherwise(F.lit('{"messages": [{"role": "user", "content": "q"}]}'))
    )
    found = messages.normalized(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw")
    audit = scalar(T.ArrayType(T.StringType()), lambda roles, texts: messages.faults(list(zip(roles, texts, strict=True)), list(range(len(roles)))))
    part = lambda name: F.transform("messages", lambda m: m[name])
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "reason", part("role").alias("roles"), F.get(part("content"), F.lit(1)).alias("said"), audit(part("role"), part("content")).alias("faults"))


@query("J34", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS step FROM customer")
def placed_records(spark, sf_dir):
    """The first step that names a record, by whole words; null where none does."""
    from ..functions import messages

    kind, name = F.col("c_custkey") % 3, F.concat(F.lit("key"), F.col("c_custkey").cast("string"))
    steps = F.array(F.concat(name, F.lit("s are many")), F.when(kind == 0, F.concat(F.lit("look at "), name)).otherwise(F.lit("go on")), F.when(kind == 1, F.concat(F.lit("use "), name, F.lit("."))).otherwise(F.lit("stop")))
    first = scalar(T.IntegerType(), lambda record, said: messages.earliest(list(record), list(said)))
    return table(spark, sf_dir, "customer").select("c_custkey", first(F.array(name), steps).alias("step"))


@query("W05", """SELECT s_suppkey, [s_suppkey || '-c', s_suppkey || '-a', s_suppkey || '-b'] AS hops FROM supplier""")
def hops(spark, sf_dir):
    """Rows in the order in which their titles are grounded in what was seen before."""
    from ..operators import greedy

    key = F.col("s_suppkey").cast("string")
    rows = F.array(*[F.struct(F.concat(key, F.lit(f"-{name}")).alias("k"), F.array(*map(F.lit, words)).alias("w")) for name, words in (("a", ["river", "old"]), ("b", ["bridge", "river"]), ("c", ["town", "river"]))])

    def order(row, seen):
        return greedy.grounded_order([(r["k"], set(r["w"])) for r in row], set(seen))

    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar(T.ArrayType(T.StringType()), order)(rows, F.array(F.lit("town"))).alias("hops"))


@query("A44", """WITH s AS (SELECT vec_id, [exp(CAST(embedding[1] AS DOUBLE)), exp(CAST(embedding[2] AS DOUBLE)), exp(CAST(embedding[3] AS DOUBLE))] AS e FROM embeddings)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS one, round(e[1] / list_sum(e) * e[2] / (e[2] + e[3]) + e[2] / list_sum(e) * e[1] / (e[1] + e[3]), 6) AS both FROM s""")
def plan_chances(spark, sf_dir):
    """The chance that a draw without replacement takes one item first, or two items first in either order."""
    from ..functions import payloads

    chance = lambda group: scalar(T.DoubleType(), lambda v, _: payloads.plan_probability([float(x) for x in v], [group]))(F.slice("embedding", 1, 3), F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(chance([0]), 6).alias("one"), F.round(chance([0, 1]), 6).alias("both"))


@query("V16", "SELECT vec_id, round((1.0 * CAST(embedding[1] AS DOUBLE) + 3.0 * CAST(embedding[2] AS DOUBLE)) / 4.0, 6) AS first, 2 AS rows FROM embeddings")
def mean_payloads(spark, sf_dir):
    """The weighted mean of two payloads, each of two positions."""
    from ..functions import payloads

    mean = scalar(T.ArrayType(T.DoubleType()), lambda v, _: payloads.mean_payload([[[float(v[0])], [float(v[2])]], [[float(v[1])], [float(v[3])]]], [1, 3]).ravel().tolist())
    found = table(spark, sf_dir, "embeddings").select("vec_id", mean(F.slice("embedding", 1, 4), F.lit(0)).alias("m"))
    return found.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.size("m").alias("rows"))


@query("C08 C23", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'One two ' || p_brand || '. Four ' || p_size || '.' ELSE p_name || ' b c' END AS target, 'Café ' || p_name AS title FROM part""")
def prefix_targets(spark, sf_dir):
    """Whole sentences within a range of words, else whole words; and a title in its composed form."""
    import unicodedata

    from ..functions import chunks, payloads

    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("One two "), F.col("p_brand"), F.lit(". Four "), F.col("p_size").cast("string"), F.lit(". Six seven."))).otherwise(F.concat(F.col("p_name"), F.lit(" b c d e f")))
    words = F.size(F.split("p_name", " "))
    cut = scalar(T.StringType(), lambda t, n: payloads.prefix_target(t, 4 if n == 5 else 2, int(n), chunks.count_words))
    limit = F.when(F.col("p_partkey") % 2 == 0, 5).otherwise(words + 2)
    raw = F.concat(F.lit(unicodedata.normalize("NFD", " Café  ")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", cut(text, limit).alias("target"), scalar(T.StringType(), lambda t, _: payloads.title(t))(raw, F.lit("")).alias("title"))


@query("A46", """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE) * 8) AS a, list_transform(embedding[2:4], lambda x: CAST(x AS DOUBLE) * 8) AS b FROM embeddings),
l AS (SELECT vec_id, a, b, ln(list_sum(list_transform(a, lambda x: exp(x)))) AS la, ln(list_sum(list_transform(b, lambda x: exp(x)))) AS lb FROM e)
SELECT vec_id, round(exp(a[1] - la) * (a[1] - la - b[1] + lb) + exp(a[2] - la) * (a[2] - la - b[2] + lb) + exp(a[3] - la) * (a[3] - la - b[3] + lb), 5) AS kl, CAST(0.6 AS DOUBLE) AS saved FROM l""")
def compaction_checks(spark, sf_dir):
    """KL of choices before and after a compaction, and the bytes that it saves."""
    from ..functions import payloads

    quality = lambda name: scalar(T.DoubleType(), lambda v, _: float(payloads.compaction_quality([[8 * float(x) for x in v[:3]]], [[8 * float(x) for x in v[1:4]]], 100, 40)[name]))(F.slice("embedding", 1, 4), F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(quality("kl"), 5).alias("kl"), quality("saved").alias("saved"))
