"""Lexical retrieval, leaks and duplicates, text scalars over ``documents``, ``benchmark`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import lexical as L
from .registry import query, spread, table

STOPS = ", ".join(f"'{w}'" for w in L.STOP)
TERMS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
BM_TERMS = f"list_filter({TERMS}, lambda w: w NOT IN ({STOPS}) AND length(w) > 1)"
RANKED = "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM x QUALIFY rank <= {k}"


def bm25_sql(terms: str, cap: str, k: int) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, {terms.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY id, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({terms.format('text')}) AS term FROM benchmark),
x AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 9) AS score FROM q JOIN f USING (term) JOIN p USING (term), st {cap} GROUP BY query_id, id) """ + RANKED.format(k=k)


def cosine_sql(idf: str | None, where: str, k: int, text: str = "text") -> str:
    w = "tf * 1.0" if idf is None else f"(1 + ln(tf)) * {idf}"
    return f"""WITH d AS (SELECT doc_id AS id, {TERMS.format(text)} AS w FROM documents {where}), st AS (SELECT count(*) AS n FROM d),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY id, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY query_id, term),
v AS (SELECT id, term, {w} AS w FROM p JOIN f USING (term), st), a AS (SELECT query_id, term, {w} AS w FROM q {'LEFT' if idf is None else ''} JOIN f USING (term), st),
nv AS (SELECT id, sqrt(sum(w * w)) AS l FROM v GROUP BY id), na AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM a GROUP BY query_id),
x AS (SELECT query_id, v.id, round(sum(a.w * v.w) / (any_value(nv.l) * any_value(na.l)), 9) AS score FROM a JOIN v USING (term) JOIN nv ON nv.id = v.id JOIN na USING (query_id) GROUP BY query_id, v.id) """ + RANKED.format(k=k)


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


NAMES = {"id_col": "doc_id", "text_col": "text", "query_id": "item_id", "query_text": "text"}


def shown(df):
    return df.withColumn("score", F.round("score", 6))


@query("L01 L02 J14", bm25_sql(BM_TERMS, "", 10))
def bm25_topk(spark, sf_dir):
    return shown(L.bm25(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10, **NAMES))


@query("L03 J15", bm25_sql(TERMS, "WHERE df <= n // 2 + 1", 10))
def bm25_df_capped(spark, sf_dir):
    return shown(L.bm25(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10, terms=T.terms, df_cap=True, **NAMES))


@query("L04 L05 L07", cosine_sql("ln(1 + n / df)", "", 10, "substr(text, 1, 384)"))
def tfidf_log1p_topk(spark, sf_dir):
    """The source teacher: its weighting reads the first 384 characters, as its definition says."""
    d = docs(spark, sf_dir).withColumn("text", F.substr("text", F.lit(1), F.lit(384)))
    return shown(L.cosine(d, table(spark, sf_dir, "benchmark"), 10, lambda n, df: F.log(1 + n / df), **NAMES))


@query("L08 L09 T12", cosine_sql("(1 + ln((1 + n) / (1.0 + df)))", "WHERE lang = 'en'", 10))
def tfidf_eligible_topk(spark, sf_dir):
    """Rows that are not eligible do not count in any statistic: the filter comes first."""
    d = docs(spark, sf_dir).where("lang = 'en'")
    return shown(L.cosine(d, table(spark, sf_dir, "benchmark"), 10, lambda n, df: 1 + F.log((1 + n) / (1 + df)), **NAMES))


@query("T14", cosine_sql(None, "", 10))
def tf_cosine_topk(spark, sf_dir):
    return shown(L.cosine(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10, None, **NAMES))


@query("T17 L11", f"""WITH b AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY item_id, term),
d AS (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), o AS (SELECT item_id, doc_id, CAST(sum(n) AS BIGINT) AS overlap FROM b JOIN d USING (term) GROUP BY item_id, doc_id),
m AS (SELECT item_id, max(overlap) AS overlap FROM o GROUP BY item_id) SELECT i.item_id, o.doc_id, coalesce(o.overlap, 0) AS overlap FROM (SELECT DISTINCT item_id FROM benchmark) i LEFT JOIN m USING (item_id) LEFT JOIN o ON o.item_id = m.item_id AND o.overlap = m.overlap""")
def best_overlap_ties(spark, sf_dir):
    """All rows that attain the largest weighted overlap; an item that overlaps with none, where all rows tie, has a null row."""
    items = table(spark, sf_dir, "benchmark")
    q = L.asked_terms(items, "item_id", T.terms(F.col("text")))
    have = L.held_terms(docs(spark, sf_dir), q, "doc_id", T.terms(F.col("text")))
    o = q.join(have, "term").groupBy("query_id", "id").agg(F.sum("qtf").alias("overlap"))
    best = o.groupBy("query_id").agg(F.max("overlap").alias("overlap"))
    ties = o.join(best, ["query_id", "overlap"])
    every = items.select(F.col("item_id").alias("query_id")).distinct()
    return every.join(ties, "query_id", "left").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


@query("A23 L16", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_id) AS first_doc FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def term_postings(spark, sf_dir):
    tf = L.counted(docs(spark, sf_dir), "doc_id", T.terms(F.col("text")))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("id").alias("first_doc"))


SH8 = "SELECT DISTINCT {id}, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM (SELECT {id}, " + TERMS.format("text") + " AS w FROM {of}) WHERE len(w) > 0)"


def shingled(df, id_col):
    return df.select(id_col, F.explode(T.shingles(T.terms(F.col("text")), 8)).alias("g"))


@query("L13 L12 L14", f"SELECT doc_id, count(*) AS n FROM ({SH8.format(id='doc_id', of='documents')}) GROUP BY doc_id")
def shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.shingles(T.terms(F.col("text")), 8)).cast("long").alias("n")).where("n > 0")


@query("J11 F19 C09", f"""WITH b AS ({SH8.format(id='item_id', of='benchmark')}), d AS ({SH8.format(id='doc_id', of='documents')}), n AS (SELECT item_id, count(*) AS own FROM b GROUP BY item_id)
SELECT item_id, doc_id, count(*) AS hits, any_value(own) AS own FROM b JOIN d USING (g) JOIN n USING (item_id) GROUP BY item_id, doc_id HAVING count(*) >= 0.5 * any_value(own)""")
def ambiguous_cues(spark, sf_dir):
    """Records that hold at least half of a cue's 8-word runs: an inverted index over the asked runs only."""
    b, d = shingled(table(spark, sf_dir, "benchmark"), "item_id"), shingled(docs(spark, sf_dir), "doc_id")
    own = b.groupBy("item_id").agg(F.count("*").alias("own"))
    hits = b.join(d, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(own, "item_id").where("hits >= 0.5 * own").select("item_id", "doc_id", "hits", "own")


@query("P01 F29 F20", f"""WITH b AS ({SH8.format(id='item_id', of='benchmark')}), d AS ({SH8.format(id='doc_id', of='documents')}), n AS (SELECT doc_id, count(*) AS own FROM d GROUP BY doc_id), h AS (SELECT doc_id, count(DISTINCT d.g) AS hit FROM d JOIN b USING (g) GROUP BY doc_id)
SELECT doc_id, hit, own, round(hit * 1.0 / own, 6) AS share FROM h JOIN n USING (doc_id)""")
def benchmark_contamination(spark, sf_dir):
    """The share of a document's 8-word runs that a test item has.

    Runs are met and counted by a hash of 64 bits of their words' hashes, which builds no text; only those whose hash a
    test item has are then written out and compared, so hardly any row leaves its document.
    """
    of = lambda w: T.bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - 7, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, 8))))
    run = lambda w, i: F.array_join(F.slice(w, i, 8), " ")
    words = lambda df, *more: df.select(*more, T.terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    asked = words(table(spark, sf_dir, "benchmark"), "item_id").select("w", F.posexplode(of(F.col("w"))).alias("at", "h")).select("h", run(F.col("w"), F.col("at") + 1).alias("g")).distinct()
    d = words(docs(spark, sf_dir), "doc_id").select("doc_id", of(F.col("w")).alias("h"))
    d = d.select("doc_id", F.size(F.array_distinct("h")).cast("long").alias("own"), F.posexplode("h").alias("at", "h"))
    met = d.join(asked.select("h").distinct(), "h", "left_semi").groupBy("doc_id", "own").agg(F.collect_set("at").alias("at"))  # within one document
    hits = words(docs(spark, sf_dir).select("doc_id", "text").join(met, "doc_id"), "doc_id", "own", "at").select("doc_id", "own", F.explode(F.array_distinct(F.transform("at", lambda i: run(F.col("w"), i + 1)))).alias("g"))
    counted = hits.join(asked.select("g").distinct(), "g", "left_semi").groupBy("doc_id", "own").agg(F.count("*").alias("hit"))
    return counted.select("doc_id", "hit", "own", F.round(F.col("hit") / F.col("own"), 6).alias("share"))


@query("K14 K01 N07", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query("A24", "SELECT copies, count(*) AS texts FROM (SELECT count(*) AS copies FROM documents GROUP BY text) GROUP BY copies")
def copy_histogram(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256)).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("texts"))


@query("N07 U04", "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY lang, doc_id) AS r FROM documents) WHERE r = 1 GROUP BY lang")
def first_text_wins(spark, sf_dir):
    """Exact texts are kept once over all languages, the first language first."""
    first = docs(spark, sf_dir).groupBy(F.sha2("text", 256)).agg(F.min(F.struct("lang", "doc_id")).alias("k"))
    return first.groupBy("k.lang").agg(F.count("*").alias("n"), F.sum("k.doc_id").alias("ids"))


CLEAN = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({CLEAN}, ' '), lambda w: w <> '')"


@query("C01 C10 C12 C13 C18 C19 C07", f"""SELECT doc_id, sha256({CLEAN.format('text')}) AS digest, array_to_string({WORDS.format('text')}[1:12], ' ') AS head, CAST(len({WORDS.format('text')}) AS INTEGER) AS n_words,
CAST(least(len(list_filter({WORDS.format('text')}[2:], lambda w: regexp_matches(w, '^[A-Z0-9]'))), 4) AS INTEGER) AS specificity, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS BIGINT) AS approx_tokens, CAST(round_even(len({WORDS.format('text')}) * CAST(1.35 AS DOUBLE), 0) AS BIGINT) AS approx_words,
round(CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0) AS DOUBLE) / greatest(length(text), 1), 6) AS digit_share FROM documents""")
def text_scalars(spark, sf_dir):
    """Roundings are half-even, as Python's are."""
    t, n = F.col("text"), F.size(T.split_words(F.col("text")))
    return docs(spark, sf_dir).select(
        "doc_id", F.sha2(T.clean(t), 256).alias("digest"), T.cap_words(t, 12).alias("head"), n.alias("n_words"), T.specificity(t).alias("specificity"),
        F.greatest(F.lit(1), F.bround(F.length(t) / 4.0, 0)).cast("long").alias("approx_tokens"), F.bround(n * 1.35, 0).cast("long").alias("approx_words"), F.round(T.share_of(t, "[0-9]+"), 6).alias("digit_share"),
    )


@query("F11 F12 F13 F14 F16 F17", f"""WITH c AS (SELECT *, {CLEAN.format('text')} AS t FROM documents) SELECT doc_id, length(regexp_replace(t, '\\[[^\\]]*\\]', '', 'g')) >= 150 AS long_enough, contains(lower(t), 'password') AS has_answer, contains(lower(t), 'idiot') OR contains(lower(t), 'scum') AS has_alias,
len(string_split(t, ' ')) >= 8 AND NOT regexp_matches(t, '[$\\\\]') AS clean_cue, lower(t) IN ('yes', 'no') AS yes_no FROM c""")
def text_predicates(spark, sf_dir):
    t = T.clean(F.col("text"))
    return docs(spark, sf_dir).select(
        "doc_id", (F.length(F.regexp_replace(t, "\\[[^\\]]*\\]", "")) >= 150).alias("long_enough"), F.lower(t).contains("password").alias("has_answer"),
        F.exists(F.array(F.lit("idiot"), F.lit("scum")), lambda a: F.contains(F.lower(t), a)).alias("has_alias"), ((F.size(F.split(t, " ")) >= 8) & ~t.rlike("[$\\\\]")).alias("clean_cue"), F.lower(t).isin("yes", "no").alias("yes_no"),
    )


@query("C02 C06 W14", f"""SELECT doc_id, len(list_filter(string_split(regexp_replace({CLEAN.format('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n_sentences FROM documents""")
def sentence_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("S22 S20", f"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM pages""")
def html_stripped(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("digest"))


@query("C44 C45 C46 C47 X09", """WITH w AS (SELECT DISTINCT p_type AS name FROM part) SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS squashed,
array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: x <> ''), '_') AS words,
substr(name, 1, 1) || regexp_replace(substr(name, 2), '[aeiouAEIOU]', '', 'g') AS abbreviated, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier,
CASE WHEN ends_with(lower(name), 'ies') AND length(name) > 3 THEN substr(lower(name), 1, length(name) - 3) || 'y' WHEN ends_with(lower(name), 's') AND NOT ends_with(lower(name), 'ss') THEN substr(lower(name), 1, length(name) - 1) WHEN ends_with(lower(name), 'y') AND NOT regexp_matches(lower(name), '[aeiou]y$') THEN substr(lower(name), 1, length(name) - 1) || 'ies' ELSE lower(name) || 's' END AS toggled FROM w""")
def identifier_words(spark, sf_dir):
    c = F.col("name")
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    return names.select("name", T.squash(c).alias("squashed"), F.array_join(T.name_words(c), "_").alias("words"), T.squeezed(c).alias("abbreviated"), c.rlike("^[A-Za-z_][A-Za-z0-9_]*$").alias("identifier"), T.plural(F.lower(c)).alias("toggled"))


@query("H01 H06 N21", "SELECT doc_id, substr(sha256(lang || chr(0) || text), 1, 32) AS record_id FROM documents")
def record_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", H.record_id(F.col("lang"), F.col("text")).alias("record_id"))


@query("N20 N21 U16", "SELECT doc_id, regexp_replace(text, '\\bthe\\b', 'THE', 'g') <> text AS changed, substr(sha256(doc_id || chr(31) || 'edit1'), 1, 32) AS new_id FROM documents WHERE contains(text, 'the') AND regexp_replace(text, '\\bthe\\b', 'THE', 'g') <> text")
def substituted_records(spark, sf_dir):
    """Records with a needle, replaced by pattern; only changed ones become new versions."""
    changed = F.regexp_replace("text", "\\bthe\\b", "THE") != F.col("text")
    return docs(spark, sf_dir).where(F.contains("text", F.lit("the")) & changed).select("doc_id", changed.alias("changed"), F.substr(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\x1fedit1")), 256), F.lit(1), F.lit(32)).alias("new_id"))


@query("F18", f"""WITH b AS (SELECT item_id, list_distinct({TERMS.format('text')}) AS w FROM benchmark), t AS (SELECT item_id, len(w) AS own, unnest(w) AS term FROM b), d AS (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents)
SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS seen FROM t JOIN d USING (term) GROUP BY item_id, doc_id, own HAVING count(*) * 2 >= own""")
def grounded_titles(spark, sf_dir):
    """Items at least half of whose words a document has, through the inverted index of the items' words."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.terms(F.col("text"))).alias("w")).select("item_id", F.size("w").alias("own"), F.explode("w").alias("term"))
    d = L.held_terms(docs(spark, sf_dir), b, "doc_id", T.terms(F.col("text"))).withColumnRenamed("id", "doc_id")
    return b.join(d, "term").groupBy("item_id", "doc_id", "own").agg(F.count("*").cast("int").alias("seen")).where("seen * 2 >= own").select("item_id", "doc_id", "seen")
