"""Order-dependent operators over whole tables; what SQL cannot say is held against brute force in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks, html
from ..operators import greedy
from .registry import query, spread, table


def by_sentence(text: str):
    return [(at, at + len(t), "sentence") for t, at in _placed(chunks.packed(chunks.sentences(text), 800), chunks.tidy(text))]


def _placed(parts, text):
    """Each part with its place: parts follow one another in the text, with a space between them or none."""
    at = 0
    for t, _ in parts:
        at = text.index(t, at)
        yield t, at
        at += len(t)


@query("W07 W10 W11 C26 C53")
def sentence_chunks(spark, sf_dir):
    """Whole sentences packed into passages of at most 800 characters of the tidied text."""
    tidied = spread(table(spark, sf_dir, "documents")).withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " ")))
    return chunks.chunked(tidied, by_sentence).select("doc_id", "ordinal", "start", "end")


@query("W12 E14 C21")
def token_windows(spark, sf_dir):
    """Paragraphs, or windows of 64 words that share 16."""
    return chunks.chunked(spread(table(spark, sf_dir, "documents")), lambda t: chunks.windows(t, 64, 16)).select("doc_id", "ordinal", "start", "end", "rule")


@query("W14 P04", "WITH w AS (SELECT doc_id, length(text) AS n FROM documents) SELECT doc_id, CAST(k AS INTEGER) AS ordinal, k * 500 AS \"start\", least(n, (k + 1) * 500) AS \"end\" FROM (SELECT doc_id, n, unnest(range(0, (n + 499) // 500)) AS k FROM w)")
def lossless_pieces(spark, sf_dir):
    """Consecutive pieces of 500 characters that together are the text: the length is the count here."""
    return chunks.chunked(spread(table(spark, sf_dir, "documents")), lambda t: ((a, b, "piece") for a, b in chunks.pieces(t, 500, len))).select("doc_id", "ordinal", "start", "end")


@query("C04 C05 C50")
def sentence_span_rows(spark, sf_dir):
    return chunks.chunked(spread(table(spark, sf_dir, "documents")), lambda t: ((a, b, "sentence") for a, b in chunks.sentence_spans(t))).select("doc_id", "ordinal", "start", "end")


@query("S20 S21 C22")
def html_text(spark, sf_dir):
    out = html.html_lines(spread(table(spark, sf_dir, "pages")))
    return out.select("page_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


@query("W09 W08")
def dialogue_passages(spark, sf_dir):
    """Speaker-labelled turns of a conversation packed into passages; a conversation is one decision."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values("turn")
        found = chunks.dialogue([(f"{r}: ", t or "") for r, t in zip(pdf["role"], pdf["text"], strict=True)], "Conversation:\n", 800)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "ordinal": range(len(found)), "n_chars": [len(t) for t, _ in found], "first_turn": [ks[0] for _, ks in found], "last_turn": [ks[-1] for _, ks in found]})

    return c.groupBy("conv_id").applyInPandas(pack, "conv_id long, ordinal int, n_chars int, first_turn int, last_turn int")


@query("F30 T19")
def context_budget(spark, sf_dir):
    """Lines of an order while they fit a budget of quantity; first lines are required. A line that does not fit is skipped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).withColumn("must", F.col("l_linenumber") == 1)
    keep = lambda rows: greedy.within_budget([int(q) for q, _ in rows], [bool(m) for _, m in rows], 60)
    return greedy.by_group(one, "l_orderkey", "l_linenumber", keep, ["l_quantity", "must"]).drop("must")


@query("F31 P25")
def paced_sources(spark, sf_dir):
    """Per segment, customers are granted orders while one slot stays for each customer to come."""
    need = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("need"))
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    rows = c.join(need, c["c_custkey"] == need["o_custkey"]).select("c_mktsegment", "c_custkey", "need")
    return greedy.by_group(rows, "c_mktsegment", "c_custkey", lambda r: greedy.paced([int(n) for (n,) in r], 2000, len(r)), ["need"])
