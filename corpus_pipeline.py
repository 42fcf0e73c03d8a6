"""The corpus pipeline: documents to packed sequences, each stage an operator of ``keelson.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontaminate, packing, queries, secrets, simhash, toxicity
from keelson.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model rejects go.

    Null and empty texts stay, repeated rows stay or go together, null ids and labels are passed over when the model
    learns; without labels of both classes nothing goes. All columns are carried along; an empty table stays empty.
    """
    return toxicity.not_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id, null ids last.

    Null and empty texts are one group. A row that is repeated whole is kept once; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule meets go.

    Null and empty texts have no words and stay; repeated rows stay or go together; without items all stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the scan reports is replaced in its text, and n_chars follows.

    A null text stays null, with a null n_chars. Null sources and languages count as the empty name; repeated rows stay.
    """
    found = secrets.redacted(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens.

    Null text counts as empty, just its end token; repeated rows are packed each; an empty table gives no sequences.
    """
    return packing.pack(docs, queries.byte_bpe_50k())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs


#: The toxicity model and the packing cannot be written in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None
