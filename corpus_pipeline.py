"""Corpus pipeline: documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import language_id, packing, secret_scan, simhash_dedup, span_dedup
from stepwise.llm.common import held_out, table
from stepwise.session import write_and_reload

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, ``lang`` set to it; those without letters go.

    The model learns from the stage's own input, held-out documents apart."""
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))), F.col("text"), F.col("lang"))
    out = language_id.predict(docs, model, "text", keep=COLUMNS)
    return out.where("lang_pred != 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return simhash_dedup.keep_first_of_components(docs.select(*COLUMNS), "doc_id", "text", n=3, bits=3)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; a document left empty stays, empty."""
    out = span_dedup.remove_repeats(docs, "doc_id", "text", length=100, whole_chars=True, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    changed = F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.select(F.col("id").alias("doc_id"), text.alias("text"), "lang", "source", changed.alias("n_chars"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by a mark; no document goes."""
    out = secret_scan.scan(docs, "text", keep=("doc_id", "text", "lang", "source", "n_chars"), with_redacted=True)
    some = F.size("spans") > 0
    return out.select("doc_id", F.when(some, F.col("redacted")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(some, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of 1024 tokens."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return packing.pack(docs, tokenizer, capacity=1024, end_id=2).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("suffix_array_dedup", remove_repeated_spans),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Naive Bayes, suffix arrays and the packing program have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_reload(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
