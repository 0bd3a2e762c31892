"""The registered queries: thin digests over the operators, on whole tables.

``ORACLES`` holds DuckDB statements where SQL expresses the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import (filter_audit, fingerprints, language_id, line_runs, packing, piece_bpe, quality_rules, rule_ensemble, secret_scan, simhash_dedup,
                          span_dedup, spelling, warc)
from stepwise.llm.common import held_out, table
from stepwise.session import scratch_path


def _sha(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=100)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    pairs = pairs.withColumn("edited_fingerprint", fingerprints.fingerprint(F.col("edited")))
    return pairs.select(F.col("id").alias("doc_id"), "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                        fingerprints.likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    out = piece_bpe.encode_decode(table(spark, sf_dir, "documents"), model)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", _sha(F.col("ids")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    arcs = warc.arc_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    warc.write_warc(warc.warc_archives(warc.convert(warc.read_arc(arcs), min_bytes=0)), path)
    out = warc.resolve_revisits(warc.read_warc(spark, path))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = language_id.train(docs.where("not held_out"), F.col("text"), F.col("lang"))
    return language_id.predict(docs, model, "text", keep=("doc_id", "held_out"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, capacity=1024, end_id=2).withColumnRenamed("id", "doc_id")


def _span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"), "text", keep=("doc_id",))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), _sha(_span_text(base)).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, bits=3, seed=42)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text", min_chars=20, min_docs=3)
    return out.select(F.col("key").alias("doc_id"), "n_lines", "n_dropped", _sha(F.col("kept")).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "source")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), "doc_id", "text", min_chars=5, min_count=3)


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_quality_rules, op3_fingerprints, op4_sentencepiece, op5_warc, op6_rule_ensemble, op7_language_id, op8_packing,
    op9_secret_scan, op10_simhash_dedup, op11_line_dedup, op12_filter_audit, op13_spelling_variants)}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op11_line_dedup": line_runs.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
