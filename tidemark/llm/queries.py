"""The thin queries of the contracts: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, near_dedup, order_minhash, packing, pii, quality_model, quality_rules, toxicity
from .common import documents, fold_of


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("__base")), 256).alias("base_sha256"), pii.listed(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.score(docs, quality_model.train(docs))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash.with_edited(documents(spark, sf_dir).select("doc_id", "text"))
    prints = [order_minhash.fingerprint(F.col(c)).alias(name) for c, name in (("sig", "fingerprint"), ("edited_sig", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.train(langid.learning(docs)))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), _vocabulary("byte_bpe_multi_50k.tiktoken"), ids=False)
    return out.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, toxicity.learning(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measure(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.mark(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=85)
    return out.select("doc_id", F.col("__n_shingles").alias("n_shingles"), F.col("__component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("__component"), F.lit(True)).alias("kept"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_pii": op2_pii, "op3_quality_classifier": op3_quality_classifier, "op4_order_minhash": op4_order_minhash, "op5_language_id": op5_language_id, "op6_byte_bpe": op6_byte_bpe, "op7_toxicity": op7_toxicity, "op8_quality_rules": op8_quality_rules, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op10_best_fit_packing": op10_best_fit_packing}
