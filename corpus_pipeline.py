"""The corpus pipeline: raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes every result as Parquet in the
shared folder and reads it again. All but the last return the columns of documents, with n_chars following the text.

Edge cases are those of the operators: null and empty texts go through as documents without text, an empty table comes out empty,
columns that documents do not have pass through until the last stage, which returns a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_dedup, packing, pii, toxicity
from tidemark.llm.common import apart_names, documents, drop_staged, staged, staged_so_far

#: No SQL can express the learned stages; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def _with_text(found: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents with another text and its length."""
    new = {"text": F.when(F.col("text").isNotNull(), F.col(text))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))
    named = apart_names(columns)
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{named[c]}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go."""
    labels = toxicity.learning(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them."""
    return _with_text(line_dedup.dedup_lines(docs), "__kept", docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    found = near_dedup.mark(docs, k=5, percent=80)
    return found.where(F.col("__component").isNull() | (F.col("doc_id") == F.col("__component"))).select(*[F.col(f"`{new}`").alias(c) for c, new in apart_names(docs.columns).items()])


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced or removed."""
    return _with_text(pii.find(docs), "__sanitised", docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_documents), ("pii", sanitise), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of sf_dir."""
    docs, before = documents(spark, sf_dir), staged_so_far()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_staged(before, keep=1)  # what the stage worked on and left behind
    return STAGES[-1][1](spark, docs, sf_dir)
