"""A training-data pipeline: good documents, their lines once, one of each group of near copies, without benchmark passages, as tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, quality
from playbill.llm.queries import RANKS, table
from playbill.session import cut_lineage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of all lines that are alike; ``n_chars`` follows the text."""
    kept = line_dedup.keep_first_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words at a similarity of 0.8."""
    return minhash_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    # stored, as encoding and decoding in one task would take two Python workers, which stay
    ids = cut_lineage(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN))
    texts = byte_bpe.decode(ids, RANKS)
    return texts.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", first_lines),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", tokens),
]
#: no stage but one can be put into SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
