"""Corpus pipeline: from raw documents to token ids, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from meterkit.llm.queries import GOOD, quality_model, table, tokenizer_file
from meterkit.llm.scratch import free_name, write_scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on ``docs`` and the usable labels: documents
    that score under the threshold go."""
    model = quality_model(spark, docs.select("doc_id", "text"), sf_dir)
    name = free_name(docs.columns, "__score")
    return quality.score(docs, model, out=name).where(F.col(name) >= GOOD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (five words, similarity 0.8): of each group, the
    smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with 5 % of their words or more in
    benchmark windows go."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: the documents with their ids, and digests of the ids and
    of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_file(), keep_ids=True)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", token_ids),
]

#: The quality classifier and the token ids are beyond SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
