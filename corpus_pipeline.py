"""A training-data pipeline of five stages, each an operator of ``linkgraph.llm`` applied to all its predecessor kept.

Every stage but the last returns the columns of ``documents``. Null and empty texts, repeated rows and empty tables are
treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import decontam, jaccard, langid, packing, secret_scan
from linkgraph.llm.common import written
from linkgraph.llm.queries import language_model, table, tokenizer_path

#: Share of a text's letters that must stand in known words of its language.
LEAST_SHARE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a letter (null and empty texts too) go, and those of which no language holds a share."""
    return langid.keep(docs, language_model(docs), LEAST_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of texts linked by five-word shingles at 0.8, the smallest doc_id stays."""
    return jaccard.dedupe(docs, k=5, num=80, den=100)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item, reworded or not, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), by_window=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: the spans of secrets, base and added, are replaced in the text, and n_chars follows."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all kept documents into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", keep_languages), ("near_copies", drop_near_copies), ("decontamination", drop_benchmarks), ("secrets", redact_secrets), ("packing", pack_sequences)]
#: The stages use tokenizers and trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
