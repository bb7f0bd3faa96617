"""The corpus pipeline: quality rules, near copies, benchmark passages, personal data, token ids.

Each stage reads all that its predecessor kept, and its decisions take effect: rejected documents go, one of each group
of near copies stays, documents with a benchmark passage go, personal data is redacted. The last stage returns the
kept documents' ids as tokens.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixloom.llm import bytebpe, decontam, pii, quality, shared, shingle_join
from helixloom.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def shingle_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_matching(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.digests(docs, tokenizers.path(BYTE_BPE), tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", shingle_copies),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: Robust estimates, components and merges can't be expressed in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. Of each but the last the result is a table in the shared folder, which goes when
    the next one stands; the last reads the fourth's.

    A null text counts as empty: quality rules reject it, as they do texts of fewer than 50 words. Repeated rows are
    judged alike and one stays; documents without id are none's copies. Columns that the stages don't know pass through,
    whatever their names. An empty table gives no rows.
    """
    tables = shared.Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.write(f"pipeline-{k}", stage(spark, docs, sf_dir))
        tables.drop(f"pipeline-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
