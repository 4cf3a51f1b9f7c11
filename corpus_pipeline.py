"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, decontaminate, exact_dedup, near_copies, quality
from tallyframe.llm.common import documents, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts and sites are judged like any other; repeated rows and null ids stay; without labels all is kept; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null counts as empty; a null id stays only where its text has no other; of repeated rows one stays.
    """
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the row with the least doc_id.

    SimHash links by anchor-point covering come first, then those that its 3 bits can't reach (see near_copies). Null ids come last; of one id the least hash of
    text stays; texts without words are copies of each other.
    """
    return near_copies.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; null items and items without words are left out; an empty benchmark keeps all.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of what is left, as digests; null and blank texts have no ids; repeated rows and null ids stay."""
    return bpe.encoded(docs, full=False)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]
#: Fingerprints, classifiers and tokenizers are not SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
