"""A training-data pipeline over `documents`: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxaflow.llm import decontaminate, minhash, packing, quality, secrets
from taxaflow.llm.common import saved, table
from taxaflow.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that cross-document lines deplete go; those that stay lose such lines.

    The document with the smallest id keeps a line that its host's others lose, so one of each group of copies stays. Null and empty
    texts go; rows without source are a host of their own; repeated rows stay or go together. An empty table stays empty.
    """
    return quality.apply_rules(docs, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 stays, that with the smallest doc_id.

    Null and empty texts are copies of each other. Of rows that repeat an id one stays; a row without id stays only if its whole group
    has none. An empty table stays empty.
    """
    return minhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's words go.

    Null, empty and short texts hold none and stay; repeated rows stay or go together. With either table empty nothing goes.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, with null ids, null and empty texts and repeats as they are."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences: a null or empty text is its end id alone, repeated rows are documents of their own."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: A forest and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
