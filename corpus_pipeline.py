"""A training-corpus pipeline: each stage applies one corpus operator to all that
its predecessor kept, and its decisions take effect.

quality rules (documents that they reject go) -> near-duplicates (one document
of each group stays) -> substring dedup (repeated words are cut out) -> secret
scans (found credentials are masked) -> best-fit packing (pieces and their bins).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperglass.llm import packing, quality, secrets, simhash, substring
from paperglass.llm._shared import checkpoint_folder
from paperglass.plans.shipping import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep, unchanged.  Null, empty and
    very short texts are rejected; repeated rows are judged alike."""
    ship_package(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of
    the sets of five-word shingles: the one of smallest doc_id.

    Candidates come from multi-index hashing of fingerprints, links from an exact
    comparison.  Rows that repeat a doc_id are one document and stay or go
    together; rows without a doc_id stay; texts without words are equal to each
    other; a text of fewer than five words is one shingle.
    """
    ship_package(spark)
    return simhash.one_of_each_group(docs, shingle_words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under a window of 20 that also starts earlier, from
    the first such word to the next kept one.  A null text stays null; a text may
    become empty; null ids count as larger than all others."""
    ship_package(spark)
    return substring.without_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found credential replaced by a mark; a null text stays
    null, texts without credentials are unchanged."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its tokens, bin, offset and the bin's
    length.  A text without words is one row without a bin; repeated rows and
    rows without an id are packed each."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Similarity groups, masks and packing are beyond SQL; each stage is tested
#: against a plain version on a small table (tests/llm/test_edges.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared
    folder and read back as the next one's input."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
