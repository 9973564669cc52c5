"""From raw documents to packed sequences: quality, rules, near-duplicates, secrets, packing.

Every stage works on all that the one before kept. Between stages the documents are a written table in
the shared folder, so a lost executor costs a re-read of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firstpast.llm import blob_ledger, bradley_terry, compression_bands, ga_packing, pivot_simhash
from firstpast.llm.common import table
from firstpast.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones of the input, accepts."""
    model = bradley_terry.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return bradley_terry.keep(docs, table(spark, sf_dir, "labels"), model=model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    return compression_bands.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    return pivot_simhash.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark."""
    return blob_ledger.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    return ga_packing.pack(docs)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("near-duplicates", near_duplicates),
          ("secret scans", secrets), ("best-fit packing", packing)]

# Classifier, compression ratios and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "packed")
