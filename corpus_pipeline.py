"""A training corpus from the documents table: filtered, identified, de-duplicated, mixed and packed.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. Nulls in any column, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathfield.llm.common import arrow_batches, read, staged
from pathfield.llm.jaccard import keep_one
from pathfield.llm.languages import keep_identified
from pathfield.llm.mixing import poisson_mix
from pathfield.llm.packing import harmonic_pack, tokenizer_path
from pathfield.llm.quality import fit_quality, keep_quality

#: Bytes of the Arrow batches that the tasks get that compare texts.
BATCH_BYTES = 4 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on a bounded sample of the labelled ones."""
    return keep_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence tells."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 over five-word shingles join."""
    with arrow_batches(spark, BATCH_BYTES):
        return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts so that every source weighs the same, in a global shuffle."""
    return poisson_mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequences."""
    return harmonic_pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Trained models and a tokenizer's vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
