"""Corpus pipeline: quality rules, language ID, SimHash near-duplicates, best-fit packing.

Each stage is written as Parquet in the shared folder and read back as the next one's documents; the folders go when
the driver ends. All but the last stage return the columns of documents as they came, whatever these are called.

Defined results: null and empty texts fail the quality rules and go, as do texts without a letter in language ID. Of
repeated rows and of rows with equal or similar texts one stays, that with the smallest doc_id; a row without a doc_id
stays only where its group has no other. Null lang and source are values of their own in the quality rules. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, packing, quality, simhash
from quire.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; thresholds are those of the documents given, so an outlier goes only beside others."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go; languages are learned from the rows given."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles at a Jaccard similarity of 0.8, exactly."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces with their places in sequences; only documents over a sequence are cut."""
    return packing.query(spark, docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("best-fit packing", pack)]

#: Fingerprint links and tokenizer ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
