"""Where books and cases come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024
PAGE_SCHEMA = "path string, page int, text string, ocr_text string"


def upload_status(name: Column, size: Column) -> Column:
    """HTTP status of an upload: extension, size cap, emptiness."""
    return F.when(~F.lower(name).endswith(".pdf"), 400).when(size > MOST_BYTES, 413).when(size == 0, 400).otherwise(202)


def scan_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str] | None = None, pattern: str = "*.pdf") -> DataFrame:
    """One row per page of each file: the parser and the OCR step are injected."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, t, ocr(data, i) if ocr else None) for p, data in zip(pdf["path"], pdf["content"]) for i, t in enumerate(parse(bytes(data)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "ocr_text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.where(upload_status(F.lit("a.pdf"), F.col("length")) == 202).select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases from JSON: {"cases": [...]} or a bare list."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("cases").alias("c")).select("c.*") if "cases" in raw.columns else raw


def cases_of(cases: DataFrame, doc_id: str) -> DataFrame:
    return cases.where(F.col("doc_id").isNull() | F.col("doc_id").isin("", doc_id))
