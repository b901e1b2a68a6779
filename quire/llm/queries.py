"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import simhash

    return simhash.query(spark, table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import licenses

    return licenses.query(spark, table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import packing

    return packing.query(spark, table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality

    return quality.query(spark, table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import media

    return media.query(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    return toxicity.query_labels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pieces

    return pieces.query(spark, table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import site_quality

    return site_quality.query_labels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import sharding

    return sharding.query(spark, table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import langid

    return langid.query(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_simhash, op2_licenses, op3_packing, op4_quality, op5_media, op6_toxicity, op7_pieces, op8_site_quality, op9_sharding, op10_langid, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from quire.llm import quality

    return {"op4_quality": quality.ORACLE_SQL}
