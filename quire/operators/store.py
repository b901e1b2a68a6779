"""Functional writes on tables without a transactional format: each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_partition(table: DataFrame, new: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """All rows of the named owners give way to the new ones; an owner without new rows is cleared."""
    return table.join(owners.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old ones of the same key."""
    every = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))).where("_n = 1").drop("_new", "_n")


def update_by_key(table: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(match, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def latest(table: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order; ties beyond it are arbitrary, so it should be total."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def drop_oldest_quarter(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a full store keeps: a quarter of each key's rows, rounded up, goes from the oldest on."""
    own = Window.partitionBy(*keys)
    place = table.withColumns({"_n": F.row_number().over(own.orderBy(*order)), "_of": F.count(F.lit(1)).over(own)})
    return place.where(F.col("_n") > F.ceil(F.col("_of") / 4)).drop("_n", "_of")


def count_matches(table: DataFrame, match: Column) -> int:
    """Rows that an update would change."""
    return table.agg(F.count_if(match)).first()[0]


def insert(table: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """New rows with the defaults of the columns they lack; other lacking columns are null."""
    return table.unionByName(new.withColumns({c: v for c, v in defaults.items() if c not in new.columns}), allowMissingColumns=True)


def as_json(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The columns as one JSON column, as evaluations are kept."""
    return table.withColumn(name, F.to_json(F.struct(*columns))).drop(*columns)


def paired(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks and vectors by key with state: paired, no vector, or no chunk."""
    both = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full")
    return both.withColumn("state", F.when(F.col("_c").isNull(), "no chunk").when(F.col("_v").isNull(), "no vector").otherwise("paired")).drop("_c", "_v")


def append_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks with their vectors; raises on the first chunk or vector without its partner, so nothing is half written."""
    whole = F.when(F.col("state") != "paired", F.raise_error(F.lit("chunks and vectors differ in length")).cast("int")).otherwise(F.lit(1))
    return paired(chunks, vectors, key).where(whole == 1).drop("state")
