"""Shared plumbing: table reads, staging in the shared folder, numbering without gathering a key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.staging import broadcast_if_small, stage  # noqa: F401  the operators take both from here

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod m; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def texts_of(column: pa.Array) -> list[bytes]:
    """Arrow binary column to bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.to_pylist()]


def with_local_rank(key: str):
    """mapInArrow function: appends chunk (the task's partition) and local_rank (0.. per key within it).

    A retried task numbers its own rows afresh, and only one attempt's output is committed, so the staged
    numbers are consistent whatever fails.
    """

    def number(batches):
        import numpy as np
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.r_[first, len(keys)])
            base = [seen.get(int(k), 0) for k in ordered[first]]
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(first, sizes) + np.repeat(np.asarray(base, np.int64), sizes)
            for k, b, n in zip(ordered[first].tolist(), base, sizes.tolist()):
                seen[k] = b + n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), chunk, np.int32)), pa.array(local)],
                names=[*batch.schema.names, "chunk", "local_rank"],
            )

    return number


def rank_offsets(ranked: DataFrame, key: str) -> DataFrame:
    """(chunk, key, base): rows of the key in earlier chunks. One small row per chunk and key, never the rows themselves."""
    counts = ranked.groupBy("chunk", key).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("chunk", key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("base"))
