"""Structured Streaming twins: ingestion and admission."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.grouped import admit


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a Parquet file or folder; for a single file the folder is watched under its name."""
    found = spark.read.schema(schema).parquet(path).inputFiles()
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    if any(f.endswith(f"/{name}") for f in found):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def ingest(spark: SparkSession, folder: str, schema, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Run the batch function over whatever new files the folder has, exactly once each."""
    return files(spark, folder, schema).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(events: DataFrame, limit: int, span: int = 3600) -> DataFrame:
    """events(user, action, ts timestamp, id) to (id, admitted): the state is the admitted times within the span.

    A user's state goes when the watermark, a span behind the latest event, has passed the last admitted time by a
    span. Events of a micro-batch are taken in order, however many frames a key's rows come in; one that comes after
    later ones is judged by what is admitted by then.
    """
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        # Spark cuts a key's rows where an Arrow batch is full, in no order of time: only whole are they put in order
        pdf = pd.concat([f[["at", "id"]] for f in frames]).sort_values(["at", "id"])
        out = []
        for at in pdf["at"].tolist():
            held = [t for t in held if at - t < span]
            ok = len(held) < limit
            out.append(ok)
            held += [at] if ok else []
        yield pd.DataFrame({"id": pdf["id"], "admitted": out})
        state.update((held,))
        state.setTimeoutTimestamp(max(int((max(held, default=0) + span) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", f"{span} seconds").withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy("user", "action").applyInPandasWithState(run, "id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["admit", "ingest", "rate_limit"]
