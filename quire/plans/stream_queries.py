"""Streaming queries, driven to completion over a table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import table_queries  # noqa: F401  registers the batch twin, whose SQL is taken
from quire.plans.loop_queries import ingested
from quire.plans.registry import SQL, query, table
from quire.staging import shared_dir
from quire.streaming import streams


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream"


def _drain(spark, stream, schema, out: str):
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query("stream_ingest", "SELECT conv_id AS book, CASE WHEN sum(length(trim(text))) > 0 THEN 'ready' ELSE 'failed' END AS status, count(*) AS page_count FROM conversations GROUP BY conv_id")
def stream_ingest(spark, d):
    """Each micro-batch of new pages runs the whole ingestion chain for its books and appends their status."""
    out = _folder(spark)
    pages = lambda rows: rows.select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), "role", "text")
    done = lambda rows, _: ingested(pages(rows)).select("book", "status", "page_count").write.mode("append").parquet(f"{out}/rows")
    streams.ingest(spark, f"{d}/conversations.parquet", table(spark, d, "conversations").schema, done, f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_rate_limit", "SELECT id, admitted FROM (" + SQL["rate_limit_admission"] + ")")
def stream_rate_limit(spark, d):
    schema = table(spark, d, "events").schema
    events = streams.files(spark, f"{d}/events.parquet", schema)
    rows = streams.rate_limit(events.select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id")), 2, 604800)
    return _drain(spark, rows, "id long, admitted boolean", _folder(spark))
