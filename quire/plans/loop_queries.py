"""Queries on the steps of the ask loop with a scripted model, and on the ingestion chain over conversations as books."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.operators import asking, ingestion
from quire.plans.fixture_queries import rows
from quire.plans.registry import query, values
from quire.plans.table_queries import book_pages


def scripted(kind: str, payload: dict) -> str:
    """A stand-in for a model whose replies SQL can state."""
    asked = payload["question"]
    if "outage" in asked:
        raise RuntimeError
    if kind == "translate":
        return f'"દીવા {asked}"' if "lamp" in asked else f"no {asked}"
    if kind == "grade":
        return json.dumps({"grades": [{"passage": i, "relevant": asked.split()[0].lower() in t} for i, t in enumerate(payload["passages"], 1)]})
    return payload["tried"][0] if "same" in asked else f"{asked} {payload['attempt']}"


def letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model."""
    return [[float(len(t)), 1.0 + t.count("e")] for t in texts]


ASKED = [(1, "lamp at nine", "english"), (2, "act two", "english"), (3, "outage now", "english"), (4, "દીવા lamp", "gujarati"), (5, "same act", "english")]
PUT = [(1, "દીવા lamp at nine"), (2, "act two"), (3, "outage now"), (4, "દીવા lamp"), (5, "same act")]


def state(spark):
    asked = rows(spark, ASKED, "question, original, language")
    return asked.select("question", "original", F.col("original").alias("query"), "language", F.lit(0).alias("attempts"), F.array("original").alias("tried"))


@query("translate_questions", "SELECT question, query FROM " + values(PUT, "question, query"))
def translate_questions(spark, d):
    return asking.translate(state(spark), scripted).select("question", "query")


@query("rewrite_questions", "SELECT question, query, attempts FROM " + values([(1, "lamp at nine 1", 1), (2, "act two 1", 1), (3, "outage now", 1), (4, "દીવા lamp 1", 1), (5, "same act", 1)], "question, query, attempts"))
def rewrite_questions(spark, d):
    return asking.rewrite(state(spark), scripted).select("question", "query", "attempts")


FOUND = [(q, r, t) for q in (1, 2, 3) for r, t in ((1, "an act began"), (2, "a lamp was lit"), (3, "the lamp and the act"))]


@query("grade_passages", "SELECT question, text FROM " + values([(1, FOUND[1][2]), (1, FOUND[2][2]), (2, FOUND[0][2]), (2, FOUND[2][2]), *((3, t) for _, _, t in FOUND[:3])], "question, text"))
def grade_passages(spark, d):
    documents = rows(spark, FOUND, "query, rank, text")
    return asking.grade(state(spark), documents, scripted).select(F.col("query").alias("question"), "text")


@query("ingest_books", "SELECT conv_id AS book, 'ready' AS status, 'conversation ' || conv_id AS title, count(*) AS page_count, true AS chunked FROM conversations GROUP BY conv_id HAVING sum(length(trim(text))) > 0 UNION ALL SELECT conv_id, 'failed', 'conversation ' || conv_id, count(*), false FROM conversations GROUP BY conv_id HAVING sum(length(trim(text))) = 0")
def ingest_books(spark, d):
    return ingested(book_pages(spark, d)).select("book", "status", "title", "page_count", (F.col("chunk_count") > 0).alias("chunked"))


def ingested(pages):
    """The status of all books of pages(book, page, role, text) after their ingestion."""
    pages = pages.select("book", "page", "text", F.when(F.col("role") == "user", "digital").otherwise("ocr").alias("source"))
    name = F.concat(F.lit("conversation "), F.col("book").cast("string"), F.lit(".pdf"))
    files = pages.select("book").distinct().select("book", name.alias("filename"), F.lit("").alias("title"), F.lit(None).cast("string").alias("author"))
    return ingestion.ingest(pages, files, letters).status
