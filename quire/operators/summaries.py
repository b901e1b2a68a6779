"""Summaries of chapters and books: batches of chunks are mapped, partial texts reduced, chapters joined to a book.

A model is a callable call(kind, label, parts) -> text with kind `map`, `reduce` or `book`; it runs once a row inside
mapInPandas. Calls are dear: write a result before it is used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.grouped import budget_batches

BUDGET = 6000

Call = Callable[[str, str, list[str]], str]


def called(rows: DataFrame, kind: str, call: Call) -> DataFrame:
    """rows(..., label, parts) with the model's text as summary."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(summary=[call(kind, label, list(parts)) for label, parts in zip(pdf["label"], pdf["parts"])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, summary string")


def _weighed(chunks: DataFrame) -> DataFrame:
    """Weight: the token count or, without one, a third of the characters; 1 at least."""
    length = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3))
    return chunks.withColumn("weight", F.coalesce(F.nullif(F.col("tokens"), F.lit(0)), length).cast("int"))


def sections(chunks: DataFrame, chapters: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """The chunks to summarise with their chapter, and the chapters(book, chapter, title, start, end).

    A book with chapters keeps them, without its front matter; any other is cut into sections of twice the budget.
    """
    weighed = _weighed(chunks)
    own = weighed.join(chapters.select("book", "chapter"), ["book", "chapter"], "left_semi")
    bare = weighed.join(chapters.select("book").distinct(), "book", "left_anti").drop("chapter")
    cut = bare.join(budget_batches(bare, 2 * budget).withColumnRenamed("batch", "chapter"), ["book", "pos"])
    made = cut.groupBy("book", "chapter").agg(F.min("page_start").cast("int").alias("start"), F.max("page_start").cast("int").alias("end"))
    made = made.select("book", "chapter", F.format_string("Section %d (pages %d-%d)", F.col("chapter") + 1, "start", "end").alias("title"), "start", "end")
    columns = ["book", "chapter", "title", "start", "end"]
    return own.unionByName(cut.select(own.columns)), chapters.select(columns).unionByName(made)


def summarise_chapters(chunks: DataFrame, chapters: DataFrame, cached: DataFrame, call: Call, budget: int = BUDGET) -> DataFrame:
    """(book, chapter, title, start, end, summary, cached) of chunks(book, pos, chapter, page_start, tokens, text).

    cached(book, chapter, summary) are taken as they are. A chapter without chunks has no row, one with only blank text
    an empty summary. A single partial text needs no reduction.
    """
    rows, named = sections(chunks, chapters, budget)
    known = named.join(cached.select("book", "chapter", "summary"), ["book", "chapter"]).withColumn("cached", F.lit(True))
    open_ = named.join(cached.select("book", "chapter"), ["book", "chapter"], "left_anti")
    asked = rows.join(open_.select("book", "chapter", F.col("title").alias("label")), ["book", "chapter"])
    batches = asked.join(budget_batches(asked, budget, ("book", "chapter")), ["book", "chapter", "pos"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"]), "\n\n")
    mapped = batches.groupBy("book", "chapter", "label", "batch").agg(texts.alias("whole"))
    filled = mapped.where(F.col("whole").rlike(r"(?U)\S")).select("book", "chapter", "label", "batch", F.array("whole").alias("parts"))
    partial = called(filled, "map", call).select("book", "chapter", "batch", "summary")
    parts = partial.groupBy("book", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "summary"))), lambda p: p["summary"]).alias("parts"))
    # one pass over the partial texts: a chapter with a single one goes through without a call
    reduced = called(asked.select("book", "chapter", "label").distinct().join(parts, ["book", "chapter"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>"))), "reduce", _few(call))
    fresh = open_.join(reduced.select("book", "chapter", "summary"), ["book", "chapter"]).withColumn("cached", F.lit(False))
    return known.unionByName(fresh.select(known.columns))


def _few(call: Call) -> Call:
    """Call only for two parts or more."""
    return lambda kind, label, parts: call(kind, label, parts) if len(parts) > 1 else "".join(parts)


def summarise_books(summaries: DataFrame, titles: DataFrame, call: Call) -> DataFrame:
    """(book, summary, built_from) of chapter summaries and titles(book, title); a book with nothing to summarise has no row."""
    told = summaries.where(F.coalesce("summary", F.lit("")) != "")
    parts = told.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "summary"))), lambda p: p["summary"]).alias("parts"))
    rows = parts.join(titles.select("book", F.col("title").alias("label")), "book", "left").withColumn("label", F.coalesce("label", F.lit("")))
    return called(rows, "book", _few(call)).select("book", "summary", F.size("parts").alias("built_from"))
