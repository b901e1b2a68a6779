"""Ingestion of books: page furniture, statistics, chapters, chunks and vectors, as stages over all books at once.

Tables: pages(book, page, text, source). A book that yields no text or no chunks, or whose vectors fail, is marked
failed and leaves nothing behind; the others are ready. Null page texts count as empty; repeated pages of a book are
read as often as they come; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens
from quire.operators.chapters import detect_chapters
from quire.operators.grouped import pack_windows, sentence_units
from quire.operators.pages import chunking_stats, extraction_stats, pages_in_chapters, strip_running_lines
from quire.operators.retrieval import unit
from quire.staging import stage

SIZE, OVERLAP = 400, 50
# What the embedding model expects before a passage and before a question.
PASSAGE, QUESTION = "passage: ", "query: "
BATCH = 32

Embed = Callable[[list[str]], list[list[float]]]


def chunk_pages(pages: DataFrame, spans: DataFrame, size: int = SIZE, overlap: int = OVERLAP, count: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """(book, chunk_id, chunk_index, text, page_start, page_end, chapter, chapter_title, token_count) of pages(book, page, text).

    Chunks keep to one of the spans(book, chapter, title, start, end); pages before the first are chapter -1.
    """
    units = sentence_units(pages.select("book", "page", "text"), size, count).join(pages_in_chapters(pages.select("book", "page").distinct(), spans), ["book", "page"])
    units = units.withColumn("pos", F.col("page").cast("long") * 1_000_000 + F.col("n"))
    held = pack_windows(units.select("book", "chapter", "pos", "tokens"), size, overlap).join(units, ["book", "chapter", "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    made = held.groupBy("book", "chapter", "window").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("tokens").alias("token_count"), text.alias("text"))
    index = F.row_number().over(Window.partitionBy("book").orderBy("chapter", "window")) - 1
    named = made.withColumn("chunk_index", index).join(spans.select("book", "chapter", F.col("title").alias("chapter_title")), ["book", "chapter"], "left")
    chunk_id = F.concat_ws(":", F.col("book").cast("string"), F.col("chunk_index").cast("string"))
    return named.withColumns({"chunk_id": chunk_id, "chapter_title": F.coalesce("chapter_title", F.lit(""))}).drop("window")


def embed(rows: DataFrame, text: Column, model: Embed, prefix: str, name: str = "vector", by: str = "book", batch: int = BATCH) -> DataFrame:
    """rows with unit vectors of prefix and text, asked for in batches of one book each; null where the model fails on a batch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: dict[int, list[float] | None] = {}
            for _, own in pdf.reset_index(drop=True).groupby(by, sort=False, dropna=False)["_text"]:
                for i in range(0, len(own), batch):
                    asked = own.iloc[i : i + batch]
                    try:
                        out |= zip(asked.index, model([prefix + t for t in asked]))
                    except RuntimeError:  # what a model raises for a batch it cannot do
                        out |= dict.fromkeys(asked.index)
            yield pdf.drop(columns="_text").assign(**{name: pd.Series([out[i] for i in range(len(pdf))], index=pdf.index, dtype=object)})

    asked = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return asked.mapInPandas(run, f"{kinds}, {name} array<double>").withColumn(name, unit(F.col(name)))


def tokenizer(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A token counter for sentence_units from a tokenizer's encode function."""
    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(encode(t or "")))

    return count


@dataclass
class Books:
    """What an ingestion leaves: status(book, status, progress, error, title, author, page_count, chunk_count, chapter_count), and the tables of the books that are ready."""

    status: DataFrame
    pages: DataFrame
    chapters: DataFrame
    chunks: DataFrame
    extraction: DataFrame
    chunking: DataFrame


def metadata(files: DataFrame) -> DataFrame:
    """(book, title, author): the files' own title, or the uploaded name without its ending; texts trimmed, null as empty."""
    given = lambda c: F.trim(F.coalesce(c, F.lit("")))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return files.select("book", F.coalesce(F.nullif(given("title"), F.lit("")), stem).alias("title"), given("author").alias("author"))


def ingest(pages: DataFrame, files: DataFrame, model: Embed, size: int = SIZE, overlap: int = OVERLAP, count: Callable[[Column], Column] = estimate_tokens) -> Books:
    """The whole chain for the books of files(book, filename, title, author); pages(book, page, text, source)."""
    clean = stage(strip_running_lines(pages).join(pages.select("book", "page", "source"), ["book", "page"]), "pages")
    extraction = extraction_stats(clean)
    chapters = stage(detect_chapters(clean), "chapters")
    chunks = stage(embed(chunk_pages(clean, chapters, size, overlap, count), F.col("text"), model, PASSAGE), "chunks")
    own = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(F.col("vector").isNull()).alias("lost"))
    heads = chapters.groupBy("book").agg(F.count(F.lit(1)).alias("chapter_count"))
    seen = metadata(files).join(extraction.select("book", F.col("pages").alias("page_count"), "chars"), "book", "left").join(own, "book", "left").join(heads, "book", "left")
    seen = seen.na.fill(0, ["page_count", "chars", "chunk_count", "lost", "chapter_count"])
    error = F.when(F.col("chars") == 0, "no text").when(F.col("chunk_count") == 0, "no chunks").when(F.col("lost") > 0, "no vectors")
    status = F.when(error.isNull(), "ready").otherwise("failed")
    kept = lambda c: F.when(error.isNull(), F.col(c)).otherwise(0).alias(c)
    told = stage(seen.select("book", status.alias("status"), status.alias("progress"), error.alias("error"), "title", "author", "page_count", kept("chunk_count"), kept("chapter_count")), "status")
    ready = told.where("status = 'ready'").select("book")
    only = lambda t: t.join(ready, "book", "left_semi")
    stats = chunking_stats(only(chunks).select("book", F.col("token_count").alias("tokens")), told.select("book"))
    return Books(told, only(clean), only(chapters), only(chunks), extraction, stats)
