"""Pages of books: routing, folios, running lines, chapters by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import latin_digits, legacy_encoded, letter_count, readable_letter_count


def route_sources(pages: DataFrame, least: int = 60) -> DataFrame:
    """pages(text, ocr_text) to text and source: digital, ocr or empty."""
    legacy = legacy_encoded(F.col("text"))
    base = F.when(legacy, "").otherwise(F.coalesce("text", F.lit("")))
    ocr = (legacy | (letter_count(F.col("text")) < least)) & (readable_letter_count(F.col("ocr_text")) > readable_letter_count(base))
    source = F.when(ocr, "ocr").when(F.trim(base) == "", "empty").otherwise("digital")
    return pages.withColumns({"source": source, "text": F.when(ocr, F.col("ocr_text")).otherwise(base)})


#: A line that is only a number, as a printed page number is.
NUMBER = "^[0-9૦-૯]{1,4}$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(pages: DataFrame) -> DataFrame:
    """(book, page, at, line): non-blank lines with their order."""
    split = pages.select("book", "page", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.select("book", "page", "at", stripped(F.col("line")).alias("line")).where("line <> ''")


def edge_lines(pages: DataFrame, scan: int = 2) -> DataFrame:
    """The first and the last lines of each page; in a short page a line counts from either end."""
    page = Window.partitionBy("book", "page")
    every = lines(pages).select("book", "page", "at", "line", F.row_number().over(page.orderBy("at")).alias("up"), F.row_number().over(page.orderBy(F.desc("at"))).alias("down"))
    ends = F.explode(F.array_compact(F.array(F.when(F.col("up") <= scan, F.lit(0)), F.when(F.col("down") <= scan, F.lit(1))))).alias("end")
    return every.select("book", "page", "at", "line", ends)


def folio_offset(pages: DataFrame) -> DataFrame:
    """(book, delta, hits): the modal page number minus printed number, if on max(3, pages/10) lines or more; ties by first seen."""
    number = latin_digits(F.col("line")).try_cast("int")
    seen = edge_lines(pages).where(F.col("line").rlike(NUMBER)).select("book", (F.col("page") - number).alias("delta"), "page", "end", "at")
    votes = seen.groupBy("book", "delta").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("page", "end", "at")).alias("first"))
    best = votes.withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("hits"), "first"))).where("n = 1")
    size = pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    return best.join(size, "book").where(F.col("hits") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 10))).select("book", "delta", "hits")


def running_lines(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(book, line, on_pages): edge lines, numbers aside, that stand on max(3, share of pages) pages or more."""
    size = pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    seen = edge_lines(pages).where(~F.col("line").rlike(NUMBER)).select("book", "page", "line").distinct().groupBy("book", "line").agg(F.count(F.lit(1)).alias("on_pages"))
    return seen.join(size, "book").where((F.col("pages") >= 5) & (F.col("on_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share)))).select("book", "line", "on_pages")


def strip_running_lines(pages: DataFrame, most: int = 2, share: float = 0.2) -> DataFrame:
    """Pages without up to `most` running lines, folios or blank lines at either end; books under 5 pages are untouched."""
    size = pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    own = running_lines(pages, share).groupBy("book").agg(F.collect_set("line").alias("running"))
    known = pages.join(size, "book").join(own, "book", "left").join(folio_offset(pages).select("book", "delta"), "book", "left")
    parts = F.split("text", "\n")

    def furniture(x):
        t = stripped(x)
        folio = t.rlike(NUMBER) & (latin_digits(t).try_cast("int") == F.col("page") - F.col("delta"))
        return (t == "") | F.coalesce(F.array_contains("running", t), F.lit(False)) | F.coalesce(folio, F.lit(False))

    def leading(a):
        return F.aggregate(F.slice(a, 1, most), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & furniture(x), 1).otherwise(0)).alias("n"), (s["on"] & furniture(x)).alias("on")), lambda s: s["n"])

    known = known.withColumn("lines", parts).withColumn("top", leading(F.col("lines")))
    known = known.withColumn("lines", F.slice("lines", F.col("top") + 1, F.greatest(F.size("lines") - F.col("top"), F.lit(0))))
    known = known.withColumn("bottom", leading(F.reverse("lines")))
    cut = F.array_join(F.slice("lines", 1, F.greatest(F.size("lines") - F.col("bottom"), F.lit(0))), "\n")
    return known.select("book", "page", F.when(F.col("pages") < 5, F.col("text")).otherwise(stripped(cut)).alias("text"))


def chapter_spans(starts: DataFrame, last_page: DataFrame) -> DataFrame:
    """starts(book, start, title) with end: the page before the next start, never before its own."""
    following = F.lead("start").over(Window.partitionBy("book").orderBy("start"))
    number = F.row_number().over(Window.partitionBy("book").orderBy("start")) - 1
    return starts.join(last_page, "book").select("book", number.alias("chapter"), "title", "start", F.greatest(F.coalesce(following - 1, F.col("last_page")), F.col("start")).alias("end"))


def pages_in_chapters(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Each page with its chapter, -1 for front matter: an equi-join on the pages of the spans, not a range join."""
    held = spans.select("book", "chapter", F.explode(F.sequence("start", "end")).alias("page"))
    return pages.join(held, ["book", "page"], "left").select("book", "page", F.coalesce("chapter", F.lit(-1)).alias("chapter"))


def monotone(headings: DataFrame) -> DataFrame:
    """Numbered headings stay only above all earlier numbers; unnumbered ones stay. headings(book, at, number)."""
    before = Window.partitionBy("book").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return headings.withColumn("_top", F.coalesce(F.max("number").over(before), F.lit(0))).where(F.col("number").isNull() | (F.col("number") > F.col("_top"))).drop("_top")


def extraction_stats(pages: DataFrame) -> DataFrame:
    """(book, pages, digital, ocr, empty, chars) of pages(book, text, source)."""
    return pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("source") == s).alias(s) for s in ("digital", "ocr", "empty")], F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def chunking_stats(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(book, chunks, mean, least, most) of chunks(book, tokens), zeros for books(book) without any."""
    own = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("tokens"), 1).alias("mean"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))
    return books.join(own, "book", "left").na.fill(0, ["chunks", "mean", "least", "most"])
