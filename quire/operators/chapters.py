"""Chapters of books: title-and-author openers, the contents page that completes them, or numbered headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.headings import byline_name, contents_line, parse_heading, plausible_title, same_title, usable_title
from quire.functions.text import let, to_int
from quire.operators.pages import chapter_spans, monotone
from quire.staging import stage

# The titles of pages that list the headings, and a number alone on its line.
CONTENTS_TITLE = r"(?i)^(?:અનુક્રમ|અનુક્રમણિકા|વિષયસૂચિ|વિષયાનુક્રમ|સૂચિ|તસવીરોની\s+વિગત|contents?|index|table\s+of\s+contents)$"
BARE_NUMBER = r"^([0-9૦-૯]{1,2})\s*[.)]?$"
SCAN_BYLINES = 4
SCAN_HEADINGS = 6
LEAST_OPENERS = 3


def page_lines(pages: DataFrame) -> DataFrame:
    """(book, page, lines): the trimmed lines with something on them."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return pages.select("book", "page", F.filter(trimmed, lambda x: x != "").alias("lines"))


def opener(lines: Column) -> Column:
    """(title, real) of the piece that a page opens with, or null.

    An author line near the top counts if the author's first word follows within four lines, or if a usable title
    stands above and no other author line is on the page. Without a usable title the author names the piece.
    """
    def found(names):
        alone = F.size(F.filter(names, lambda n: n.isNotNull())) == 1

        def judged(line, i):
            return let(F.struct(F.get(names, i).alias("name"), F.when(i > 0, F.get(lines, i - 1)).alias("title")), lambda o: titled(o, i))

        def titled(o, i):
            after = F.array_join(F.slice(lines, i + 2, 4), " ")
            known = F.contains(after, F.get(F.split(o["name"], r"\s+"), F.lit(0)))
            return let(F.coalesce(usable_title(o["title"]), F.lit(False)), lambda real: F.when(o["name"].isNotNull() & (known | (real & alone)), F.struct(F.when(real, o["title"]).otherwise(o["name"]).alias("title"), real.alias("real"))))

        return F.get(F.filter(F.transform(F.slice(lines, 1, SCAN_BYLINES), judged), lambda o: o.isNotNull()), F.lit(0))

    return let(F.transform(lines, byline_name), found)


def openers(lined: DataFrame) -> DataFrame:
    """(book, start, title, real)."""
    return lined.select("book", F.col("page").alias("start"), opener(F.col("lines")).alias("o")).where("o is not null").select("book", "start", "o.title", "o.real")


def contents_entries(lined: DataFrame) -> DataFrame:
    """(book, page, at, printed, title): readable lines of the contents pages."""
    listed = lined.where(F.get("lines", F.lit(0)).rlike(CONTENTS_TITLE)).select("book", "page", F.posexplode("lines").alias("at", "line")).where("at > 0")
    return listed.withColumn("e", contents_line(F.col("line"))).where("e is not null").select("book", "page", "at", F.col("e.page").alias("printed"), "e.title")


def page_offset(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, delta): page minus printed number on which two titles or more agree; of equals the first seen."""
    listed = entries.select("book", "page", "at", "printed", F.col("title").alias("listed"))
    votes = found.where("real").join(listed, "book").where(same_title(F.col("title"), F.col("listed"))).groupBy("book", (F.col("start") - F.col("printed")).alias("delta")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "page", "at")).alias("first"))
    best = votes.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "first")))
    return best.where("place = 1 and n >= 2").select("book", "delta")


def complete(starts: dict[int, tuple[str, bool]], listed: list[tuple[int, str]]) -> dict[int, tuple[str, bool]]:
    """Openers with the contents page's titles in place of authors' names, and with its missed pieces that have no opener within a page."""
    out = dict(starts)
    for page, title in listed:
        if page in out:
            out[page] = out[page] if out[page][1] else (title, True)
        elif not {page - 1, page + 1} & out.keys():
            out[page] = (title, True)
    return out


def fill_in(found: DataFrame, targets: DataFrame) -> DataFrame:
    """found(book, start, title, real) completed from targets(book, page, at, target, title); a group is one book's headings."""
    kind = found.schema["book"].dataType.simpleString()

    def run(key, own: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values(["page", "at"])
        done = complete({int(s): (t, bool(r)) for s, t, r in zip(own["start"], own["title"], own["real"])}, list(zip(listed["target"].astype(int), listed["title"])))
        return pd.DataFrame([(key[0], s, t) for s, (t, _) in sorted(done.items())], columns=["book", "start", "title"])

    named = targets.select(F.col("book").alias("of"), "page", "at", "target", "title")  # names of its own: both sides may come from one table
    return found.groupBy("book").cogroup(named.groupBy("of")).applyInPandas(run, f"book {kind}, start int, title string")


def candidates(lines: Column, headers: Column, page: Column) -> Column:
    """Heading-like lines as (level, number, title); a bare number that is not the page's own takes the next line as its title."""
    def judged(line, i):
        number, title = to_int(F.regexp_extract(line, BARE_NUMBER, 1)), F.get(lines, i + 1)
        bare = line.rlike(BARE_NUMBER) & (number != page) & ~F.array_contains(headers, title) & plausible_title(title)
        made = F.struct(F.lit(1).alias("level"), number.alias("number"), F.concat(number, F.lit(". "), title).alias("title"))
        return F.when(F.array_contains(headers, line), None).otherwise(F.coalesce(parse_heading(line), F.when(bare, made)))

    return F.filter(F.transform(lines, judged), lambda c: c.isNotNull())


def numbered(lined: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, start, title) by numbered headings; none in a book with more than a third of its pages as chapters."""
    tops = lined.select("book", F.explode(F.array_distinct(F.slice("lines", 1, 3))).alias("line")).groupBy("book", "line").agg(F.count(F.lit(1)).alias("n"))
    headers = tops.join(sizes, "book").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.2))).groupBy("book").agg(F.collect_list("line").alias("headers"))
    own = lined.join(headers, "book", "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    listed = own.where(F.coalesce(~F.get("lines", F.lit(0)).rlike(CONTENTS_TITLE), F.lit(False))).select("book", "page", candidates(F.col("lines"), F.col("headers"), F.col("page")).alias("every"), candidates(F.slice("lines", 1, SCAN_HEADINGS), F.col("headers"), F.col("page")).alias("top"))
    found = listed.where(F.size("every") < 3).select("book", F.col("page").alias("at"), F.get("top", F.lit(0)).alias("h")).where("h is not null").select("book", "at", "h.*")
    book = Window.partitionBy("book")
    found = monotone(found.withColumn("top", F.min("level").over(book)).where("level = 1 or top > 1"))
    return found.withColumn("n", F.count(F.lit(1)).over(book)).join(sizes, "book").where(F.col("n") <= F.greatest(F.lit(3), F.floor(F.col("pages") / 3))).select("book", F.col("at").alias("start"), "title")


def detect_chapters(pages: DataFrame) -> DataFrame:
    """pages(book, page, text) to (book, chapter, title, start, end).

    LEAST_OPENERS openers or more make an anthology; any other book is split by its numbered headings or, without
    those, by the openers it has.
    """
    lined = stage(page_lines(pages), "lines")  # openers, contents and headings each read it
    sizes = lined.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    found = stage(openers(lined), "openers")
    many = found.groupBy("book").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_OPENERS).select("book")
    rich = found.join(many, "book", "left_semi")
    entries = contents_entries(lined)
    target = (F.col("printed") + F.col("delta")).cast("int")
    targets = entries.join(page_offset(rich, entries), "book").join(sizes, "book").select("book", "page", "at", target.alias("target"), "title", "first_page", "last_page").where("target between first_page and last_page")
    anthologies = fill_in(rich, targets)
    by_number = numbered(lined.join(many, "book", "left_anti"), sizes)
    few = found.join(many, "book", "left_anti").join(by_number.select("book").distinct(), "book", "left_anti").select("book", "start", "title")
    return chapter_spans(anthologies.unionByName(by_number).unionByName(few), sizes.select("book", "last_page"))
