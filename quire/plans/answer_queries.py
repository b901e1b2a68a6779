"""Queries on claims, citations, chapters and the display of answers over small inline rows, as the tables have no Gujarati."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import answers as show
from quire.functions.text import words_of
from quire.operators import chapters, claims, summaries
from quire.plans.fixture_queries import rows
from quire.plans.registry import query, values

PAGE_ROWS = [
    ("b", 201, "નાટક ભજવવા માટે મંચ જોઈએ અને નટો જોઈએ."), ("b", 202, "પ્રેક્ષકો વિના નાટક અધૂરું રહે છે. રંગમંચ ખાલી હોય."),
    ("c", 14, "the lamps were lit at nine"), ("c", 15, ""), ("d", 40, "some text"),
]
WHOLE = " ".join(text for book, _, text in PAGE_ROWS if book == "b")
SAID = [
    (1, "નાટક ભજવવા માટે મંચ જોઈએ (પાનું 202)."), (2, "પ્રેક્ષકો વિના નાટક અધૂરું રહે છે (પાનાં 201-202)"), (3, "મંચ જોઈએ અને નટો હાથી જોઈએ (પાનું 201)"),
    (4, "In short:\nPlain English words (page 201)"), (5, "the lamps were lit (page 14)"), (6, "Anything (page 40)"), (7, "મંચ જોઈએ અને નટો જોઈએ પ્રેક્ષકો વિના નાટક (પાનું 201)"),
]
SHOWN = [*((n, "b:1", "b", WHOLE, 201, 202) for n in (1, 2, 3, 4, 7)), (5, "c:1", "c", "the lamps were lit at nine and all went home", 14, 15), (6, "d:1", "d", "some text", 40, 40)]


def said(spark):
    return rows(spark, SAID, "answer, text")


def shown(spark):
    return rows(spark, SHOWN, "answer, passage, book, text, page_start, page_end")


def page_rows(spark):
    return rows(spark, PAGE_ROWS, "book, page, text")


CLAIMED = [(1, 0, True, "", "b:1"), (2, 0, True, "", "b:1"), (3, 0, False, "હાથી", "b:1"), (4, 1, False, "", "b:1"), (5, 0, True, "", "c:1"), (6, 0, False, "", "d:1"), (7, 0, False, "", "b:1")]


@query("extract_claims", "SELECT answer, line, verbatim, novel, passages FROM " + values(CLAIMED, "answer, line, verbatim, novel, passages"))
def extract_claims(spark, d):
    return claims.extract_claims(said(spark), shown(spark)).select("answer", "line", "verbatim", F.array_join("novel", ",").alias("novel"), F.array_join("passages", ",").alias("passages"))


@query("page_problems", "SELECT answer, problem FROM " + values([(1, "is on 201"), (2, "is on 202"), (4, "cannot establish"), (5, "cannot read"), (7, "is on 201,202")], "answer, problem"))
def page_problems(spark, d):
    return claims.page_problems(said(spark), shown(spark), page_rows(spark)).select("answer", "problem")


MOVED = [(1, "નાટક ભજવવા માટે મંચ જોઈએ (પાનું 201).", "પાનું 202", "પાનું 201"), (2, "પ્રેક્ષકો વિના નાટક અધૂરું રહે છે (પાનું 202)", "પાનાં 201-202", "પાનું 202"), (7, "મંચ જોઈએ અને નટો જોઈએ પ્રેક્ષકો વિના નાટક (પાનાં 201-202)", "પાનું 201", "પાનાં 201-202")]


@query("snap_citations", "SELECT answer, text, old, new FROM " + values(MOVED, "answer, text, old, new"))
def snap_citations(spark, d):
    return claims.snap_citations(said(spark), shown(spark), page_rows(spark)).select("answer", "text", "old", "new")


WORDS = [("કે", "x", True), ("12", "x", True), ("નાટકમાં", "નાટકનો ભાગ", True), ("સ્ટેશન", "સટેશન ખાલી", True), ("તારો", "તારોનો વેશ", True), ("હાથી", "નાટક", False), ("ઘોડો", "ઘોડાગાડી", True), ("ગાડી", "ઘોડાગા", False)]


@query("word_supported", "SELECT word, source, supported FROM " + values(WORDS, "word, source, supported"))
def word_supported(spark, d):
    lost = claims.novel_words(F.array("word"), F.lower(F.col("source")), words_of(F.col("source")))
    return rows(spark, WORDS, "word, source, kept").select("word", "source", (F.size(lost) == 0).alias("supported"))


SHARED = [("મંચ જોઈએ અને નટો હાથી જોઈએ", "નાટક ભજવવા માટે મંચ જોઈએ અને નટો જોઈએ", 0.75), ("મંચ જોઈએ અને નટો હાથી જોઈએ", "રંગમંચ ખાલી હોય", 0.25), ("કે તે 12", "x", None)]


@query("page_overlap_share", "SELECT claim, page, share::DOUBLE AS share FROM " + values(SHARED, "claim, page, share"))
def page_overlap_share(spark, d):
    held = rows(spark, SHARED, "claim, page, share").select("claim", "page", claims.content_words(F.col("claim")).alias("own"), claims.flat(F.col("page")).alias("form"))
    return held.select("claim", "page", claims.support_share(F.col("own"), F.col("form")).alias("share"))


SPANNING = [("the second act began", 2, 3), ("a whole line here", 2, 2), ("nowhere to be found", None, None)]
SPANNED = [(2, "a whole line here and the second"), (3, "act began late")]


@query("span_pages", "SELECT needle, first, last FROM " + values(SPANNING, "needle, first, last"))
def span_pages(spark, d):
    forms = F.array(*[F.struct(F.lit(n).alias("page"), F.lit(t).alias("form")) for n, t in SPANNED])
    found = claims.pages_of(F.col("needle"), F.col("forms"))
    return rows(spark, SPANNING, "needle, first, last").select("needle", forms.alias("forms")).select("needle", F.array_min(found).alias("first"), F.array_max(found).alias("last"))


PRINTED = [
    (1, 1, "ગગન ગાજે રે\n- નરસિંહ મહેતા\nધરતી ઝૂમે રે\n- મીરાં બાઈ"), (1, 2, "અનુક્રમ\nપહેલું ગીત 1\nબીજું ગીત 3\nચોથી વારતા 5"), (1, 3, "પહેલું ગીત\n- હરિલાલ પટેલ\nહરિલાલ નો જન્મ થયો"), (1, 4, "1. કોણ આવ્યું\n2. શું થયું"),
    (1, 5, "બીજું ગીત\n- ઉમાશંકર જોશી\nકવિ પરિચય"), (1, 6, "- કેમ છો?\nમજામાં"), (1, 7, "- સુરેશ દલાલ\nસુરેશ મોટા કવિ"), (1, 8, "છેલ્લો પાઠ\n- રમણ સોની\nરમણ લેખક"),
    (2, 1, "Chapter 1 The Stage\nopening words"), (2, 2, "plain"), (2, 3, "Chapter 2 The Mask\nmore words"), (2, 4, "as told in the book"), (2, 5, "2\nA Stray List"), (2, 6, "3\nThe Lamps\nlast words"), (2, 7, "one more"), (2, 8, "and on"), (2, 9, "end"),
    (3, 1, "વારતા લાંબી\n- ધૂમકેતુ પોતે\nધૂમકેતુ લેખક"), (3, 2, "plain"), (4, 1, "no heading"),
]
CHAPTERS = [
    (1, 0, "પહેલું ગીત", 3, 4), (1, 1, "બીજું ગીત", 5, 6), (1, 2, "ચોથી વારતા", 7, 7), (1, 3, "છેલ્લો પાઠ", 8, 8),
    (2, 0, "Chapter 1 The Stage", 1, 2), (2, 1, "Chapter 2 The Mask", 3, 5), (2, 2, "3. The Lamps", 6, 9), (3, 0, "વારતા લાંબી", 1, 2),
]


@query("detect_chapters", "SELECT book, chapter, title, first, last FROM " + values(CHAPTERS, "book, chapter, title, first, last"))
def detect_chapters(spark, d):
    return chapters.detect_chapters(rows(spark, PRINTED, "book, page, text")).select("book", "chapter", "title", F.col("start").alias("first"), F.col("end").alias("last"))


OPENED = [(1, 10, "A", True), (1, 20, "author", False), (2, 4, "B", True)]
LISTED = [(1, 2, 1, 20, "Named"), (1, 2, 2, 11, "near"), (1, 2, 3, 15, "New"), (1, 2, 4, 16, "near the new")]


@query("toc_fill_in", "SELECT book, start, title FROM " + values([(1, 10, "A"), (1, 15, "New"), (1, 20, "Named"), (2, 4, "B")], "book, start, title"))
def toc_fill_in(spark, d):
    return chapters.fill_in(rows(spark, OPENED, "book, start, title, real"), rows(spark, LISTED, "book, page, at, target, title"))


MARKED = [("one page that  starts here. The second page opens with these words", "one page that starts here. ⟪પાનું 2⟫ The second page opens with these words"), ("The second page opens with these words", "The second page opens with these words"), ("nothing of it", "nothing of it")]


@query("page_markers", "SELECT passage, marked FROM " + values(MARKED, "passage, marked"))
def page_markers(spark, d):
    own = F.array(F.struct(F.lit(2).alias("page"), F.lit("The second page opens with  these words and more").alias("text")), F.struct(F.lit(3).alias("page"), F.lit("short").alias("text")))
    return rows(spark, MARKED, "passage, marked").select("passage", show.page_markers(F.col("passage"), F.lit(1), own).alias("marked"))


COPIED = [("Intro text\n- one\n- two\n# Head", "Intro text\n\n• one\n• two\n\nHead\n\nSources: Book\npp. 3–4, Acts\np. 5")]


@query("answer_as_text", "SELECT answer, copied FROM " + values(COPIED, "answer, copied"))
def answer_as_text(spark, d):
    source = lambda a, b, t: F.struct(F.lit(a).alias("page_start"), F.lit(b).alias("page_end"), F.lit(t).cast("string").alias("chapter_title"))
    return rows(spark, COPIED, "answer, copied").select("answer", show.answer_as_text(F.col("answer"), F.array(source(3, 4, "Acts"), source(5, 5, None)), F.lit("Book")).alias("copied"))


CITED = [("moved (page 12). Next", "moved |page 12|. Next"), ("see page 3, then", "see |page 3|, then"), ("(page 4)", "|page 4|"), ("a (page 1) (page 2) b", "a |page 1| |page 2| b")]


@query("unwrap_cited", "SELECT line, parts FROM " + values(CITED, "line, parts"))
def unwrap_cited(spark, d):
    return rows(spark, CITED, "line, parts").select("line", F.array_join(show.unwrap_cited(show.split_citations(F.col("line"))), "|").alias("parts"))


FAILED = [(0, "", True, "network", True), (401, "", False, "unauthorized", False), (404, "Gone away.", False, "bookMissing", False), (409, "", False, "notReady", False), (400, "Too short!", False, "Too short!", False), (422, "Bad", False, "rejected", False), (413, "", False, "tooLarge", False), (429, "", False, "rateLimited", True), (503, "", False, "unavailable", True), (504, "", False, "timeout", True), (500, "", False, "server", True), (418, "", False, "generic", False)]


@query("describe_error", "SELECT status, said, retry FROM " + values([(f[0], f[3], f[4]) for f in FAILED], "status, said, retry"))
def describe_error(spark, d):
    f = rows(spark, FAILED, "status, message, network, said, retry")
    return f.select("status", show.describe_error(F.col("status"), F.col("message"), F.col("network")).alias("said"), show.can_retry(F.col("status"), F.col("network")).alias("retry"))


SOUGHT = [("abcdefghij", "cdef|efgh|ab", "2-8", "ab[cdefgh]ij"), ("a  b   c d", "a b c", "0-8", "[a  b   c] d"), ("nothing", "here", "", "nothing"), ("tail text", "text", "5-9", "tail [text]")]


@query("find_spans", "SELECT line, spans FROM " + values([(s[0], s[2]) for s in SOUGHT], "line, spans"))
def find_spans(spark, d):
    found = show.find_spans("line", F.split("needles", "\\|"))
    return rows(spark, SOUGHT, "line, needles, spans, marked").select("line", found.alias("s")).select("line", F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans"))


@query("highlight_segments", "SELECT line, marked FROM " + values([(s[0], s[3]) for s in SOUGHT], "line, marked"))
def highlight_segments(spark, d):
    found = rows(spark, SOUGHT, "line, needles, spans, marked").select("line", show.find_spans("line", F.split("needles", "\\|")).alias("s"))
    pieces = show.highlight_segments(F.col("line"), F.col("s"))
    return found.select("line", F.array_join(F.transform(pieces, lambda p: F.when(p["marked"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "").alias("marked"))


PIECES = [
    (1, 0, -1, 1, 5, "front"), (1, 1, 0, 2, 60, "aa"), (1, 2, 0, 3, 60, "bb"), (1, 3, 1, 4, 10, "cc"), (1, 4, 2, 5, 10, "dd"),
    (2, 0, -1, 1, 90, "ee"), (2, 1, -1, 2, 90, "ff"), (2, 2, -1, 3, 90, "gg"), (3, 0, -1, 1, 4, "  "),
]
NAMED = [(1, 0, "First", 2, 3), (1, 1, "Second", 4, 4), (1, 2, "Third", 5, 5), (1, 3, "Bare", 6, 6)]
KEPT = [(1, 1, "kept")]
TOLD = [
    (1, 0, "First", 2, 3, "reduce First: map First: aa + map First: bb", False), (1, 1, "Second", 4, 4, "kept", True), (1, 2, "Third", 5, 5, "map Third: dd", False),
    (2, 0, "Section 1 (pages 1-2)", 1, 2, "reduce Section 1 (pages 1-2): map Section 1 (pages 1-2): ee + map Section 1 (pages 1-2): ff", False), (2, 1, "Section 2 (pages 3-3)", 3, 3, "map Section 2 (pages 3-3): gg", False),
    (3, 0, "Section 1 (pages 1-1)", 1, 1, "", False),
]


def echo(kind: str, label: str, parts: list[str]) -> str:
    """A stand-in for a model that shows what it was given."""
    return f"{kind} {label}: {' + '.join(parts)}"


@query("summarise_chapters", "SELECT book, chapter, title, summary, cached FROM " + values(TOLD, "book, chapter, title, first, last, summary, cached"))
def summarise_chapters(spark, d):
    made = summaries.summarise_chapters(rows(spark, PIECES, "book, pos, chapter, page_start, tokens, text"), rows(spark, NAMED, "book, chapter, title, start, end"), rows(spark, KEPT, "book, chapter, summary"), echo, 100)
    return made.select("book", "chapter", "title", "summary", "cached")


@query("summarise_books", "SELECT book, summary, built_from FROM " + values([(1, "book Acts: one + two", 2), (2, "alone", 1)], "book, summary, built_from"))
def summarise_books(spark, d):
    told = rows(spark, [(1, 1, "two"), (1, 0, "one"), (2, 0, "alone"), (2, 1, ""), (3, 0, "")], "book, chapter, summary")
    return summaries.summarise_books(told, rows(spark, [(1, "Acts")], "book, title"), echo)


SENT = {m[0]: m[1] for m in MOVED}
VERIFIED = [(n, SENT.get(n, t), n not in (4, 5), {4: "cannot establish", 5: "cannot read"}.get(n, "")) for n, t in SAID]


@query("verify_answers", "SELECT answer, text, grounded, problems FROM " + values(VERIFIED, "answer, text, grounded, problems"))
def verify_answers(spark, d):
    return claims.verify(said(spark), shown(spark), page_rows(spark)).withColumn("problems", F.array_join("problems", "|"))
