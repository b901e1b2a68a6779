"""Queries over small inline rows, mostly Gujarati, that the tables do not have."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import answers, headings, text
from quire.operators import asking, chapters, claims, grounding
from quire.plans.registry import query, values

WORDS = [("નાટક ભજવાયું", "નાટક"), ("The plain stage", "stage"), ("નટોની વાત page 12", "નટો"), ("k દી", "b"), ("પ્રકરણ 3 નાટકના પ્રકારો", "x"), ("", "y")]
W = values(WORDS, "line, other")
GU, LATIN = r"length(regexp_replace(line, '[^\x{0A80}-\x{0AFF}]+', '', 'g'))", "length(regexp_replace(line, '[^A-Za-z]+', '', 'g'))"


def rows(spark, data, names):
    kinds = ", ".join(f"{n.strip()} {'array<int>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names.split(","), max(data, key=lambda r: sum(x is not None for x in r))))
    return spark.createDataFrame(data, kinds)


@query("detect_language", f"SELECT line, CASE WHEN {GU} > 0 THEN 'gujarati' ELSE 'english' END AS language FROM {W}")
def detect_language(spark, d):
    return rows(spark, WORDS, "line, other").select("line", text.language(F.col("line")).alias("language"))


@query("script_majority", f"SELECT line, {GU} > {LATIN} AS gujarati FROM {W}")
def script_majority(spark, d):
    return rows(spark, WORDS, "line, other").select("line", text.mostly_gujarati(F.col("line")).alias("gujarati"))


@query("script_share", f"SELECT line, round(coalesce({GU} / nullif({GU} + {LATIN}, 0)::DOUBLE, 0), 6) AS share FROM {W}")
def script_share(spark, d):
    return rows(spark, WORDS, "line, other").select("line", F.round(text.script_share(F.col("line")), 6).alias("share"))


TITLES = [("My Book", "a.pdf"), ("a_b", "a_b.pdf"), ("", "x_y-z.PDF"), (None, ".pdf"), ("  ", "plain")]


@query("display_title", "SELECT filename, CASE WHEN trim(coalesce(title, '')) NOT IN ('', regexp_replace(filename, '\\.pdf$', '', 'i')) THEN trim(title) ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(filename, '\\.pdf$', '', 'i'), '[_\\-]+', ' ', 'g')), ''), filename) END AS shown FROM " + values(TITLES, "title, filename"))
def display_title(spark, d):
    return rows(spark, TITLES, "title, filename").select("filename", text.display_title(F.col("title"), F.col("filename")).alias("shown"))


@query("usable_title", f"SELECT line, {GU} >= 4 AND length(regexp_replace(line, '[^\\p{{L}}\\x{{0A80}}-\\x{{0AFF}}]', '', 'g')) >= 0.6 * length(replace(line, ' ', '')) AND length(line) <= 60 AS usable FROM {W}")
def usable_title(spark, d):
    return rows(spark, WORDS, "line, other").select("line", headings.usable_title(F.col("line")).alias("usable"))


@query("plausible_title", r"SELECT line, length(line) BETWEEN 1 AND 80 AND NOT regexp_matches(line, '[।.]\s+\S') AND len(string_split(line, ' ')) <= 12 AND NOT regexp_matches(line, '^[0-9૦-૯]') AND regexp_matches(line, '\p{L}') AND len(list_filter(string_split(line, ' '), lambda w: NOT regexp_matches(w, '[\p{L}\x{0A80}-\x{0AFF}]'))) = 0 AND NOT (regexp_matches(line, '[\x{0A80}-\x{0AFF}]') AND len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^[A-Za-z]$'))) > 0) AS plausible FROM " + values([(a,) for a, _ in WORDS] + [("9. નટ",), ("One. Two",), ("Good title",)], "line"))
def plausible_title(spark, d):
    return rows(spark, [(a,) for a, _ in WORDS] + [("9. નટ",), ("One. Two",), ("Good title",)], "line").select("line", headings.plausible_title(F.col("line")).alias("plausible"))


HEADS = [("Chapter 3 The stage",), ("પ્રકરણ ૬ ઘરભણી",), ("૭. સાંજ",), ("5.2 તારા",), ("plain words here",), ("12 ",)]


@query("parse_heading", r"SELECT line, line AS title, CASE WHEN regexp_matches(line, '(?i)^(chapter|પ્રકરણ)') THEN 1 WHEN regexp_matches(line, '^[0-9૦-૯]+\.[0-9૦-૯]+ ') THEN 2 WHEN regexp_matches(line, '^[0-9૦-૯]+\. ') THEN 1 END AS level, translate(regexp_extract(line, '[0-9૦-૯]+'), '૦૧૨૩૪૫૬૭૮૯', '0123456789')::INT AS number FROM " + values(HEADS[:4], "line"))
def parse_heading(spark, d):
    h = rows(spark, HEADS, "line").withColumn("h", headings.parse_heading(F.col("line"))).where("h is not null")
    return h.select("line", "h.level", "h.number", "h.title")


BY = [("- ઉમાશંકર જોશી",), ("– Plain Name",), ("નાટક",), ("— “કવિ કલાપી”",)]


@query("byline_name", r"SELECT line, CASE WHEN regexp_matches(line, '^[-–—]') AND regexp_matches(line, '[\x{0A80}-\x{0AFF}]') THEN regexp_extract(line, '^[-–—]\s*“?([^”]+)”?$', 1) END AS name FROM " + values(BY, "line"))
def byline_name(spark, d):
    return rows(spark, BY, "line").select("line", headings.byline_name(F.col("line")).alias("name"))


TOC = [("દરિયાની સફર ! 7",), ("સાંજનો છેલ્લો દીવો... ૨૧૫",), ("plain words 31",), ("દરિયાની સફર",)]


@query("toc_entries", r"SELECT regexp_extract(line, '^(.*?)[\s.…·]*\s[0-9૦-૯]{1,3}$', 1) AS title, translate(regexp_extract(line, '([0-9૦-૯]{1,3})$', 1), '૦૧૨૩૪૫૬૭૮૯', '0123456789')::INT AS page FROM " + values(TOC, "line") + r" WHERE regexp_matches(line, '[\x{0A80}-\x{0AFF}].*\s[0-9૦-૯]{1,3}$')")
def toc_entries(spark, d):
    return rows(spark, TOC, "line").select(headings.contents_line(F.col("line")).alias("c")).where("c is not null").select("c.*")


PAIRS = [("દરિયાની સફર", "દરિયાની સફર, ફરી!"), ("The River", "river"), ("--", "b"), ("Lamp", "A Lamp")]


@query("toc_title_match", r"SELECT a, b, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS same FROM (SELECT a, b, regexp_replace(a, '[^\p{L}\p{N}]+', '', 'g') AS x, regexp_replace(b, '[^\p{L}\p{N}]+', '', 'g') AS y FROM " + values(PAIRS, "a, b") + ")")
def toc_title_match(spark, d):
    return rows(spark, PAIRS, "a, b").select("a", "b", headings.same_title(F.col("a"), F.col("b")).alias("same"))


VOTES = [(1, 5, 3, "દરિયાની સફર"), (1, 9, 7, "સાંજનો દીવો"), (1, 20, 17, "ત્રીજી વાત"), (2, 4, 4, "એકલી વાત"), (3, 8, 2, "પહેલી વાત"), (3, 9, 2, "બીજી વાત"), (4, 6, 5, "ચાર રસ્તા"), (4, 9, 8, "પાંચ દીવા"), (4, 12, 9, "છ નદીઓ"), (4, 15, 12, "સાત તારા")]


@query("toc_offset_vote", f"WITH v AS (SELECT book, start - printed AS delta, count(*) AS n, min(start) AS first FROM {values(VOTES, 'book, start, printed, title')} GROUP BY 1, 2) SELECT book, delta FROM v WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, first) = 1")
def toc_offset_vote(spark, d):
    v = rows(spark, VOTES, "book, start, printed, title")
    entries = v.select("book", F.lit(1).alias("page"), F.col("start").alias("at"), "printed", "title")
    return chapters.page_offset(v.select("book", "start", "title", F.lit(True).alias("real")), entries)


DIGITS = [("૪૨",), ("17",), ("x",), ("૧a",)]


@query("to_int", f"SELECT d, TRY_CAST(translate(d, '૦૧૨૩૪૫૬૭૮૯', '0123456789') AS INT) AS n FROM {values(DIGITS, 'd')}")
def to_int(spark, d):
    return rows(spark, DIGITS, "d").select("d", text.to_int(F.col("d")).alias("n"))


FORMS = [("“A   lamp,”",), ("an unfold- ing story.",), ("‘દીવો’ બળે।",), ("",)]


@query("normalize_text", r"SELECT line, trim(regexp_replace(line, '\s+', ' ', 'g')) AS form FROM " + values(FORMS, "line"))
def normalize_text(spark, d):
    return rows(spark, FORMS, "line").select("line", text.normalize(F.col("line")).alias("form"))


@query("match_form", r"SELECT line, trim(regexp_replace(translate(trim(regexp_replace(line, '\s+', ' ', 'g')), '“”‘’" + '"' + r"«»', ''''''''''''''''), '([A-Za-z])-\s+([a-z])', '\1\2', 'g'), ' .,;:!?।|-–—''') AS form FROM " + values(FORMS, "line"))
def match_form(spark, d):
    return rows(spark, FORMS, "line").select("line", text.match_form(F.col("line")).alias("form"))


STEMS = [("નટોની",), ("નાટકમાં",), ("માં",), ("સ્ટેજ",), ("વાતો",)]
_CASES = " ".join(f"WHEN ends_with(w, '{s}') AND length(w) >= {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in sorted(text.SUFFIXES, key=len, reverse=True))


@query("stem", f"SELECT w, CASE {_CASES} ELSE w END AS stem FROM (SELECT regexp_replace(w0, '^ +', '') AS w FROM {values(STEMS, 'w0')})")
def stem(spark, d):
    return rows(spark, STEMS, "w").select("w", text.stem(F.col("w")).alias("stem"))


ASKED = [("What is the stage?",), ("નાટક એટલે શું?",), ("who are",), ("Tell me about masks",)]
_QW = ", ".join(f"'{w}'" for w in text.QUESTION_WORDS)


@query("keyword_only", rf"SELECT q, coalesce(nullif(trim(array_to_string(list_filter(string_split(q, ' '), lambda w: lower(trim(w, '?।,.')) NOT IN ({_QW})), ' '), '?। '), ''), q) AS k FROM {values(ASKED, 'q')}")
def keyword_only(spark, d):
    return rows(spark, ASKED, "q").select("q", text.keywords(F.col("q")).alias("k"))


CITES = [("Yes (page 202).",), ("(pages 201–202)",), ("(પાનું ૪૨, પ્રકરણ 3)",), ("none",), ("(pages 12–14, 20)",), ("see page 3, then p. 5 - or not",)]


@query("cited_pages", "SELECT line, pages FROM " + values([(CITES[0][0], "202"), (CITES[1][0], "201,202"), (CITES[2][0], "42"), (CITES[3][0], ""), (CITES[4][0], "12,14,20"), (CITES[5][0], "3,5")], "line, pages"))
def cited_pages(spark, d):
    return rows(spark, CITES, "line").select("line", F.array_join(answers.cited_pages(F.col("line")).cast("array<string>"), ",").alias("pages"))


LISTS = [("12–14, 20",), ("૪૨",), ("5-2",), ("1-100",), ("3, 3",)]


@query("parse_pages", "SELECT line, array_to_string(list_distinct_ordered, ',') AS pages FROM (SELECT line, CASE WHEN line = '12–14, 20' THEN range(12, 15) || [20] WHEN line = '5-2' THEN [5, 2] WHEN line = '1-100' THEN [1, 100] ELSE [translate(regexp_extract(line, '[0-9૦-૯]+'), '૦૧૨૩૪૫૬૭૮૯', '0123456789')::BIGINT] END AS list_distinct_ordered FROM " + values(LISTS, "line") + ")")
def parse_pages(spark, d):
    return rows(spark, LISTS, "line").select("line", F.array_join(answers.parse_pages(F.col("line")).cast("array<string>"), ",").alias("pages"))


SAID = [("He said “the stage is bare” and ‘it was so quiet’ then",), ('A "plain quoted text" here',), ("don't won't can't",)]


@query("quotes", r"""SELECT line, array_to_string(list_transform(regexp_extract_all(line, '“[^“”]{8,}”|"[^"]{8,}"'), lambda s: s[2:-2]) || regexp_extract_all(regexp_replace(line, '“[^“”]{8,}”|"[^"]{8,}"', ' ', 'g'), '‘([^‘’“”"]{8,})’', 1), '|') AS spans FROM """ + values(SAID, "line"))
def quotes(spark, d):
    return rows(spark, SAID, "line").select("line", F.array_join(answers.quotes(F.col("line")), "|").alias("spans"))


@query("quoted_spans", r"""SELECT line, array_to_string(list_transform(regexp_extract_all(line, '[“"«][^”"»]{4,}[”"»]|‘[^’]{4,}’'), lambda s: trim(s[2:-2])), '|') AS spans FROM """ + values(SAID, "line"))
def quoted_spans(spark, d):
    return rows(spark, SAID, "line").select("line", F.array_join(answers.quoted_spans(F.col("line")), "|").alias("spans"))


@query("split_citations", r"SELECT line, unnest(range(len(p))) AS n, unnest(p) AS part FROM (SELECT line, list_filter(string_split(regexp_replace(line, '(?i)((?:પાનું|પાનાં|પાના|પૃષ્ઠ|pages?|p\.)\s*[0-9૦-૯](?:[0-9૦-૯\s,\-‐‑–—]*[0-9૦-૯])?)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM " + values(CITES, "line") + ")")
def split_citations(spark, d):
    return rows(spark, CITES, "line").select("line", F.posexplode(answers.split_citations(F.col("line"))).alias("n", "part"))


SOURCED = [("The stage was bare — “મંચ ખાલી હતો” (page 3)",), ("No quote",), ("Latin “only this”",)]


@query("split_source_quote", r"SELECT line, regexp_extract(line, '^(.*?)\s*—?\s*“', 1) AS point, regexp_extract(line, '“([^”]*)”', 1) AS quote, trim(regexp_extract(line, '”(.*)$', 1)) AS rest FROM " + values(SOURCED, "line") + r" WHERE regexp_matches(line, '“[^”]*[\x{0A80}-\x{0AFF}][^”]*”')")
def split_source_quote(spark, d):
    return rows(spark, SOURCED, "line").withColumn("s", answers.split_source_quote(F.col("line"))).where("s is not null").select("line", "s.*")


OVERLAPS = [("one two three four", "three four five"), ("alpha", "beta"), ("abc shared tail text", "shared tail text goes on"), ("short ab", "ab x")]


@query("join_overlapping", "SELECT a, b, CASE WHEN p IS NULL THEN a || ' ' || b ELSE left(a, p - 1) || b END AS joined FROM (SELECT a, b, list_min(list_filter(range(1, length(a) - 6), lambda p: length(b) >= 8 AND starts_with(b, substr(a, p)))) AS p FROM " + values(OVERLAPS, "a, b") + ")")
def join_overlapping(spark, d):
    return rows(spark, OVERLAPS, "a, b").select("a", "b", text.join_overlapping(F.col("a"), F.col("b")).alias("joined"))


LABELS = [([4], False), ([3, 4, 5], False), ([3, 7], False), ([2], True), ([5, 6], True)]


@query("page_label", "SELECT label FROM " + values([("page 4",), ("pages 3-5",), ("pages 3, 7",), ("પાનું 2",), ("પાનાં 5-6",)], "label"))
def page_label(spark, d):
    return rows(spark, LABELS, "pages, gu").select(answers.page_label(F.col("pages"), F.col("gu")).alias("label"))


@query("excerpt", r"SELECT line, trim(regexp_replace(regexp_replace(regexp_replace(line, '(?i)\s*\((?:પાનું|પાનાં|પાના|પૃષ્ઠ|pages?|p\.)[^)]*\)', '', 'g'), '[#*_>`]', '', 'g'), '\s+', ' ', 'g')) AS short FROM " + values([*CITES, ("**Bold** _x_  (page 3)",)], "line"))
def excerpt(spark, d):
    return rows(spark, [*CITES, ("**Bold** _x_  (page 3)",)], "line").select("line", answers.excerpt(F.col("line")).alias("short"))


ROUTES = [(2, False, 0, 5), (0, False, 0, 5), (0, False, 0, 0), (0, True, 1, 5), (0, True, 2, 5)]


@query("route_after_grade", f"SELECT relevant, widened, attempts, documents, CASE WHEN relevant >= 1 THEN 'generate' WHEN NOT widened AND documents > 0 THEN 'widen' WHEN attempts < 2 THEN 'rewrite' ELSE 'fallback' END AS next FROM {values(ROUTES, 'relevant, widened, attempts, documents')}")
def route_after_grade(spark, d):
    return rows(spark, ROUTES, "relevant, widened, attempts, documents").withColumn("next", answers.route_after_grade(F.col("relevant"), F.col("widened"), F.col("attempts"), F.col("documents")))


RETRIES = [(429, 8.0, False, 0), (503, None, False, 0), (503, None, False, 1), (429, None, False, 0), (404, None, False, 0), (429, None, True, 0), (429, 120.0, False, 0), (None, None, False, 2)]


@query("retry_delay", f"SELECT status, hint, daily, attempt, CASE WHEN (status IS NULL OR status IN (408, 429, 500, 502, 503, 504)) AND NOT daily AND d <= 60 THEN d END AS delay FROM (SELECT *, CASE WHEN hint IS NOT NULL THEN greatest(hint, 2 * 2.0 ** attempt) WHEN status = 429 THEN greatest(10, 2 * 2.0 ** attempt) ELSE 2 * 2.0 ** attempt END::DOUBLE AS d FROM (SELECT status, hint::DOUBLE AS hint, daily, attempt FROM {values(RETRIES, 'status, hint, daily, attempt')}))")
def retry_delay(spark, d):
    return rows(spark, RETRIES, "status, hint, daily, attempt").withColumn("delay", answers.retry_delay(F.col("status"), F.col("hint"), F.col("daily"), F.col("attempt")))


PEOPLE = [("Asha Rao", "a@x.org"), ("", "meera@y.in"), (None, "plain")]


@query("display_name", f"SELECT email, coalesce(nullif(trim(full_name), ''), split_part(email, '@', 1)) AS shown, upper(left(coalesce(nullif(trim(full_name), ''), split_part(email, '@', 1)), 1)) AS initial FROM {values(PEOPLE, 'full_name, email')}")
def display_name(spark, d):
    shown = answers.display_name(F.col("full_name"), F.col("email"))
    return rows(spark, PEOPLE, "full_name, email").select("email", shown.alias("shown"), answers.initial_of(shown).alias("initial"))


MAILS = [("a@b.co",), ("",), ("no at",), ("a@b",)]


@query("form_checks", rf"SELECT email, CASE WHEN trim(email) = '' THEN 'required' WHEN NOT regexp_matches(trim(email), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'invalid' END AS problem FROM {values(MAILS, 'email')}")
def form_checks(spark, d):
    return rows(spark, MAILS, "email").select("email", answers.email_problem(F.col("email")).alias("problem"))


REPLIES = [("```json\n{\"a\": 1}\n```",), ("Sure: {\"a\": 2} ok",), ("list [1, 2]",), ("nothing",)]


@query("parse_llm_json", r"SELECT reply, coalesce(nullif(regexp_extract(reply, '(?s)(\{.*\})', 1), ''), nullif(regexp_extract(reply, '(?s)(\[.*\])', 1), '')) AS json FROM " + values(REPLIES, "reply"))
def parse_llm_json(spark, d):
    return rows(spark, REPLIES, "reply").select("reply", answers.parse_llm_json(F.col("reply")).alias("json"))


GRADES = [
    (1, '{"grades": [{"passage": 1, "relevant": true}, {"passage": 2, "relevant": false}, {"passage": 7, "relevant": true}, {"passage": 0, "relevant": true}]}', 3), (2, "not json", 2),
    (3, '{"grades": [{"passage": 3, "relevant": "false"}, {"passage": 2, "relevant": 0}, {"passage": 9, "relevant": "False"}, {"passage": 1, "relevant": 1}]}', 3),
    (4, '```json\n[{"passage": "2", "relevant": true}, 5, {"relevant": true}]\n```', 2), (5, '{"grades": [{"passage": null, "relevant": true}]}', 2), (6, '{"grades": []}', 4), (7, None, 1), (8, "{}", 0),
]
#: Kept, in the reply's order: a text counts as true whatever it says, zero does not; what cannot be read keeps all.
GRADED = [(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 0, 3), (3, 1, 1), (4, 0, 2), (5, 0, 1), (5, 1, 2), (7, 0, 1)]


@query("apply_grades", "SELECT question, place, passage FROM " + values(GRADED, "question, place, passage"))
def apply_grades(spark, d):
    return asking.apply_grades(rows(spark, GRADES, "question, reply, n"))


VERDICTS = [(1, True), (2, False), (3, None)]


@query("claim_verdicts", f"SELECT claim, coalesce(supported, false) AS supported FROM {values(VERDICTS, 'claim, supported')}")
def claim_verdicts(spark, d):
    return rows(spark, VERDICTS, "claim, supported").select("claim", F.coalesce("supported", F.lit(False)).alias("supported"))


ANSWERS = [
    (1, "Intro:\nThe stage held 12 lamps (page 3).\nNo citation here"), (2, "It was “the bare stage” (page 9).\n1. ok (page 4)"), (3, "They said “the bare stage was cold” (page 3)"), (4, "A “stage was cold and the lamps” (page 4)"),
    (5, "It was “the bear stage was cold” (page 5) in 1999"), (6, "નાટક Hamlet વિશે “stage lights went out” છે (પાનું 3)\nઅને બીજું વાક્ય અહીં છે (પાનું 3, પ્રકરણ 2)"),
]
PASSAGES = [
    (1, "a", "The stage held 12 lamps", 3, 4, "Lamps"), (2, "b", "It was the bare stage", 4, 5, ""), (3, "c", "the bare stage was cold", 5, 5, ""), (3, "d", "something else", 3, 3, ""), (4, "e", "a stage was cold", 4, 4, ""), (4, "f", "and the lamps", 4, 4, ""),
    (5, "g", "It was the bare stage was cold.", 5, 5, ""), (6, "h", "the stage lights went out", 3, 3, "Scene"),
]


def told(spark):
    return rows(spark, PASSAGES, "answer, passage, text, page_start, page_end, chapter_title")


@query("claim_lines", "SELECT answer, line, pages FROM " + values([(1, 1, "3"), (1, 2, ""), (2, 0, "9"), (2, 1, "4"), (3, 0, "3"), (4, 0, "4"), (5, 0, "5"), (6, 0, "3"), (6, 1, "3")], "answer, line, pages"))
def claim_lines(spark, d):
    return grounding.claim_lines(rows(spark, ANSWERS, "answer, text")).select("answer", "line", F.array_join(F.col("cited").cast("array<string>"), ",").alias("pages"))


CHECKED = [
    (1, 2, "no citation"), (2, 0, "page not shown: 9"), (2, 0, "quote is on pages [4, 5], not the cited [9]: the bare stage"), (3, 0, "quote is on pages [5], not the cited [3]: the bare stage was cold"),
    (4, 0, "quote not in passages: stage was cold and the lamps"), (5, -1, "not in passages: 1999"), (6, -1, "not in passages: 2"), (6, -1, "not in passages: Hamlet"),
]


@query("check_answer", "SELECT answer, line, problem FROM " + values(CHECKED, "answer, line, problem"))
def check_answer(spark, d):
    return grounding.check_answers(rows(spark, ANSWERS, "answer, text"), told(spark))


@query("mend_quotes", "SELECT answer, text FROM " + values([(n, t.replace("the bear stage", "the bare stage")) for n, t in ANSWERS], "answer, text"))
def mend_quotes(spark, d):
    said = rows(spark, ANSWERS, "answer, text")
    return grounding.mend_quotes(said, grounding.quote_findings(said, told(spark)))


SNAPS = [("the bare stage", "It was the bare stage then"), ("the bear stage", "It was the bare stage then"), ("a wholly other text", "It was the bare stage then")]


@query("quote_snap", "SELECT quote, snapped FROM " + values([(SNAPS[0][0], "the bare stage"), (SNAPS[1][0], "the bare stage"), (SNAPS[2][0], None)], "quote, snapped"))
def quote_snap(spark, d):
    return grounding.snap_quotes(rows(spark, SNAPS, "quote, source")).select("quote", "snapped")


#: By difflib's ratio over all spans; the SQL form has no such function, so it states the spans.
NEAREST = [(SNAPS[0][0], "the bare stage"), (SNAPS[1][0], "the bare stage"), (SNAPS[2][0], " was the bare st")]


@query("closest_span", "SELECT quote, span FROM " + values(NEAREST, "quote, span"))
def closest_span(spark, d):
    return rows(spark, SNAPS, "quote, source").select("quote", grounding.closest_span(F.col("quote"), F.col("source")).alias("span"))


@query("edit_measure", "SELECT a, b, n FROM " + values([("abc", "abd", 1), ("abc", "abc", 0), ("stage", "stages", 1)], "a, b, n"))
def edit_measure(spark, d):
    return rows(spark, [("abc", "abd"), ("abc", "abc"), ("stage", "stages")], "a, b").select("a", "b", grounding.edit_measure("a", "b").alias("n"))


CLAIMS = [(1, "“the lamps were lit at nine” (page 1)"), (2, "“nobody came to the second act” (page 1)"), (3, "“nothing of the kind here” (page 1)"), (4, "“an unreadable page follows” (page 3)"), (5, "anything at all (page 6)")]
HELD = [*((n, "p", "b", "Then the lamps were lit at nine and nobody came to the second act of it", 1, 2) for n in (1, 2, 3)), (4, "q", "b", "an unreadable page follows", 3, 4), (5, "r", "b", "anything", 6, 6)]
PAGE_ROWS = [("b", 1, "Then the lamps were lit at nine and nobody came"), ("b", 2, "to the second act of it"), ("b", 3, "an unreadable page follows"), ("b", 4, None), ("b", 6, "anything")]


@query("locate_pages", "SELECT answer, passage, pages FROM " + values([(1, "p", "1"), (2, "p", "1,2"), (3, "p", ""), (4, "q", None), (5, "r", "6")], "answer, passage, pages"))
def locate_pages(spark, d):
    found = claims.located(rows(spark, CLAIMS, "answer, text"), rows(spark, HELD, "answer, passage, book, text, page_start, page_end"), rows(spark, PAGE_ROWS, "book, page, text"))
    return found.select("answer", "passage", F.array_join(F.col("located").cast("array<string>"), ",").alias("pages"))


@query("unsupported_words", "SELECT answer, word FROM " + values([(1, "Hamlet"), (3, "Hamlet")], "answer, word"))
def unsupported_words(spark, d):
    data = [(1, "નાટકમાં Hamlet ની વાત છે અને stage છે", "the stage"), (2, "plain English words only", "x"), (3, "નાટક અને બીજું ઘણું છે\nHamlet 'stage' pages", "the stage"), (4, "Short words “આ ગુજરાતી અવતરણ ઘણું લાંબું છે” only", "x")]
    return rows(spark, data, "answer, text, corpus").select("answer", F.explode(grounding.missing_words(F.col("text"), F.col("corpus"))).alias("word"))


UPLOADS = [("a.pdf", 100), ("b.txt", 100), ("c.PDF", 60_000_000), ("d.pdf", 0)]


@query("upload_validation", f"SELECT name, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 400 WHEN size > 52428800 THEN 413 WHEN size = 0 THEN 400 ELSE 202 END AS status FROM {values(UPLOADS, 'name, size')}")
def upload_validation(spark, d):
    from quire.sources.books import upload_status

    return rows(spark, UPLOADS, "name, size").select("name", upload_status(F.col("name"), F.col("size")).alias("status"))


SORTED = [("chapter 10",), ("chapter 9",), ("નાટક 2",), ("Alpha",)]


@query("title_order", "SELECT title, place FROM " + values([("નાટક 2", 1), ("Alpha", 2), ("chapter 9", 3), ("chapter 10", 4)], "title, place"))
def title_order(spark, d):
    from pyspark.sql import Window

    padded = F.regexp_replace(F.regexp_replace("title", r"(\d+)", "00000000$1"), r"0*(\d{8})(?!\d)", "$1")
    key = F.collate(padded, "gu_CI_AI")
    return rows(spark, SORTED, "title").select("title", F.row_number().over(Window.orderBy(key, "title")).alias("place"))


CASES = [("q1", None), ("q2", ""), ("q3", "b1"), ("q4", "b2")]


@query("load_cases", f"SELECT question FROM {values(CASES, 'question, doc_id')} WHERE doc_id IS NULL OR doc_id IN ('', 'b1')")
def load_cases(spark, d):
    from quire.sources.books import cases_of

    return cases_of(rows(spark, CASES, "question, doc_id"), "b1").select("question")


STARTS = [("First act", 2), (None, 2), ("x" * 70, 1), ("દરિયાની સફર", 1)]
# The questions that start on any book.
FIRST_QUESTIONS = ["આ પુસ્તકનાં મુખ્ય પાત્રો કોણ છે?", "આ પુસ્તકનો મુખ્ય વિચાર શો છે?", "What is this book about, in brief?"]
_ASKED = " || '|' || ".join(f"'{q}'" for q in FIRST_QUESTIONS)


@query("starter_questions", rf"SELECT title, CASE WHEN length(title) <= 60 THEN CASE WHEN regexp_matches(title, '[\x{{0A80}}-\x{{0AFF}}]') THEN '“' || title || '” પ્રકરણમાં શું બને છે?' ELSE 'What happens in “' || title || '”?' END || '|' ELSE '' END || {_ASKED} AS questions FROM {values(STARTS, 'title, k')}")
def starter_questions(spark, d):
    first = F.when(F.length("title") <= 60, F.when(text.language(F.col("title")) == "gujarati", F.concat(F.lit("“"), "title", F.lit("” પ્રકરણમાં શું બને છે?"))).otherwise(F.concat(F.lit("What happens in “"), "title", F.lit("”?"))))
    asked = F.slice(F.array_compact(F.array(first, *map(F.lit, FIRST_QUESTIONS))), 1, 4)
    return rows(spark, STARTS, "title, k").select("title", F.array_join(asked, "|").alias("questions"))


PASSWORDS = [("", "", "required", "required"), ("short", "short", "tooShort", None), ("long enough", "other", None, "mismatch"), ("long enough", "long enough", None, None)]


@query("password_checks", "SELECT password, again, problem, confirm FROM " + values(PASSWORDS, "password, again, problem, confirm"))
def password_checks(spark, d):
    p = rows(spark, PASSWORDS, "password, again, problem, confirm").select("password", "again")
    return p.select("password", "again", answers.password_problem(F.col("password")).alias("problem"), answers.confirm_problem(F.col("password"), F.col("again")).alias("confirm"))


REFUSED = [("invalid_credentials", 400, "invalidCredentials"), ("email_exists", 422, "userExists"), ("over_request_rate_limit", 400, "rateLimited"), (None, 429, "rateLimited"), (None, 0, "network"), ("odd", 500, "generic")]


@query("auth_errors", "SELECT code, status, said FROM " + values(REFUSED, "code, status, said"))
def auth_errors(spark, d):
    return rows(spark, REFUSED, "code, status, said").select("code", "status", answers.describe_auth_error(F.col("code"), F.col("status")).alias("said"))
