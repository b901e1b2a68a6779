"""Behaviour that the tables do not show: packing, admission, cleaning, stores."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import grounding, store
from quire.operators.grouped import admit, pack


def greedy(sizes: list[int], size: int, overlap: int) -> list[list[int]]:
    """Packing unit by unit: what the windows should be."""
    windows, now = [], []
    for i, n in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + n > size:
            windows.append(now)
            now = next(now[k:] for k in range(len(now) + 1) if sum(sizes[j] for j in now[k:]) <= overlap)
        now = [*now, i]
    return [*windows, now] if now else windows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(20, 80), st.integers(0, 19))
def test_pack_is_greedy(sizes, size, overlap):
    assert [list(range(a, b)) for a, b in pack(sizes, size, overlap)] == greedy(sizes, size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30), st.integers(1, 4), st.integers(1, 20))
def test_admission_is_a_sliding_window(gaps, limit, span):
    now, held, want = 0, [], []
    for g in gaps:
        now += g
        held = [t for t in held if now - t < span]
        want.append((len(held) < limit, 0 if len(held) < limit else (span - (now - held[0])) // 60 + 1))
        held += [now] if len(held) < limit else []
    assert admit([sum(gaps[: i + 1]) for i in range(len(gaps))], limit, span) == want


def test_pack_refuses_an_overlap_of_its_size():
    with pytest.raises(ValueError):
        pack([1], 10, 10)


def test_admission_forgets_refused_calls():
    assert [ok for ok, _ in admit([0, 1, 2, 3600, 3600.5], 2, 3600)] == [True, True, False, True, False]


def test_clean_text(spark):
    raw = "A​b  c\r\nhy-\nphen \x00 d\n\n\n\né "
    row = spark.createDataFrame([(raw,), (None,)], "t string").select(text.clean_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in row] == ["Ab c\nhyphen d\n\né", ""]


def test_replace_clears_an_owner_without_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    left = store.replace_partition(t, t.limit(0), t.where("k = 1"), "k")
    assert [r.k for r in left.collect()] == [2]


def test_append_vectors_needs_partners(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.5)], "k int, v double")
    with pytest.raises(Exception, match="differ in length"):
        store.append_vectors(a, b, "k").collect()


def test_edit_measure_is_never_below_levenshtein():
    assert grounding.edits("kitten", "sitting") >= 3
    assert grounding.edits("same", "same") == 0


def test_scan_pages(spark, tmp_path):
    from quire.sources.books import read_cases, scan_pages

    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    pages = scan_pages(spark, str(tmp_path), lambda data: data.decode().split("\x0c"))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(1, "one"), (2, "two")]
    (tmp_path / "c.json").write_text('{"cases": [{"question": "q", "doc_id": ""}]}')
    assert read_cases(spark, str(tmp_path / "c.json")).count() == 1


def test_contents_fill_in_order():
    from quire.operators.chapters import complete

    done = complete({10: ("A", True), 20: ("author", False)}, [(20, "Named"), (10, "other"), (15, "New"), (16, "near the new"), (9, "near")])
    assert done == {10: ("A", True), 20: ("Named", True), 15: ("New", True)}


def test_no_chapters_from_blank_or_missing_pages(spark):
    from quire.operators.chapters import detect_chapters

    pages = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, " \n ")], "book int, page int, text string")
    assert detect_chapters(pages).count() == 0
    assert detect_chapters(pages.limit(0)).count() == 0


def test_headings_on_every_page_are_noise(spark):
    from quire.operators.chapters import detect_chapters

    pages = spark.createDataFrame([(1, n, f"Chapter {n} Words\ntext") for n in range(1, 10)], "book int, page int, text string")
    assert detect_chapters(pages).count() == 0


def test_claims_without_passages_and_empty_answers(spark):
    from quire.operators.claims import extract_claims, page_problems, snap_citations

    answers = spark.createDataFrame([(1, "A line (page 9)"), (2, None), (3, ""), (4, "No citation")], "answer int, text string")
    passages = spark.createDataFrame([(1, "b:1", "b", "other", 1, 2), (4, "b:2", "b", None, 1, 2)], "answer int, passage string, book string, text string, page_start int, page_end int")
    pages = spark.createDataFrame([], "book string, page int, text string")
    assert sorted((r.answer, r.passages, r.verbatim, r.novel) for r in extract_claims(answers, passages).collect()) == [(1, [], False, []), (4, [], False, [])]
    assert page_problems(answers, passages, pages).count() == snap_citations(answers, passages, pages).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", max_size=30), st.lists(st.text("ab ", min_size=1, max_size=6), max_size=3))
def test_spans_are_apart_and_hold_needles(words, needles):
    from quire.functions.answers import spans_of

    spans = spans_of(words, needles)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    squeezed = [" ".join(n.split()) for n in needles if len(" ".join(n.split())) >= 4]
    assert all(any(n in " ".join(words[a:b].split()) for n in squeezed) for a, b in spans)
    assert bool(spans) == any(n in " ".join(words.split()) for n in squeezed)


def test_long_sentences_are_cut_on_words(spark):
    from quire.operators.grouped import pack_windows, sentence_units

    words = " ".join(f"w{i}" for i in range(1000))
    pages = spark.createDataFrame([("b", 1, f"Short one. {words}. Tail here."), ("b", 2, None), ("b", 3, "")], "book string, page int, text string")
    units = sentence_units(pages, 400).orderBy("n").collect()
    assert max(u.tokens for u in units) <= 400 and " ".join(u.sentence for u in units) == f"Short one. {words}. Tail here."
    assert [len(u.sentence.split()) for u in units] == [2, 307, 307, 307, 79, 2]
    windows = pack_windows(sentence_units(pages, 400).selectExpr("book", "null as chapter", "n as pos", "tokens")).collect()
    assert {w.pos for w in windows} == set(range(len(units))) and {w.chapter for w in windows} == {None}


def test_edits_and_spans_are_difflib_s(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    for _ in range(200):
        a, b = make(rng.randrange(9)), make(rng.randrange(9))
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert grounding.edits(a, b) == sum(max(y - x, q - p) for tag, x, y, p, q in blocks if tag != "equal")
    rows = [(i, make(9).strip() + "x", make(60)) for i in range(40)]
    rows += [(100 + i, s[10:20].strip() + "y", s) for i, _, s in rows]

    def best(q, s):
        spans = [s[k : k + n] for n in range(max(1, len(q) - 3), len(q) + 4) for k in range(len(s) - n + 1)]
        return max(spans, key=lambda x: SequenceMatcher(None, x, q, autojunk=False).ratio())

    df = spark.createDataFrame(rows, "id int, quote string, source string")
    assert {r.id: r.span for r in df.select("id", grounding.closest_span(F.col("quote"), F.col("source")).alias("span")).collect()} == {i: best(q, s) for i, q, s in rows}
    forms = df.selectExpr("id", "quote as _q", "source as _s")
    got = {r.id: r.span for r in grounding.snapped(forms).collect()}
    for i, q, s in rows:
        span = best(q, s).strip(grounding.EDGE)
        assert got[i] == (span if q not in s and span and grounding.edits(q, span) <= 2 else None)


def test_a_quote_must_stand_in_one_passage_and_on_a_cited_page(spark):
    answers = spark.createDataFrame([(1, "“the stage is bare tonight” (page 3)"), (2, "“ends here and begins there” (page 3)"), (3, "“the stage is bear tonight” (page 9)"), (4, "no quote (page 9)"), (5, None)], "answer int, text string")
    told = [(n, p, t, a, a) for n in (1, 2, 3) for p, t, a in (("x", "So the stage is bare tonight, she said", 9), ("y", "it ends here", 3), ("z", "and begins there", 3))]
    passages = spark.createDataFrame([*told, (4, "x", None, 9, 9)], "answer int, passage string, text string, page_start int, page_end int")
    want = {(1, "quote is on pages [9], not the cited [3]: the stage is bare tonight"), (2, "quote not in passages: ends here and begins there")}
    for order in (passages, passages.orderBy(F.desc("passage"))):
        assert {(r.answer, r.problem) for r in grounding.check_answers(answers, order).collect()} == want
    mended = grounding.mend_quotes(answers, grounding.quote_findings(answers, passages))
    assert {r.answer: r.text for r in mended.collect()}[3] == "“the stage is bare tonight” (page 9)"


def test_numbers_are_no_running_lines(spark):
    from quire.operators.pages import running_lines, strip_running_lines

    pages = [(1, n, f"My Book\n{'7' if n < 5 else 'x' * n}\nbody {n}\n\n") for n in range(1, 9)]
    df = spark.createDataFrame(pages, "book int, page int, text string")
    assert [r.line for r in running_lines(df).collect()] == ["My Book"]
    assert {r.page: r.text for r in strip_running_lines(df).collect()} == {n: f"{'7' if n < 5 else 'x' * n}\nbody {n}" for n in range(1, 9)}


def test_widening_keeps_the_hit(spark):
    from quire.operators.retrieval import widen_passages

    chunks = spark.createDataFrame([("d", p, f"text {p} of the book.", p, p + (p == 12), 2 if p == 9 else 1) for p in (*range(4, 8), *range(9, 13), *range(20, 23))], "book string, pos int, text string, page_start int, page_end int, chapter int")
    hits = [(1, "d", "d:21", 21, 1, "t", 21, 21, 1, 0.9), (1, "d", "d:5", 5, 2, "t", 5, 5, 1, 0.8), (1, "d", "d:6", 6, 3, "t", 6, 6, 1, 0.7), (2, "d", "d:9", 9, 1, "t", 9, 9, 2, 0.5), (2, "d", "d:99", 99, 2, "gone", 70, 71, 1, 0.4), (2, "d", "d:11", 11, 3, "t", 11, 11, 1, 0.3), (2, "d", "d:4", 4, 4, "t", 4, 4, 1, 0.2)]
    got = widen_passages(spark.createDataFrame(hits, "query int, book string, chunk string, pos int, rank int, text string, page_start int, page_end int, chapter int, score double"), chunks).collect()
    assert sorted((r.query, r["rank"], r.chunk, r.page_start, r.page_end, r.chapter, r.score) for r in got) == [
        (1, 1, "d:20-22", 20, 22, 1, 0.9), (1, 2, "d:4-7", 4, 7, 1, 0.8), (2, 1, "d:9-12", 9, 13, 2, 0.5), (2, 2, "d:99", 70, 71, 1, 0.4)
    ]
    assert {r.chunk: r.text for r in got}["d:99"] == "gone" and {r.chunk: r.text for r in got}["d:20-22"] == "text 20 of the book. text 21 of the book. text 22 of the book."
    alone = widen_passages(spark.createDataFrame([("d", "d:9", 9, 1, "t", 9, 9, 2)], "book string, chunk string, pos int, rank int, text string, page_start int, page_end int, chapter int"), chunks).collect()
    assert [(r.chunk, r.text, r.page_start, r.page_end) for r in alone] == [("d:9", "text 9 of the book.", 9, 9)]


def test_stop_word_queries_are_asked_whole(spark):
    from quire.operators.retrieval import bm25_topk

    chunks = spark.createDataFrame([("b", i, i, t) for i, t in enumerate(["છે ગઢ", "ગઢ નગર", "નગર વાડી", None])], "book string, chunk int, pos int, text string")
    queries = spark.createDataFrame([(1, "નગર છે"), (2, "છે અને"), (3, "")], "query int, text string")
    assert {(r.query, r.chunk) for r in bm25_topk(chunks, queries, stopwords=[]).collect()} >= {(2, 0)}
    assert {r.query for r in bm25_topk(chunks, queries).collect()} <= {1}


def test_vectors_by_blocks_are_the_same(spark):
    from quire.operators.retrieval import vector_topk

    chunks = spark.createDataFrame([("b", i, i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)], "book string, chunk int, pos int, vector array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(7)] + [(9, [0.0, 0.0, 0.0])], "query int, asked array<double>")
    rows = [sorted(map(str, vector_topk(chunks, queries, 4, block=b).collect())) for b in (1, 3, 100)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 32


def test_headings_by_the_reader_s_rules(spark):
    from quire.functions import headings

    want = {
        "Chapter 3 The stage": (1, 3), "પ્રકરણ ૬ ઘરભણી": (1, 6), "પ્રકરણ ત્રણ": (1, None), "Part IV Ends": (1, None), "અધ્યાય-૨": (1, 2), "૭. સાંજ": (1, 7), "5.2 તારા": (2, 5), "5 - નાટક": (1, 5), "12) Arrival": (1, 12),
        "plain words here": None, "12 ": None, "5- નાટક": None, "6. 2/3 ભાગ": None, "8. પવનની ગતિ. પવને કહ્યું": None, "Chapter": None, "": None, "123 Too long": None, "Chapter 1 and so it went on and on until the end.": None,
    }
    got = spark.createDataFrame([(k,) for k in want], "l string").select("l", headings.parse_heading(F.col("l")).alias("h")).collect()
    assert {r.l: r.h and (r.h.level, r.h.number) for r in got} == want


def test_ingestion_marks_and_clears_what_fails(spark):
    from quire.operators.ingestion import ingest

    body = "The lamps were lit at nine. Nobody came to the second act."
    pages = [("a", 1, "Chapter 1 Lamps\n" + body, "digital"), ("a", 2, body, "ocr"), ("a", 3, "Chapter 2 Masks\n" + body, "digital"), ("b", 1, "", "empty"), ("c", 1, "broken vectors here.", "digital"), ("d", 1, " .", "digital")]
    files = spark.createDataFrame([("a", "a.pdf", " Acts ", None), ("b", "my book.pdf", "", "X"), ("c", "c.pdf", None, None), ("e", "e.pdf", None, None)], "book string, filename string, title string, author string")

    def model(texts):
        if any("broken" in t for t in texts):
            raise RuntimeError
        assert all(t.startswith("passage: ") for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    books = ingest(spark.createDataFrame(pages, "book string, page int, text string, source string"), files, model, 30, 5)
    status = {r.book: (r.status, r.error, r.title, r.author, r.page_count, r.chapter_count) for r in books.status.collect()}
    assert status == {"a": ("ready", None, "Acts", "", 3, 2), "b": ("failed", "no text", "my book", "X", 1, 0), "c": ("failed", "no vectors", "c", "", 1, 0), "e": ("failed", "no text", "e", "", 0, 0)}
    chunks = books.chunks.orderBy("chunk_index").collect()
    assert {c.book for c in chunks} == {"a"} and [c.chunk_id for c in chunks] == [f"a:{i}" for i in range(len(chunks))]
    assert {(c.chapter, c.chapter_title) for c in chunks} == {(0, "Chapter 1 Lamps"), (1, "Chapter 2 Masks")} and all(abs(sum(x * x for x in c.vector) - 1) < 1e-9 for c in chunks)
    assert {r.book: r.chunks for r in books.chunking.collect()} == {"a": len(chunks), "b": 0, "c": 0, "e": 0} and {r.book for r in books.pages.collect()} == {"a"}


def test_streamed_admission_forgets_and_keeps_across_batches(spark, tmp_path):
    from quire.streaming import streams

    schema = "user int, action string, ts timestamp, id long"
    at = lambda s: f"2026-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    batches = [[(1, 0), (1, 10), (1, 20), (2, 5)], [(1, 3600), (1, 3605), (3, 20_000)], [(3, 40_000)], [(1, 40_001), (1, 40_002), (1, 40_003)]]
    n, got = 0, {}
    for k, batch in enumerate(batches):
        rows = [(u, "ask", at(s), n + i) for i, (u, s) in enumerate(batch)]
        n += len(rows)
        spark.createDataFrame(rows, "user int, action string, ts string, id long").selectExpr("user", "action", "cast(ts as timestamp) as ts", "id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        limited = streams.rate_limit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 3600)
        limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.admitted for r in spark.read.schema("id long, admitted boolean").parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 9: True, 10: False}


def test_streamed_admission_takes_a_key_in_order_over_arrow_batches(spark, tmp_path):
    """Rows of a key that come out of time order, and in many frames, are admitted as by the batch operator."""
    from quire.operators.grouped import admission
    from quire.streaming import streams

    rows = [(n % 2, "ask", 1_700_000_000 + n * 7919 % 101 * 600, n) for n in range(100)]
    events = spark.createDataFrame(rows, "user int, action string, s long, id long").selectExpr("user", "action", "timestamp_seconds(s) as ts", "id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {r.id: r.admitted for r in admission(events.selectExpr("user", "action", "unix_micros(ts) / 1e6 as at", "id"), 2).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        limited = streams.rate_limit(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2)
        limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(r.id, r.admitted) for r in spark.read.schema("id long, admitted boolean").parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 100 and dict(got) == want and 0 < sum(want.values()) < 100
