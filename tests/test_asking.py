"""The ask loop with a scripted model: what it asks, where it goes, and what it refuses. All questions go in one run."""

import json

import pytest

from quire.operators import asking

TEXTS = ["The lamps were lit at nine.", "Nobody came to the second act.", "The wallet lay under the chair.", "The thief was Kelkar all along.", "She left the town in winter."]
GOOD = "The lamps were lit at nine (page 1)"
YES = '{"claims": [{"claim": 1, "supported": true}]}'


def embedder(texts):
    """Letter counts: enough to rank."""
    return [[float(t.lower().count(c)) + 0.1 for c in "abcdefghiklmnoprstuw"] for t in texts]


def only(*parts):
    return lambda p: json.dumps({"grades": [{"passage": i, "relevant": all(x in t for x in parts)} for i, t in enumerate(p["passages"], 1)]})


USUAL = {"translate": "not Gujarati", "grade": only("lamps"), "rewrite": "દીવા", "answer": GOOD, "again": "NOT_FOUND", "claims": YES}
#: By question: how its script differs from the usual one; a callable gets the payload, an exception is an outage.
SCRIPTS = {
    "When good?": {}, "When wrong page, mended?": {"answer": "The lamps were lit at nine (page 4)", "again": lambda p: GOOD if p["problems"] and "page 4" in p["previous"] else "x"},
    "When wrong twice?": {"answer": "The lamps were lit at nine (page 4)", "again": "It was in 1999 (page 1)"},
    "When no verdict?": {"claims": '{"claims": []}'}, "When a text for true?": {"claims": '{"claims": [{"claim": 1, "supported": "true"}]}'}, "When no JSON?": {"claims": "no json"}, "When not there?": {"answer": "maybe not_found here"},
    "When verifier out?": {"claims": RuntimeError}, "When answer out?": {"answer": RuntimeError}, "When grader out?": {"grade": RuntimeError, "translate": RuntimeError},
    "When nothing is relevant?": {"grade": '{"grades": []}', "rewrite": lambda p: "દીવા" if p["attempt"] == 1 else p["tried"][-1]}, "When cut in two?": {"grade": only(TEXTS[0], TEXTS[1])},
    "When translated?": {"translate": '"દીવા ક્યારે?"'}, "દીવા ક્યારે?": {"grade": "[]"}, "": {"grade": "[]"},
}


def scripted(kind, payload):
    reply = (USUAL | SCRIPTS.get(payload["question"], {}))[kind]
    if reply is RuntimeError:
        raise RuntimeError
    return reply(payload) if callable(reply) else reply


@pytest.fixture(scope="module")
def answers(spark):
    rows = [("b", f"b:{i}", i, t, embedder(["passage: " + t])[0], i + 1, i + 1, 0, "Acts") for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "book string, chunk string, pos int, text string, vector array<double>, page_start int, page_end int, chapter int, chapter_title string")
    asked = [(q, "b", q or None) for q in SCRIPTS] + [("elsewhere", "no book", "Anything?")]
    made = asking.ask(spark.createDataFrame(asked, "question string, book string, text string"), chunks, chunks.selectExpr("book", "page_start as page", "text"), scripted, embedder)
    return {r.question: r for r in made.collect()}


def test_every_question_has_one_answer(answers):
    assert set(answers) == {*SCRIPTS, "elsewhere"}
    found = {q for q, r in answers.items() if r.found}
    assert found == {"When good?", "When wrong page, mended?", "When grader out?", "When cut in two?", "When translated?"}
    assert all(answers[q].answer == GOOD for q in found)
    assert all(r.answer == asking.REFUSALS[r.language] and not r.citations for q, r in answers.items() if q not in found)
    assert answers["દીવા ક્યારે?"].language == "gujarati" and answers[""].language == answers["elsewhere"].language == "english"


def test_a_good_answer_cites_what_it_was_written_from(answers):
    r = answers["When good?"]
    assert (r.rewrites, list(r.tried), r.error) == (0, ["When good?"], None)
    assert [(c.chunk, c.label, c.snippet) for c in r.citations] == [("b:0", "પાનું 1 | Acts", TEXTS[0])] and list(r.contexts) == [TEXTS[0]]


def test_outages_are_errors_and_no_refusals_of_the_book(answers):
    assert {q for q, r in answers.items() if r.error} == {"When verifier out?", "When answer out?"}
    assert len(answers["When grader out?"].contexts) == 5  # all passages go through


def test_nothing_relevant_is_widened_once_and_rewritten_twice(answers):
    r = answers["When nothing is relevant?"]
    assert (r.rewrites, list(r.tried), list(r.contexts)) == (2, ["When nothing is relevant?", "દીવા", "nothing relevant"], [])
    r = answers["When cut in two?"]
    assert r.rewrites == 0 and r.citations[0].chunk.startswith("b:0-")


def test_an_english_question_is_searched_in_gujarati(answers):
    assert list(answers["When translated?"].tried) == ["દીવા ક્યારે?"] and answers["When translated?"].found


def test_a_report_counts_refusals_and_page_hits(spark, answers):
    from quire.operators.evaluation import per_case, report

    rows = [(q, bool(r.found), [(c.page_start, c.page_end) for c in r.citations], r.answer, r.rewrites) for q, r in answers.items()]
    told = spark.createDataFrame(rows, "question string, found boolean, citations array<struct<page_start int, page_end int>>, answer string, rewrites int")
    cases = spark.createDataFrame([(q, q, q.startswith("When"), [1] if q == "When good?" else [9] if q == "When translated?" else None) for q in answers], "question string, text string, answerable boolean, expected array<int>")
    made = report(per_case(cases, told)).collect()
    assert len(made) == 1 and made[0].case_count == 16 and (made[0].unanswerable, made[0].correct_refusals, made[0].refusal_recall) == (3, 3, 1.0)
    assert (made[0].answerable, made[0].false_refusals, made[0].false_refusal_rate) == (13, 8, 0.615) and (made[0].cases, made[0].page_hit_rate) == (2, 0.5)
    none = report(per_case(cases.limit(0), told)).collect()[0]
    assert (none.case_count, none.refusal_recall, none.page_hit_rate) == (0, None, None)


@pytest.mark.parametrize("status, hint, daily, waits", [(429, 8.0, False, [8, 8, 8]), (429, 12.5, False, [12.5, 12.5, 12.5]), (503, None, False, [2, 4, 8]), (429, None, False, [10, 10, 10]), (None, None, False, [2, 4, 8]), (404, None, False, []), (400, None, False, []), (429, None, True, []), (429, 120.0, False, [])])
def test_transient_failures_are_tried_again(status, hint, daily, waits):
    slept = []

    def out(kind, payload):
        raise asking.ModelError("x", status, hint, daily)

    with pytest.raises(asking.ModelError):
        asking.retrying(out, sleep=slept.append, jitter=lambda: 0.0)("grade", {})
    assert slept == waits
    replies = iter(["", "", "yes"])
    assert asking.retrying(lambda kind, payload: next(replies), sleep=slept.append)("grade", {}) == "yes"


def test_the_second_model_serves_where_the_first_is_out():
    def out(kind, payload):
        raise RuntimeError

    assert asking.with_fallback(out, lambda kind, payload: kind)("grade", {}) == "grade"
    with pytest.raises(RuntimeError):
        asking.with_fallback(out, out)("grade", {})
    assert json.dumps({"a": "દી"}, ensure_ascii=False) in asking.prompted(lambda prompt: prompt)("grade", {"a": "દી"})
