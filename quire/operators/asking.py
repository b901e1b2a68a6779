"""Questions to books: translate, retrieve, grade, widen, rewrite, answer, verify, fall back - for all questions at once.

A model is a callable model(kind, payload) -> text with kind translate, grade, rewrite, answer, again or claims; it
raises RuntimeError when its provider is out. It runs in mapInPandas, one call a question and step, and each step's
replies are written before they are used, so no call is made twice. The loop has a fixed number of rounds: rewrites
are at most MOST_REWRITES, a question is widened once, an answer is written again once.

Null questions count as empty; a question whose book has no chunks falls back; repeated question ids are not allowed.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.answers import citation_label, parse_llm_json
from quire.functions.text import GUJARATI, keywords, language
from quire.operators.claims import extract_claims, verify
from quire.operators.ingestion import QUESTION, Embed, embed
from quire.operators.retrieval import bm25_index, hybrid_search, widen_passages
from quire.staging import stage

MOST_REWRITES, TOP, WIDEN, SNIPPET = 2, 5, 3, 300
# What a refusal says, by language, and the word with which a model reports that nothing was found.
REFUSALS = {"gujarati": "આ પ્રશ્નનો ઉત્તર આપેલા પુસ્તકમાં મળ્યો નથી.", "english": "This question could not be answered from the uploaded book."}
NOT_FOUND = "NOT_FOUND"

Model = Callable[[str, dict], str]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, zero, or empty; the text "false" does."""
    kind = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False))
    return F.coalesce(F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>"), False).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True).otherwise(number), F.lit(False))


def position(v: Column) -> Column:
    """A passage's number from a JSON number, truncated, or from a text of digits; null for anything else."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    number = F.try_variant_get(v, "$", "double")
    return F.when(_kind(v) == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))).when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).otherwise(F.when(F.abs(number) < 2147483647, number.cast("int")))


def graded(reply: Column, n: Column) -> Column:
    """Positions 1..n of the passages that the reply keeps, in its order.

    A reply is {"grades": [{"passage": 1, "relevant": true}, ...]} or the bare list; entries that are no objects and
    positions out of range count for nothing. A reply that cannot be read, or names a position that is no number,
    passes every passage through.
    """
    parsed = F.try_parse_json(parse_llm_json(reply))
    whole = F.coalesce(_kind(parsed), F.lit(""))
    listed = F.when(whole.startswith("ARRAY"), parsed).when(whole.startswith("OBJECT"), F.try_variant_get(parsed, "$.grades", "variant"))
    rows = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>"))
    own = F.filter(rows, lambda g: F.startswith(_kind(g), F.lit("OBJECT")))
    named = lambda g: F.when(_kind(g).contains("passage:"), position(F.try_variant_get(g, "$.passage", "variant"))).otherwise(0)
    kept = F.filter(own, lambda g: F.coalesce(named(g).between(1, n), F.lit(False)) & truthy(F.try_variant_get(g, "$.relevant", "variant")))
    broken = F.exists(own, lambda g: named(g).isNull())
    return F.when(parsed.isNull() | ~(whole.startswith("ARRAY") | whole.startswith("OBJECT")) | broken, F.sequence(F.lit(1), n)).otherwise(F.transform(kept, named))


def apply_grades(replies: DataFrame) -> DataFrame:
    """replies(question, reply, n) to (question, place, passage): the kept positions; none where n is 0."""
    kept = F.when(F.col("n") > 0, graded(F.col("reply"), F.col("n"))).otherwise(F.array().cast("array<int>"))
    return replies.select("question", F.posexplode(kept).alias("place", "passage"))


def with_fallback(first: Model, second: Model) -> Model:
    """The second model where the first is out."""
    def call(kind: str, payload: dict) -> str:
        try:
            return first(kind, payload)
        except RuntimeError:
            return second(kind, payload)

    return call


class ModelError(RuntimeError):
    """A provider's failure: its HTTP status if there is one, the wait in seconds it asks for, and whether a daily quota is used up."""

    def __init__(self, message: str = "", status: int | None = None, hint: float | None = None, daily: bool = False):
        super().__init__(message)
        self.status, self.hint, self.daily = status, hint, daily


# Statuses after which a call is worth another try.
TRANSIENT = (408, 429, 500, 502, 503, 504)


def wait_before(error: ModelError, attempt: int) -> float | None:
    """Seconds before the next try, without jitter, by the rule of functions.answers.retry_delay; None to stop."""
    if error.daily or error.status is not None and error.status not in TRANSIENT:
        return None
    least = 2.0 * 2**attempt
    wait = max(error.hint if error.hint is not None else 10.0 if error.status == 429 else 0.0, least)
    return wait if wait <= 60 else None


def retrying(model: Model, tries: int = 4, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Model:
    """The model, asked again after transient failures and empty replies."""
    def call(kind: str, payload: dict) -> str:
        for attempt in range(tries):
            try:
                if reply := model(kind, payload):
                    return reply
                error = ModelError("empty reply")
            except ModelError as failed:
                error = failed
            wait = wait_before(error, attempt)
            if wait is None or attempt + 1 == tries:
                raise error
            sleep(wait + jitter())
        raise ModelError("no tries")

    return call


# What each kind of call asks for; {payload} stands for its data as JSON.
PROMPTS = {
    "translate": "Put this question about a Gujarati book into Gujarati, names included, adding nothing to it. Reply with the question alone.\n{payload}",
    "grade": 'Which of the numbered passages state the answer to the question, with everything it asks for? Sharing its subject or words is not enough. Reply with JSON: {{"grades": [{{"passage": 1, "relevant": true, "reason": "..."}}]}}\n{payload}',
    "rewrite": "A search of a Gujarati book with the tried queries found nothing. Reply with one other query in Gujarati, with words the book may use and no facts that the question lacks.\n{payload}",
    "answer": "Answer the question from the passages alone, in its language. Give each statement a line of its own with the exact page it is on, as (page 4). Copy quotations letter by letter. Reply NOT_FOUND if the passages do not say.\n{payload}",
    "again": "Your answer failed the listed checks against its passages. Write it again so that each holds, or reply NOT_FOUND.\n{payload}",
    "claims": 'Do the passages that each numbered claim cites state all of it, as an answer to the question? In doubt they do not. Reply with JSON: {{"claims": [{{"claim": 1, "supported": false, "reason": "..."}}]}}\n{payload}',
}


def prompted(generate: Callable[[str], str]) -> Model:
    """A model from a text generator."""
    return lambda kind, payload: generate(PROMPTS[kind].format(payload=json.dumps(payload, ensure_ascii=False)))


def called(rows: DataFrame, kind: str, payload: Column, model: Model) -> DataFrame:
    """rows with the model's reply to each payload struct; null where it is out. Written, so that it is asked once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            replies = []
            for sent in pdf["_payload"]:
                try:
                    replies.append(model(kind, json.loads(sent)))
                except RuntimeError:
                    replies.append(None)
            yield pdf.drop(columns="_payload").assign(reply=pd.Series(replies, index=pdf.index, dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stage(rows.withColumn("_payload", F.to_json(payload)).mapInPandas(run, f"{kinds}, reply string"), kind)


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), '^"+|"+$', "")


def translate(state: DataFrame, model: Model) -> DataFrame:
    """The query of an English question in Gujarati, if the model gives one."""
    replies = called(state.where("language = 'english'").select("question", "original"), "translate", F.struct(F.col("original").alias("question")), model)
    put = F.when(_bare(F.col("reply")).rlike(GUJARATI), _bare(F.col("reply")))
    return state.join(replies.select("question", put.alias("put")), "question", "left").withColumn("query", F.coalesce("put", "query")).drop("put")


def retrieve(state: DataFrame, chunks: DataFrame, indexed: DataFrame, model: Embed, k: int = TOP) -> DataFrame:
    """The best chunks of each question's book; an English question that was translated is searched in both wordings."""
    both = (F.col("language") == "english") & (F.col("original") != F.col("query"))
    asked = state.select(F.col("question").alias("query"), "book", F.col("query").alias("text"), F.when(both, F.col("original")).alias("other"))
    asked = embed(asked, F.col("text"), model, QUESTION, "asked")
    asked = embed(asked, F.col("other"), model, QUESTION, "extra").withColumn("extra", F.when(F.col("other").isNotNull(), F.col("extra")))
    return stage(hybrid_search(chunks, stage(asked.drop("other"), "asked"), k, indexed=indexed), "retrieved")


def grade(state: DataFrame, documents: DataFrame, model: Model) -> DataFrame:
    """The documents(query, rank, ...) that the model finds to state the answer, in its order as `place`; all of them where it cannot be reached or read."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    numbered = documents.withColumn("passage", place)
    listed = numbered.groupBy(F.col("query").alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("passage", "text"))), lambda p: p["text"]).alias("passages"))
    rows = state.select("question", "original").join(listed, "question")
    replies = called(rows, "grade", F.struct(F.col("original").alias("question"), "passages"), model).withColumn("n", F.size("passages"))
    kept = apply_grades(replies).withColumnRenamed("question", "query")
    return stage(numbered.join(kept, ["query", "passage"]).drop("passage"), "graded")


def rewrite(state: DataFrame, model: Model) -> DataFrame:
    """The state with another query: the model's, or the question's key words where that is empty, tried or not to be had."""
    replies = called(state, "rewrite", F.struct(F.col("original").alias("question"), "tried", (F.col("attempts") + 1).alias("attempt")), model)
    new = _bare(F.col("reply"))
    fresh = F.when((new != "") & ~F.array_contains("tried", new), new)
    return replies.withColumns({"query": F.coalesce(fresh, keywords(F.col("original"))), "attempts": F.col("attempts") + 1}).drop("reply")


def verdicts(reply: Column) -> Column:
    """Numbers of the claims that the reply calls supported, and it must say true; nothing for a reply that cannot be read."""
    parsed = F.try_parse_json(parse_llm_json(reply))
    rows = F.coalesce(F.try_variant_get(parsed, "$.claims", "array<variant>"), F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))
    said = F.filter(rows, lambda v: F.coalesce((_kind(F.try_variant_get(v, "$.supported", "variant")) == "BOOLEAN") & F.try_variant_get(v, "$.supported", "boolean"), F.lit(False)))
    return F.transform(said, lambda v: F.coalesce(position(F.try_variant_get(v, "$.claim", "variant")), F.lit(0)))


def check_claims(answers: DataFrame, passages: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """(answer, problem, out): claims that the model does not call supported; out where it cannot be reached, with no problem named. asked(answer, original)."""
    told = passages.select("answer", "passage", "text")
    n = F.row_number().over(Window.partitionBy("answer").orderBy("line"))
    claims = stage(extract_claims(answers, passages).where(F.size("passages") > 0).withColumn("n", n), "claims")
    listed = claims.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("n", "text", "passages", "novel"))).alias("claims"))
    cited = told.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("passage", "text"))).alias("passages"))
    replies = called(listed.join(cited, "answer").join(asked, "answer"), "claims", F.struct(F.col("original").alias("question"), "claims", "passages"), model)
    judged = claims.join(replies.select("answer", F.col("reply").isNull().alias("out"), verdicts(F.col("reply")).alias("held")), "answer")
    lost = judged.where(F.col("out") | ~F.array_contains("held", F.col("n")))
    return lost.select("answer", F.when(~F.col("out"), F.concat(F.lit("claim not supported: "), F.substring("text", 1, 60))).alias("problem"), "out").distinct()


def _verified(answers: DataFrame, passages: DataFrame, pages: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """(answer, text, problems, out) of answers(answer, text): checks without a model first, the model only where they hold."""
    plain = stage(verify(answers, passages, pages), "verified")
    lost = check_claims(plain.where("grounded").select("answer", "text"), passages, asked, model)
    found = lost.groupBy("answer").agg(F.array_sort(F.collect_list("problem")).alias("more"), F.bool_or("out").alias("out"))
    every = plain.join(found, "answer", "left")
    return stage(every.select("answer", "text", F.when(F.col("grounded"), F.coalesce("more", F.array().cast("array<string>"))).otherwise(F.col("problems")).alias("problems"), F.coalesce("out", F.lit(False)).alias("out")), "checked")


def answer(decided: DataFrame, relevant: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """(question, answer, found, error) for decided(question, book, original, language): a failing answer is written again once."""
    passages = stage(relevant.select(F.col("query").alias("answer"), F.col("chunk").cast("string").alias("passage"), "book", "text", "page_start", "page_end", "chapter_title", F.col("place").alias("rank")), "passages")
    shown = passages.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("rank", "page_start", "page_end", "chapter_title", "text"))).alias("passages"))
    rows = decided.select(F.col("question").alias("answer"), "original", "language").join(shown, "answer")
    asked = rows.select("answer", "original")
    payload = [F.col("original").alias("question"), "language", "passages"]
    first = called(rows, "answer", F.struct(*payload), model)
    refused = lambda c: F.upper(c).contains(NOT_FOUND)
    checked = _verified(first.where(F.col("reply").isNotNull() & ~refused(F.col("reply"))).select("answer", F.col("reply").alias("text")), passages, pages, asked, model)
    failed = checked.where(~F.col("out") & (F.size("problems") > 0))
    again = called(rows.join(failed.select("answer", F.col("text").alias("previous"), "problems"), "answer"), "again", F.struct(*payload, "previous", "problems"), model)
    rechecked = _verified(again.where(F.col("reply").isNotNull() & ~refused(F.col("reply"))).select("answer", F.col("reply").alias("text")), passages, pages, asked, model)
    good = checked.unionByName(rechecked).where(~F.col("out") & (F.size("problems") == 0)).select("answer", "text")
    out = checked.unionByName(rechecked).where("out").select("answer").unionByName(first.unionByName(again.select(first.columns)).where("reply is null").select("answer")).distinct().withColumn("out", F.lit(True))
    every = rows.select("answer").join(good, "answer", "left").join(out, "answer", "left")
    return every.select(F.col("answer").alias("question"), F.col("text").alias("answer"), F.col("text").isNotNull().alias("found"), F.when(F.col("text").isNull() & F.col("out"), "model unavailable").alias("error"))


def ask(questions: DataFrame, chunks: DataFrame, pages: DataFrame, model: Model, embedder: Embed, k: int = TOP, most: int = MOST_REWRITES) -> DataFrame:
    """questions(question, book, text) to (question, book, answer, found, error, language, rewrites, tried, citations, contexts).

    chunks(book, chunk, pos, text, vector, page_start, page_end, chapter, chapter_title), pages(book, page, text).
    Citations and contexts are those of all passages that the answer was written from.
    """
    text = F.coalesce("text", F.lit(""))
    state = questions.select("question", "book", text.alias("original"), text.alias("query"), language(text).alias("language"), F.lit(0).alias("attempts"), F.lit(False).alias("widened"), F.array().cast("array<string>").alias("tried"))
    state = stage(translate(state, model), "state")
    indexed, relevant, decided = bm25_index(chunks.select("book", "chunk", "pos", "text")), None, None

    def keep(found: DataFrame) -> None:
        nonlocal relevant, decided, state
        done = found.select(F.col("query").alias("question")).distinct()
        now = stage(state.join(done, "question", "left_semi"), "decided")
        relevant = found if relevant is None else relevant.unionByName(found)
        decided = now if decided is None else decided.unionByName(now)
        state = stage(state.join(done, "question", "left_anti"), "open")

    for attempt in range(most + 1):
        if state.isEmpty():
            break
        state = state.withColumn("tried", F.concat("tried", F.array("query")))
        documents = retrieve(state, chunks, indexed, embedder, k)
        keep(grade(state, documents, model))
        first = state.where(~F.col("widened")).join(documents.select(F.col("query").alias("question")).distinct(), "question", "left_semi")
        wider = stage(widen_passages(documents.join(first.select(F.col("question").alias("query")), "query", "left_semi").withColumn("chunk", F.col("chunk").cast("string")), chunks, WIDEN), "widened")
        state = stage(state.join(first.select("question", F.lit(True).alias("now")), "question", "left").withColumn("widened", F.col("widened") | F.coalesce("now", F.lit(False))).drop("now"), "state")
        if not wider.isEmpty():
            keep(grade(first, wider, model).withColumn("chunk", F.col("chunk").cast(relevant.schema["chunk"].dataType)))
        if attempt < most and not state.isEmpty():
            state = stage(rewrite(state, model), "rewritten")
    relevant = stage(relevant.withColumn("chunk", F.col("chunk").cast("string")), "relevant")
    answers = stage(answer(decided, relevant, pages, model), "answers")
    label = citation_label(F.col("page_start"), F.col("page_end"), F.col("chapter_title"))
    cited = F.struct("place", F.struct("chunk", "page_start", "page_end", "chapter", "chapter_title", label.alias("label"), F.substring("text", 1, SNIPPET).alias("snippet")).alias("citation"), "text")
    used = relevant.groupBy(F.col("query").alias("question")).agg(F.array_sort(F.collect_list(cited)).alias("used"))
    every = decided.unionByName(state).join(answers, "question", "left").join(used, "question", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    refusal = F.when(F.col("language") == "gujarati", REFUSALS["gujarati"]).otherwise(REFUSALS["english"])
    used = F.coalesce("used", F.array().cast(used.schema["used"].dataType))
    return every.select(
        "question", "book", F.when(F.col("found"), F.col("answer")).otherwise(refusal).alias("answer"), "found", "error", "language", F.col("attempts").alias("rewrites"), "tried",
        F.when(F.col("found"), F.transform(used, lambda u: u["citation"])).otherwise(F.transform(F.slice(used, 1, 0), lambda u: u["citation"])).alias("citations"), F.transform(used, lambda u: u["text"]).alias("contexts"),
    )
