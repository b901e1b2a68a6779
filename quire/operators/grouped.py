"""Order-dependent operators that no frame expresses: packing, batching, admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import GUJARATI, estimate_tokens, sentences, token_estimate


def pack(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [first, end) over units of these sizes: a window takes units while they fit, and the next one begins with its longest tail within the overlap.

    Over prefix sums both ends are found by bisection. A window's first new unit always enters, so after a carry a
    window may hold overlap + size.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    upto = np.r_[0, np.cumsum(np.asarray(sizes, np.int64))] if len(sizes) else np.zeros(1, np.int64)
    windows, first, new = [], 0, 0
    while new < len(sizes):
        end = max(new + 1, int(np.searchsorted(upto, upto[first] + size, "right")) - 1)
        windows.append((first, end))
        first, new = int(np.searchsorted(upto[: end + 1], upto[end] - overlap)), end
    return windows


def pack_windows(units: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """units(book, chapter, pos, tokens) to (book, chapter, window, pos); one book's chapter is one group, of numbers alone.

    Units are expected to be `size` at most, as sentence_units makes them. Null chapters are a chapter of their own.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        spans = pack(pdf["tokens"].tolist(), size, overlap)
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        return pdf.iloc[at][["book", "chapter", "pos"]].assign(window=np.repeat(np.arange(len(spans)), [b - a for a, b in spans]))[["book", "chapter", "window", "pos"]]

    kind = units.schema["book"].dataType.simpleString()
    return units.select("book", F.col("chapter").cast("int").alias("chapter"), F.col("pos").cast("long").alias("pos"), "tokens").groupBy("book", "chapter").applyInPandas(run, f"book {kind}, chapter int, window int, pos long")


def budget_batches(rows: DataFrame, budget: int, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """rows(*by, pos, weight) to (*by, pos, batch): a batch closes before the row that would exceed the budget."""
    keep = [*by, "pos"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        batch, used, out = 0, 0, []
        for weight in pdf["weight"].tolist():
            if used and used + weight > budget:
                batch, used = batch + 1, 0
            used += weight
            out.append(batch)
        return pdf.assign(batch=out)[[*keep, "batch"]]

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in keep)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, batch int")


def admit(times: list[float], limit: int, span: float) -> list[tuple[bool, int]]:
    """For each time in order: admitted or not, and the minutes to wait.

    As refused calls leave no trace, a call is refused just where the limit-th last admitted one is less than a span
    ago; that one's age is also the wait.
    """
    last: deque[float] = deque(maxlen=limit)
    out = []
    for now in times:
        left = span - (now - last[0]) if len(last) == limit else 0
        out.append((left <= 0, int(left // 60) + 1 if left > 0 else 0))
        if left <= 0:
            last.append(now)
    return out


def admission(events: DataFrame, limit: int, span: int = 3600) -> DataFrame:
    """events(user, action, at seconds, id) to (id, admitted, wait_minutes)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        ok, wait = zip(*admit(pdf["at"].tolist(), limit, span))
        return pd.DataFrame({"id": pdf["id"], "admitted": ok, "wait_minutes": wait})

    return events.groupBy("user", "action").applyInPandas(run, "id long, admitted boolean, wait_minutes int")


def word_pieces(sentence: Column, size: int) -> Column:
    """A sentence cut on words: a piece ends with the word by which its estimated tokens reach the size."""
    state = "struct<own:int,other:int,held:array<string>,done:array<array<string>>>"

    def step(a: Column, w: Column) -> Column:
        script = w.rlike(GUJARATI).cast("int")
        own, other, held = a["own"] + script, a["other"] + 1 - script, F.concat(a["held"], F.array(w))
        full = token_estimate(own, other) >= size
        none = F.array().cast("array<string>")
        return F.struct(F.when(full, 0).otherwise(own).alias("own"), F.when(full, 0).otherwise(other).alias("other"), F.when(full, none).otherwise(held).alias("held"), F.when(full, F.concat(a["done"], F.array(held))).otherwise(a["done"]).alias("done")).cast(state)

    start = F.struct(F.lit(0).alias("own"), F.lit(0).alias("other"), F.array().cast("array<string>").alias("held"), F.array().cast("array<array<string>>").alias("done")).cast(state)
    words = F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != "")
    pieces = F.aggregate(words, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))
    return F.transform(pieces, lambda p: F.array_join(p, " "))


def sentence_units(pages: DataFrame, size: int = 400, count: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """(book, page, n, sentence, tokens) of pages(book, page, text): sentences, those over the size cut on words.

    count gives a text's tokens, by the estimate or by a tokenizer's pandas_udf; cuts go by the estimate. Null and
    blank texts have no units.
    """
    rows = pages.select("book", "page", F.posexplode(sentences(F.col("text"))).alias("s", "sentence"))
    parts = F.when(count(F.col("sentence")) > size, word_pieces(F.col("sentence"), size)).otherwise(F.array("sentence"))
    cut = rows.select("book", "page", "s", F.posexplode(parts).alias("p", "sentence"))
    n = F.row_number().over(Window.partitionBy("book", "page").orderBy("s", "p")) - 1
    return cut.select("book", "page", n.alias("n"), "sentence").withColumn("tokens", count(F.col("sentence")))
