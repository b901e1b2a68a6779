"""Quality by hierarchical empirical Bayes: document evidence, then host and path posteriors.

A logistic classifier on shares of character classes and repeated words gives each document a probability of
good quality. Probabilities are summed by host (`source`) and by path under it (host and `lang`; documents have no
URL, of_pages derives both from the URLs of web pages); a path's mean
is shrunk toward its host's, a host's toward the corpus's, by as many pseudo-documents as the method of moments
finds (within PRIOR_LIMITS). The document's log-odds move by what its path's posterior says beyond the corpus.

Only counts and sums by path leave a partition, so a host with a third of all rows costs one row per task. Path
posteriors are joined back, by broadcast only when counted to be few.

Training takes SAMPLE_DOCS labelled documents a class in expectation, chosen by hash among doc_ids whose crc32
mod 3 is not 1. Labels, ids, host and path are not inputs of the document probability.

Defined results: null and empty texts get the classifier's answer for no characters. Null source or lang is a
host or path of its own. Without labels of both classes every probability is 0.5. Repeated rows count as often
as they come. An empty table gives no rows; only doc_id, text, source, lang and the labels' quality are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, column_type, crc_mod, stage, texts_of

SAMPLE_DOCS = 1500
PRIOR_LIMITS = (2.0, 500.0)
KEEP = 0.3
RIDGE = 1.0


def _class(c: int) -> int:
    """Upper, lower, digit, white space, sentence mark, other punctuation, other letters' bytes."""
    x = chr(c)
    if c >= 128:
        return 6
    return 0 if x.isupper() else 1 if x.islower() else 2 if x.isdigit() else 3 if x.isspace() else 4 if x in ".,;:'!?-\"" else 5


_CLASSES = bytes(map(_class, range(256)))
_N = 7


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, 12): class shares, exclamation and line shares, word length, distinct words, length."""
    out = np.zeros((len(texts), _N + 5))
    for row, text in zip(out, texts):
        words, n = text.split(), max(1, len(text))
        counts = np.bincount(np.frombuffer(text.translate(_CLASSES), np.uint8), minlength=_N)
        row[:_N] = counts / n
        row[_N:] = (text.count(b"!") + text.count(b"|")) / n, text.count(b"\n") / n, (n - counts[3]) / max(1, len(words)) / 10, len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 10
    return out


class Model:
    """Standardised logistic regression."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray):
        self.mean, self.scale, self.beta = mean, scale, beta

    def probability(self, texts: list[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        z = np.clip((features(texts) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, np.ones(len(z))]) @ self.beta, -12, 12)))


def train(texts: list[bytes], good: list[int]) -> Model:
    y = np.array(good, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(_N + 5), np.ones(_N + 5), np.zeros(_N + 6))
    x = features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    beta, ridge = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return Model(mean, scale, beta)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    dice = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("good") == 1, F.lit(min(1.0, sample_docs / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample_docs / max(1, sizes.get(0, 0)))))
    chosen = known.where(dice < rate)  # sample_docs a class in expectation
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "good", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["good"] for r in rows])


def _batches(shared):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(texts_of(batch.column(1))), pa.float64())], names=["row", "p"])

    return run


def shrunk(sums: DataFrame, key: list[str], above: DataFrame | None, above_key: list[str]) -> DataFrame:
    """sums(key.., n, total, square) with post: the mean shrunk toward `above`'s post, by method-of-moments pseudo-counts."""
    group = sums.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")])
    stats = group.agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("s"), F.sum(F.col("total") * F.col("total") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k")).first()  # one row
    n, t, s, b, k = (float(stats[c] or 0) for c in ("n", "t", "s", "b", "k"))
    mean = t / n if n else 0.5
    within = max((s - b) / max(n - k, 1.0), 1e-9)
    between = max((b - n * mean * mean - (k - 1) * within) / max(n, 1.0), 1e-9)
    prior = float(np.clip(within / between, *PRIOR_LIMITS))
    if above is None:
        return group.withColumn("post", (F.col("total") + prior * mean) / (F.col("n") + prior)).withColumn("corpus", F.lit(mean))
    up = above.select(*[F.col(c).alias(f"up_{c}") for c in above_key], F.col("post").alias("up"), F.col("corpus"))
    match = F.lit(True)
    for c in above_key:
        match = match & F.col(c).eqNullSafe(F.col(f"up_{c}"))
    return group.join(up, match, "left").withColumn("post", (F.col("total") + prior * F.col("up")) / (F.col("n") + prior)).select(*key, "n", "post", F.col("up").alias("host_post"), "corpus")


def _logit(c):
    p = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(p / (1 - p))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as documents: source is the URL's host without www, lang its first path segment, text the HTML without scripts, styles and tags."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    section = F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "^/([^/]+)", 1), F.lit(""))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.coalesce(host, F.lit("")).alias("source"), section.alias("lang"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, host, path, document_p, host_p, path_p, score, kept) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("doc_id", F.col("source").alias("host"), F.col("lang").alias("section")).alias("row"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_batches(shared), f"row {column_type(rows, 'row')}, p double").select("row.*", "p")
    scored = stage(scored, "document_scores")
    sums = stage(scored.groupBy("host", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("square")), "paths")
    hosts = shrunk(sums, ["host"], None, [])
    paths = stage(shrunk(sums, ["host", "section"], hosts, ["host"]), "posteriors").select(F.col("host").alias("h"), F.col("section").alias("q"), F.col("post").alias("path_p"), F.col("host_post").alias("host_p"), "corpus")
    joined = scored.join(broadcast_if_small(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("section").eqNullSafe(F.col("q")), "left")
    odds = _logit(F.col("p")) + _logit(F.col("path_p")) - _logit(F.col("corpus"))
    final = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    path = F.concat_ws("/", F.coalesce("host", F.lit("")), "section")  # a host without a section is a path of its own
    return final.select("doc_id", "host", path.alias("path"), F.col("p").alias("document_p"), "host_p", "path_p", "score", (F.col("score") >= KEEP).alias("kept"))


def query_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels.where(crc_mod("doc_id", 3) != 1)))
