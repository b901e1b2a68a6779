"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two strings sums, over all letter triples, the product of their weights in either string; a
triple's occurrence weighs DECAY to the number of characters it spans, up to SPAN, so inserted or separating
characters cost weight and not the match. Landmarks are windows of labelled sentences: each begins at a word, for the
words that stand out most in toxic documents and the most frequent ones in clean documents. With m landmarks the Nystroem map is K_mm^(-1/2) k(x),
on which a squared-hinge SVM is trained. As the kernel is an inner product of triple weights, the trained
machine folds into one weight per triple, and a text of any length is scored in one pass: a window's decision
is the sum of its triples' weights, a document's evidence is its highest window and half the next, and a logistic of that is the score.

Labels belong to documents, so the toxic window of a toxic document is latent: training alternates between
choosing each toxic document's highest window and refitting against the highest windows of clean documents.

Training takes a hash-chosen sample of SAMPLE_DOCS labelled documents a class, in expectation, with all their
sentences. Scoring takes whole texts.

Defined results: null and empty texts score as a text without a triple. Documents without a label are scored
and not learned from; of contradicting labels of one doc_id the higher counts. A null doc_id is not held out
and never learned from. Without labels of both classes every score is 0. An empty table gives no rows; only
doc_id, text and the labels' toxic are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column_type, crc_mod, texts_of

DECAY = 0.75
#: Steps between the letters of a triple.
STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 5]
SPAN = 6
WINDOW = 10
SAMPLE_DOCS = 1200
LANDMARKS = 400
RIDGE = 1e-4
ROUNDS = 8
THRESHOLD = 0.7
#: Decisions beyond this add nothing.
CLIP = 3.0
BLOCK_BYTES = 2_000_000

_SYMBOLS = 64
_SIZE = _SYMBOLS**3


def _symbol(c: int) -> int:
    """1 to 26 for letters, 27 for white space, 28 and on for the last bytes of other letters with case folded; 0 only fills a span."""
    if c < 128:
        return (c | 32) - 96 if chr(c).isalpha() else 27 if chr(c).isspace() else 0
    return 28 + ((c | 32) & 31) if c < 192 else 0


_CODE = bytes(map(_symbol, range(256)))
_GAP = bytes(SPAN + WINDOW)


def codes(text: bytes) -> bytes:
    """The text's symbols, with white space around it."""
    return (b" " + text + b" ").translate(_CODE)


def triples(data: np.ndarray):
    """(index by start, weight) for each pair of steps; index 0 where a character only fills."""
    n = len(data) - SPAN + 1
    wide = data.astype(np.int32)
    for a, b in STEPS:
        x, y, z = wide[:n], wide[a : a + n], wide[a + b : a + b + n]
        index = (x * _SYMBOLS + y) * _SYMBOLS + z
        index *= (x > 0) & (y > 0) & (z > 0)
        yield index, DECAY ** (a + b + 1)


def profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A short string's triples and their weights."""
    data = np.frombuffer(text.translate(_CODE) + _GAP, np.uint8)
    index = np.concatenate([i for i, _ in triples(data)])
    weight = np.concatenate([np.full(len(i), w) for i, w in triples(data)])
    kept, place = np.unique(index, return_inverse=True)
    summed = np.bincount(place, weights=weight, minlength=len(kept))
    return kept[kept > 0], summed[kept > 0]


def kernel(a: bytes, b: bytes) -> float:
    """The kernel of two strings, not normalised."""
    (i, x), (j, y) = profile(a), profile(b)
    _, at, to = np.intersect1d(i, j, return_indices=True)
    return float(x[at] @ y[to])


def highest(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2): each text's highest window sum of triple weights and the next highest apart from it; where these windows start."""
    top, where = np.zeros((len(texts), 2)), np.zeros((len(texts), 2), np.int64)
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held < BLOCK_BYTES and i + 1 < len(texts):
            continue
        parts = [codes(t) + _GAP for t in texts[start : i + 1]]
        data = np.frombuffer(b"".join(parts) + _GAP, np.uint8)
        value = np.zeros(len(data) - SPAN + 1, np.float32)
        for index, weight in triples(data):
            value += weights[index] * np.float32(weight)
        total = np.r_[0.0, np.cumsum(value, dtype=np.float64)]
        window = total[WINDOW:] - total[:-WINDOW]
        ends = np.cumsum([len(p) for p in parts])
        for j, (a, b) in enumerate(zip((np.r_[0, ends[:-1]]).tolist(), (ends - len(_GAP)).tolist()), start):
            own = window[a:b]
            for k in range(2):
                at = int(own.argmax())
                top[j, k], where[j, k] = own[at], at
                own[max(0, at - WINDOW) : at + WINDOW + 1] = -1e3 if k == 0 and len(own) > 2 * WINDOW + 1 else own[at]
        start, held = i + 1, 0
    return top, where


def evidence(top: np.ndarray) -> np.ndarray:
    """The highest window counts, the next one half as much, and neither beyond CLIP."""
    return np.clip(top, -CLIP, CLIP) @ np.array([1.0, 0.5])


class Model:
    """weights by triple, and the logistic's slope and offset."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights.astype(np.float32), slope, offset

    def score(self, texts: list[bytes]) -> np.ndarray:
        top, _ = highest(texts, self.weights)
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence(top) + self.offset, -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge SVM by Newton steps on the active rows; the last coefficient is the offset."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = RIDGE * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    for _ in range(30):
        active = y * (x @ beta) < 1
        a, w = x[active], weight[active]
        new = np.linalg.solve(ridge + (a * w[:, None]).T @ a, (a * w[:, None]).T @ y[active])
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    return beta


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, lightly smoothed."""
    scale = x.std() or 1.0
    z, beta = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * x.mean() / scale)


_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def windows_at(words: dict[bytes, None], bags: list[list[bytes]]) -> list[bytes]:
    """For each word the window of the first sentence that holds it, from the space before it on."""
    found: dict[bytes, bytes] = {}
    for sentence in (s for bag in bags for s in bag):
        spaced = b" " + sentence + b" "
        for m in _WORD.finditer(spaced.lower()):
            if m.group() in words and m.group() not in found:
                found[m.group()] = spaced[m.start() - 1 : m.start() - 1 + max(WINDOW, len(m.group()) + 2)]
    return [found[w] for w in words if w in found]


def train(bags: list[list[bytes]], toxic: list[int]) -> Model:
    """From the sentences of each document and its label."""
    y = np.array(toxic)
    if y.min(initial=1) or not y.max(initial=0):
        return Model(np.zeros(_SIZE), 0.0, -50.0)
    texts = [b". ".join(b) for b in bags]
    seen: dict[bytes, list[int]] = {}
    for text, label in zip(texts, toxic):
        for word in set(_WORD.findall(text.lower())):
            seen.setdefault(word, [0, 0])[label] += 1
    n = np.bincount(y, minlength=2)
    words = [w for w, c in seen.items() if sum(c) > 1 and len(w) > 2] or list(seen)
    share = {w: (seen[w][1] / n[1], seen[w][0] / n[0]) for w in words}
    rank = sorted(words, key=lambda w: ((share[w][0] - share[w][1]) * abs(share[w][0] - share[w][1]) / (share[w][0] + share[w][1]), w), reverse=True)
    common = sorted(words, key=lambda w: (-share[w][1], w))
    landmarks = windows_at(dict.fromkeys([*rank[: LANDMARKS // 2], *common[: LANDMARKS // 2]]), bags)
    profiles = [profile(w) for w in landmarks]
    used = np.unique(np.concatenate([index for index, _ in profiles]))
    place = np.full(_SIZE, len(used))
    place[used] = np.arange(len(used))
    phi = np.zeros((len(landmarks), len(used)))
    for row, (index, weight) in zip(phi, profiles):
        row[place[index]] = weight / (np.linalg.norm(weight) or 1.0)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-6
    nystroem = phi.T @ (vectors[:, keep] / np.sqrt(values[keep]))  # a row per triple: its share of each feature
    padded = np.vstack([nystroem, np.zeros(nystroem.shape[1])])  # triples of no landmark add nothing

    def features(windows: list[bytes]) -> np.ndarray:
        rows = np.frombuffer(b"".join(w[: WINDOW + SPAN - 1].translate(_CODE).ljust(WINDOW + SPAN - 1, b"\0") for w in windows), np.uint8).reshape(len(windows), -1)
        out = np.zeros((len(windows), nystroem.shape[1]))
        wide = rows.astype(np.int64)
        for a, b in STEPS:
            for i in range(WINDOW):
                x, y, z = wide[:, i], wide[:, i + a], wide[:, i + a + b]
                at = np.where((x > 0) & (y > 0) & (z > 0), place[(x * _SYMBOLS + y) * _SYMBOLS + z], len(used))
                out += DECAY ** (a + b + 1) * padded[at]
        return out

    strength = {w: i for i, w in enumerate(rank)}
    negative = [b" " + w + b" " for w in common[:400]]
    positive = []
    for text, label in zip(texts, toxic):
        if label:
            found = set(_WORD.findall(text.lower())) & strength.keys()
            if found:
                positive.append(b" " + min(found, key=strength.get) + b" ")
    weights = np.zeros(_SIZE)
    for _ in range(ROUNDS):
        x = np.vstack([features(positive), features(negative)])
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        balance = np.r_[np.full(len(positive), len(x) / 2 / max(1, len(positive))), np.full(len(negative), len(x) / 2 / max(1, len(negative)))]
        beta = _svm(x, sign, balance)
        weights[used] = nystroem @ beta[:-1]
        fresh, positive = [], []
        _, at = highest(texts, weights.astype(np.float32))
        for text, label, places in zip(texts, toxic, at.tolist()):
            spaced = b" " + text + b" "
            (positive if label else fresh).extend(spaced[i : i + WINDOW + SPAN - 1] for i in places)
        negative = list(dict.fromkeys([*negative, *fresh]))
    top, _ = highest(texts, weights.astype(np.float32))
    return Model(weights, *_logistic(evidence(top), y.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """From the rows of labels(doc_id, toxic), which the caller has restricted to those it may learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    dice = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_docs / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample_docs / max(1, sizes.get(0, 0)))))
    chosen = known.where(dice < rate)  # sample_docs a class in expectation
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "toxic", F.split("text", r"(?<=[.!?\n])\s+").alias("bag"))
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["bag"]))
    return train([[s.encode() for s in r["bag"]] for r in rows], [r["toxic"] for r in rows])


def _score_batches(shared):
    def run(batches):
        for batch in batches:
            score = shared.value.score(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_score_batches(shared), f"doc_id {column_type(docs, 'doc_id')}, score double, predicted int")


def query_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
