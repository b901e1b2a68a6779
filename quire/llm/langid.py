"""Language ID by bit-sliced Bloom filters of byte n-grams.

Position p of the filter holds, for each language, one bit; read across languages it is a mask. The AND of an
n-gram's HASHES masks names all languages that contain it (and, rarely, others). Per document the mask bits are
counted for each language and corrected for that language's false-positive rate (its share of set bits to the
power HASHES); the highest corrected share decides, ties going to the more frequent language in training.

Training: each language's n-grams come from a hash-chosen sample of labelled rows, SAMPLE_ROWS a language in
expectation. A language contains an n-gram that makes up at least MIN_RATE of its n-grams (so 1/MIN_RATE
n-grams at most) and at least SHARE of the highest rate among languages. Masks are uint64 words, as many
planes of them as languages need.

Defined results: `und` with score 0 for null text or text without a letter. A null doc_id is not held out and
never learned from. Repeated rows are scored alike. With nothing to learn from, every text is `und`. An empty
table gives no rows; only doc_id, text and lang are read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column_type, crc_mod, stage, texts_of

GRAM = 4
HASHES = 3
POSITIONS = 1 << 19
SAMPLE_ROWS = 1500
MIN_RATE = 2e-5
SHARE = 0.2
UNKNOWN = "und"
#: Least score at which the pipeline keeps a document.
KEEP_SCORE = 0.1
#: Text looked up at a time: the arrays of a block take about 60 bytes a byte.
BLOCK_BYTES = 500_000

_LETTERS = string.ascii_letters.encode()
_FOLD = bytes(c if c >= 128 else (c | 32 if c in _LETTERS else 32) for c in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def has_letter(text: bytes) -> bool:
    if text.translate(None, _NOT_ASCII_LETTER):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


_NOT_ASCII_LETTER = bytes(c for c in range(256) if c not in _LETTERS)


def _blocks(texts: list[bytes]):
    """(first index, folded texts) of about BLOCK_BYTES each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK_BYTES or i + 1 == len(texts):
            yield start, [b" " + t.translate(_FOLD) + b"  " for t in texts[start : i + 1]]
            start, held = i + 1, 0


def _grams(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the joined block as numbers, and each text's first and end place among them."""
    data = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
    n = max(0, len(data) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for k in range(GRAM):
        grams |= data[k : k + n] << np.uint32(8 * k)
    ends = np.cumsum([len(t) for t in folded])
    starts = np.r_[0, ends[:-1]]
    return grams, np.minimum(starts, n), np.clip(ends - GRAM + 1, np.minimum(starts, n), n)


def _places(grams: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - POSITIONS.bit_length() + 1)
    wide = grams.astype(np.uint64)
    return [((wide * m) >> shift).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


class Filters:
    """The learned filters. languages in order of training frequency; planes: (planes, POSITIONS) uint64."""

    def __init__(self, grams_of: dict[str, np.ndarray]):
        self.languages = list(grams_of)
        self.planes = np.zeros((max(1, -(-len(self.languages) // 64)), POSITIONS), np.uint64)
        for i, grams in enumerate(grams_of.values()):
            for place in _places(np.asarray(grams, np.uint32)):
                self.planes[i // 64][place] |= np.uint64(1 << (i % 64))
        fill = [np.count_nonzero(self.planes[i // 64] & np.uint64(1 << (i % 64))) / POSITIONS for i in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): corrected share of each text's n-grams that the language contains."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, folded in _blocks(texts):
            grams, starts, ends = _grams(folded)
            places = _places(grams)
            n = np.maximum(ends - starts, 1)
            for p, plane in enumerate(self.planes):
                mask = plane[places[0]]
                for place in places[1:]:
                    mask &= plane[place]
                for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                    upto = np.zeros(len(grams) + 1, np.int32)  # n-grams of the language before each place
                    np.cumsum(((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int32), out=upto[1:])
                    seen = (upto[ends] - upto[starts]) / n
                    out[first : first + len(folded), i] = np.clip((seen - self.false_rate[i]) / (1 - self.false_rate[i]), 0, 1)
        return out


def _count_batches(batches):
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = texts_of(batch.column(0))
        for lang in set(langs):
            for _, folded in _blocks([t for t, x in zip(texts, langs) if x == lang]):
                grams, starts, ends = _grams(folded)
                inside = np.zeros(len(grams) + 1, np.int8)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                values, n = np.unique(grams[np.cumsum(inside[:-1]) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from docs(doc_id, text, lang), which the caller has restricted to rows it may learn from."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return Filters({})
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    rate = docs.sparkSession.createDataFrame([(x, min(1.0, sample_rows / sizes[x])) for x in languages], "lang string, rate double")
    dice = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(rate), "lang").where(dice < F.col("rate"))
    counted = chosen.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(_count_batches, "lang string, gram long, n long")
    counted = stage(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counted.join(F.broadcast(total), "lang").where(F.col("n") >= MIN_RATE * F.col("all")).select("lang", "gram", (F.col("n") / F.col("all")).alias("rate"))
    rows = rates.toPandas()  # 1/MIN_RATE rows a language at most
    best = rows.groupby("gram")["rate"].transform("max")
    rows = rows[rows["rate"] >= SHARE * best]
    return Filters({x: np.sort(rows["gram"][rows["lang"] == x].to_numpy(np.int64)) for x in languages})


def _predict_batches(shared):
    def run(batches):
        filters = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            if filters.languages:
                shares = filters.shares(texts)
                best = shares.argmax(axis=1)
                letters = np.array([has_letter(t) for t in texts], bool)
                names = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                score = np.where(letters, shares[np.arange(len(texts)), best], 0.0) if len(texts) else np.zeros(0)
            else:
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """docs' columns named in keep as struct `row`, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(_predict_batches(shared), f"row {column_type(rows, 'row')}, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(crc_mod("doc_id", 4) != 2)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scored = predict(docs, fit(learnable(docs)), ["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without a letter go, and those of which no language contains KEEP_SCORE of the n-grams."""
    scored = predict(docs, fit(learnable(docs)), docs.columns)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= KEEP_SCORE)).select("row.*")
