"""Best-fit packing of tokenized documents into sequences of SEQUENCE tokens.

Length-histogram planning: a document's ids are cut into pieces of at most SEQUENCE (only longer documents are
cut; the remainder comes first), the pieces are counted by length, and best-fit decreasing runs over those
counts. The histogram has at most SEQUENCE rows and the plan a few thousand runs at any corpus size, as equal
bins move together. Pieces then take their planned slots by their rank within their length.

The ids are those of the `tokenizers` file; the tests hold them equal on whole texts. They are made by the same
vocabulary's rank file, word by word with a cache: a single space before a character that is no white space
always begins a new pre-token, so a text may be cut there.

Defined results: null or empty text is the single id END. The file's added tokens in a text become their ids, as the
`tokenizers` library does by default.
Repeated rows are packed as often as they come. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, column_type, rank_offsets, stage

SEQUENCE = 2048
END = 0
#: Words whose ids a worker remembers; it starts afresh beyond.
CACHE = 250_000

_CUT = re.compile(r"(?= [^\s])")


class Encoder:
    """Text to little-endian unsigned 32-bit ids."""

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._added = {token: np.array([at], "<u4").tobytes() for token, at in added}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._split is None or not self._split.search(text):
            return self._ordinary(text)
        return b"".join(self._added.get(part) or self._ordinary(part) for part in self._split.split(text) if part)

    def _ordinary(self, text: str) -> bytes:
        known = self._known
        if len(known) > CACHE:
            known.clear()
        first, *rest = text.split(" ")
        out = [self._ids(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if not word or word[0].isspace():  # runs of white space: cut only where it is safe
                    return b"".join(map(self._ids, _CUT.split(text)))
                ids = known[word] = self._ids(" " + word)
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def added_tokens(ranks_path: str) -> tuple[tuple[str, int], ...]:
    """(token, id) of the added tokens in the tokenizer file beside the rank file, if there is one."""
    beside = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(beside):
        return ()
    with open(beside, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f).get("added_tokens", []))


def encoder(ranks_path: str, pattern: str) -> Encoder:
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = Encoder(ranks_path, pattern, added_tokens(ranks_path))
    return _ENCODERS[ranks_path, pattern]


def vocabulary() -> tuple[str, str]:
    """The default vocabulary's rank file and split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(length: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the rest first."""
    head = length % most or min(length, most)
    return [(0, head), *((s, most) for s in range(head, length, most))]


def _piece_batches(ranks_path: str, pattern: str, most: int):
    def run(batches):
        from pyspark import TaskContext

        made, chunk = np.zeros(most + 1, np.int64), TaskContext.get().partitionId()
        enc, end = encoder(ranks_path, pattern), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview((enc.encode(text) if text else b"") + end)
                for piece, (start, n) in enumerate(cut(len(ids) // 4, most)):
                    rows.append((at, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), int(made[n])))
                    made[n] += 1
            at, piece, start, n, crc, rank = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([chunk] * len(n), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "local_rank"],
            )

    return run


def pieces(docs: DataFrame, ranks_path: str, pattern: str, most: int = SEQUENCE) -> DataFrame:
    """One row per piece, with its chunk and its rank within chunk and length."""
    kind = column_type(docs, "doc_id")
    return docs.select("doc_id", "text").mapInArrow(_piece_batches(ranks_path, pattern, most), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, chunk int, local_rank long")


def plan(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first_rank, n, first_sequence, per_sequence, offset).

    Ranks first_rank .. first_rank + n - 1 of a length go per_sequence to a sequence, from first_sequence on,
    each at offset plus what its fellows in the sequence take.
    """
    runs, groups, opened = [], {}, 0  # groups: room left -> [(first sequence, how many)]
    rooms: list[int] = []  # sorted rooms that have a group

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, per = most, most // length
                first, bins = opened, -(-left // per)
                opened += bins
            per = room // length
            full = min(bins, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, most - room))
                put(room - per * length, first, full)
                rank, left, first, bins = rank + full * per, left - full * per, first + full, bins - full
            if left and bins:  # fewer than per are left: they share one sequence
                runs.append((length, rank, left, first, left, most - room))
                put(room - left * length, first, 1)
                left, first, bins = 0, first + 1, bins - 1
            put(room, first, bins)
    return runs


def pack(docs: DataFrame, ranks_path: str, pattern: str, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    made = stage(pieces(docs, ranks_path, pattern, most), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `most` rows at most
    runs = spark.createDataFrame(plan(counts, most) or [(0, 0, 0, 0, 1, 0)], "length long, first_rank long, n long, first_sequence long, per long, at long")
    base = broadcast_if_small(stage(rank_offsets(made, "length"), "offsets"))
    ranked = made.join(base, ["chunk", "length"]).withColumn("rank", F.col("local_rank") + F.col("base"))
    within = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (within >= 0) & (within < F.col("n"))).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + within % F.col("per") * ranked["length"]).cast("long").alias("offset")
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, *vocabulary())
