"""Media columns: motion-JPEG in AVI.

Bytes become grey frames of SIDE x SIDE 8-bit samples, each coded on its own as a lossless JPEG (SOF3, left
predictor) in an AVI file with an idx1 index. Reading walks the RIFF chunks and takes the video frames by the index,
whose offsets may count from the movi list or from the file's start, or without one by walking that list and the rec
lists in it. A frame's size and Huffman table come from its own headers. Shots are cut where the histogram difference of neighbouring frames exceeds the mean plus
CUT_SIGMAS standard deviations of the differences around it; each shot is a timed clip.

Frames of many documents are coded and decoded together: numpy steps over the samples of a frame, with one
lane per frame, FRAMES at a time. A task holds about BLOCK_BYTES of documents at a time, at least one whole document
with its file and its samples.

Defined results: a null text counts as empty, and an empty one gives one frame of padding. Equal bytes give
equal files. Repeated rows each give a row; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column_type, texts_of

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
PAD = 255
FRAMES = 1024
BINS = 16
WINDOW = 12
CUT_SIGMAS = 3.0
#: Documents coded in one go hold about so many bytes.
BLOCK_BYTES = 4_000_000

# Code lengths and symbols of the standard luminance DC table (ITU-T T.81, table K.3).
_DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_SYMBOLS = tuple(range(12))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol, from the counts."""
    code, codes, lengths = 0, [], []
    for bits, n in enumerate(_DC_COUNTS, 1):
        for _ in range(n):
            codes.append(code)
            lengths.append(bits)
            code += 1
        code <<= 1
    return np.array(codes, np.int64), np.array(lengths, np.int64)


_CODE, _LENGTH = _codes()
_SIZE = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)
_EXTRA = np.array([d if d >= 0 else d + (1 << abs(d).bit_length()) - 1 for d in range(-255, 256)], np.int64)
#: By difference + 255: its whole code word and the word's length.
_WORD, _BITS = (_CODE[_SIZE] << _SIZE) | _EXTRA, _LENGTH[_SIZE] + _SIZE
#: Bits of a code word and its difference that can be looked up at once.
MOST_BITS = 24


@lru_cache(maxsize=8)
def _lookup(counts: bytes, symbols: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """How many bits to look at, and by them the difference and the bits it took, of a Huffman table given as in a DHT segment; 0 bits mark an invalid word."""
    code, at, rows = 0, 0, []
    for bits, n in enumerate(counts, 1):
        for size in symbols[at : at + n]:
            rows.append((code, bits, size))
            code += 1
        at, code = at + n, code << 1
    peek = max((bits + size for _, bits, size in rows), default=1)
    if peek > MOST_BITS:
        raise ValueError("the table's words are too long")
    diff, took = np.zeros(1 << peek, np.int16), np.zeros(1 << peek, np.int8)
    for code, bits, size in rows:
        extra = np.arange(1 << size)
        values = np.where(extra >> (size - 1) & 1 if size else extra > -1, extra, extra - (1 << size) + 1)
        first, each = code << (peek - bits), 1 << (peek - bits - size)
        diff[first : first + (each << size)] = np.repeat(values, each)
        took[first : first + (each << size)] = bits + size
    return peek, diff, took


_HEAD = b"".join(
    [
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">HB", 19 + len(_DC_SYMBOLS), 0) + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS),
        b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0),
        b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0),
    ]
)
_TAIL = b"\xff\xd9"
_OWN = (SIDE, SIDE, bytes(_DC_COUNTS), bytes(_DC_SYMBOLS))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(n, FRAME) bytes to n JPEG files."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    at = diff.reshape(len(x), FRAME) + 255
    bits = _BITS[at]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) // 8
    first = np.r_[0, np.cumsum(size)]
    place = ends - bits + 8 * first[:-1, None]
    byte, shift = (place >> 3).ravel(), 24 - bits - (place & 7)
    word = (_WORD[at] << shift).ravel()
    total = int(first[-1])
    stream = np.zeros(total + 2, np.int64)
    for k in range(3):
        stream += np.bincount(byte + k, weights=(word >> (16 - 8 * k)) & 255, minlength=total + 2).astype(np.int64)[: total + 2]
    spare = 8 * size - ends[:, -1]
    stream[first[1:] - 1] |= (1 << spare) - 1  # the last byte is filled with ones
    stream = stream[:total].astype(np.uint8)
    marks = np.flatnonzero(stream == 255)
    stuffed = np.insert(stream, marks + 1, 0).tobytes()
    edge = (first + np.searchsorted(marks, first)).tolist()
    return [_HEAD + stuffed[a:b] + _TAIL for a, b in zip(edge, edge[1:])]


def _scan(jpeg: bytes) -> tuple[tuple, bytes]:
    """A frame's (height, width, counts, symbols) from its headers, and its entropy-coded part."""
    if jpeg.startswith(_HEAD) and jpeg.endswith(_TAIL):  # as written here
        return _OWN, jpeg[len(_HEAD) : -2]
    at, tables, size = 2, {}, None
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while jpeg[at : at + 1] == b"\xff":
        mark, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif mark == 0xC3 and body[0] == 8 and body[5] == 1:
            size = struct.unpack(">HH", body[1:5])
        elif 0xC0 <= mark <= 0xCF and mark != 0xCC or mark == 0xDD and body != b"\0\0":
            raise ValueError("no lossless grey frame without restarts")
        elif mark == 0xDA:
            if size is None or body[0] != 1 or body[3:6] != b"\1\0\0" or body[2] >> 4 not in tables:
                raise ValueError("no scan with the left predictor")
            end = jpeg.rfind(_TAIL)
            return (*size, *tables[body[2] >> 4]), jpeg[at : end if end >= at else len(jpeg)]
    raise ValueError("no scan")


def _decode(kind: tuple, scans: list[bytes]) -> np.ndarray:
    """The (n, height * width) samples of n scans of one kind."""
    height, width, counts, symbols = kind
    peek, diff_of, took = _lookup(counts, symbols)
    stream = np.frombuffer(b"".join(s.replace(b"\xff\x00", b"\xff") for s in scans) + bytes(4), np.uint8).astype(np.uint32)
    ahead = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
    sizes = [len(s) - s.count(b"\xff\x00") for s in scans]
    place = 8 * np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    end, diff = place + 8 * np.array(sizes), np.empty((height * width, len(scans)), np.int16)
    for i in range(height * width):
        word = (ahead[np.minimum(place >> 3, len(ahead) - 1)].astype(np.int64) >> (32 - peek - (place & 7))) & ((1 << peek) - 1)
        diff[i] = diff_of[word]
        place += took[word]
    if (place > end).any() or (place <= end - 8).any():
        raise ValueError("a frame is cut off or has more than its samples")
    diff = diff.T.reshape(-1, height, width).astype(np.int32)
    diff[:, :, 0] = 128 + np.cumsum(diff[:, :, 0], axis=1)
    return (np.cumsum(diff, axis=2) & 255).astype(np.uint8).reshape(len(scans), height * width)


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """The samples of each JPEG file; files of one kind are decoded together, FRAMES at a time."""
    kinds: dict[tuple, list[int]] = {}
    scans = []
    for i, (kind, scan) in enumerate(map(_scan, jpegs)):
        kinds.setdefault(kind, []).append(i)
        scans.append(scan)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(jpegs)
    for kind, own in kinds.items():
        for k in range(0, len(own), FRAMES):
            for i, frame in zip(own[k : k + FRAMES], _decode(kind, [scans[i] for i in own[k : k + FRAMES]])):
                out[i] = frame
    return out


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(jpegs: list[bytes]) -> bytes:
    longest = max(map(len, jpegs), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, longest * FPS, 0, 0x10, len(jpegs), 0, 1, longest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(jpegs), longest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    movie, index, at = [b"movi"], [], 4
    for jpeg in jpegs:
        chunk = _chunk(b"00dc", jpeg)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        movie.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int):
    """(name, place of its body, size) of the chunks from a place on."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def _walk(data: bytes, at: int, end: int):
    """The video frames of a movi list in their order, those in rec lists included."""
    for name, body, size in _chunks(data, at, end):
        if name == b"LIST" and data[body : body + 4] == b"rec ":
            yield from _walk(data, body + 4, body + size)
        elif name[2:] in (b"dc", b"db"):
            yield data[body : body + size]


def read_avi(data: bytes) -> list[bytes]:
    """The video frames by the index, in its order, or without one as they stand."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movie, index = None, None
    for name, body, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[body : body + 4] == b"movi":
            movie = body, body + size
        elif name == b"idx1":
            index = np.frombuffer(data, [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, body)
    if movie is None:
        raise ValueError("no frames")
    if index is None:
        return list(_walk(data, movie[0] + 4, movie[1]))
    frames = index[np.char.endswith(index["name"], b"dc") | np.char.endswith(index["name"], b"db")]
    if not len(frames):
        return []
    first = int(frames["at"][0])
    base = movie[0] if data[movie[0] + first : movie[0] + first + 4] == frames["name"][0] else 0
    return [data[base + o + 8 : base + o + 8 + n] for o, n in zip(frames["at"].tolist(), frames["size"].tolist())]


def cuts(frames: np.ndarray) -> np.ndarray:
    """Indexes of the frames that begin a shot, 0 included."""
    n = len(frames)
    if n < 3:
        return np.zeros(1, np.int64)
    cells = (frames >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    bars = np.bincount(cells.ravel(), minlength=BINS * n).reshape(n, BINS)
    jump = np.abs(np.diff(bars, axis=0)).sum(axis=1).astype(np.float64)
    total, square = np.r_[0, np.cumsum(jump)], np.r_[0, np.cumsum(jump * jump)]
    low, high = np.maximum(np.arange(n - 1) - WINDOW, 0), np.minimum(np.arange(n - 1) + WINDOW + 1, n - 1)
    mean = (total[high] - total[low]) / (high - low)
    spread = np.sqrt(np.maximum((square[high] - square[low]) / (high - low) - mean * mean, 0))
    return np.r_[0, np.flatnonzero(jump > mean + CUT_SIGMAS * spread + 1e-9) + 1]


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def encode_documents(texts: list[bytes]) -> list[bytes]:
    """One AVI file per text."""
    padded = [pad(t) for t in texts]
    samples = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME)
    jpegs = [j for i in range(0, len(samples), FRAMES) for j in encode_frames(samples[i : i + FRAMES])]
    edge = np.r_[0, np.cumsum([len(p) // FRAME for p in padded])].tolist()
    return [write_avi(jpegs[a:b]) for a, b in zip(edge, edge[1:])]


def decode_documents(files: list[bytes]) -> list[np.ndarray]:
    """The (frames, samples) of each file, whose frames must be of one size."""
    read = [read_avi(f) for f in files]
    frames = decode_frames([j for r in read for j in r])
    edge = np.r_[0, np.cumsum([len(r) for r in read])].tolist()
    return [np.stack(frames[a:b]) if b > a else np.zeros((0, FRAME), np.uint8) for a, b in zip(edge, edge[1:])]


def _blocks(batches):
    """(rows, their last column's bytes) of about BLOCK_BYTES each."""
    for batch in batches:
        sizes, start, held = pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_pylist(), 0, 0
        for i, size in enumerate(sizes):
            held += size + FRAME
            if held >= BLOCK_BYTES or i + 1 == len(sizes):
                rows = batch.slice(start, i + 1 - start)
                yield rows, texts_of(rows.columns[-1])
                start, held = i + 1, 0


def _encode_batches(batches):
    for rows, texts in _blocks(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(len, texts), pa.int64()), pa.array(encode_documents(texts), pa.binary())], names=["doc_id", "n_bytes", "media"])


def clips_of(frames: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(clip, first_frame, end_frame, start_s, end_s) of each shot."""
    first = cuts(frames).tolist() if len(frames) else []
    return [(k, a, b, a / FPS, b / FPS) for k, (a, b) in enumerate(zip(first, [*first[1:], len(frames)]))]


def _clip_batches(batches):
    for block, files in _blocks(batches):
        rows = [(i, *clip) for i, frames in enumerate(decode_documents(files)) for clip in clips_of(frames)]
        at, *rest = zip(*rows) if rows else [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, k) for x, k in zip(rest, kinds))], names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI file."""
    kind = column_type(docs, "doc_id")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_encode_batches, f"doc_id {kind}, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, end_frame, start_s, end_s) of media(doc_id, media)."""
    kind = column_type(media, "doc_id")
    return media.select("doc_id", "media").mapInArrow(_clip_batches, f"doc_id {kind}, clip int, first_frame long, end_frame long, start_s double, end_s double")


_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _digest_batches(batches):
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CLIPS)
    for block, files in _blocks(batches):
        rows = []
        for file, frames in zip(files, decode_documents(files)):
            payload, clips = frames.tobytes(), clips_of(frames)
            told = f"clips={len(clips)};longest={max(b - a for _, a, b, *_ in clips) / FPS:.2f}s;mean={frames.mean(dtype=np.float64):.3f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), told, [dict(zip(("clip", "first_frame", "end_frame", "start_s", "end_s"), c)) for c in clips]))
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", *names])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, and the timed clips of each document's film."""
    kind, clip = column_type(docs, "doc_id"), "struct<clip int, first_frame bigint, end_frame bigint, start_s double, end_s double>"
    return encode_media(docs).mapInArrow(_digest_batches, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<{clip}>")
