"""The pipeline's near-duplicate stage: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of SIMILAR or more link, exactly.

Equal sets are one word (a 64-bit digest) before any pair is made. Then, in two rounds:

1. SimHash proposes: fingerprints of the words' sets go through the vantage-point trees of simhash, whose spanning
   links join what differs in few bits. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, where no
   tree prunes, so prefix filtering proposes too: in one order of all shingles, two sets with similarity t share one
   of their first n - ceil(t n) + 1. Of a short list of sets that share one, all pairs are proposed that pass the
   bounds; of a long list only neighbours in a random order, which is linear in what is read. The proposals that
   hold make first components.
2. The rest: of each long list, the pairs that pass the bounds and whose first components differ. A large group of
   near copies is mostly one component by then and makes few pairs.

Prefix filtering loses no pair. The order is by hash, with the shingles found in many texts last; which ones those
are changes the cost and never the result. The bounds are by size, by place and by parity bitmaps: a bitmap has a bit
per shingle hash, flipped by each, so bitmaps differ in no more bits than sets differ in shingles. Lists carry
bitmaps of 256 bits, proposals meet whole ones, and whole sets decide. Components are those of simhash.

Defined results: words are as in simhash. Null text counts as empty; a text of SHINGLE words or fewer is one
shingle; empty texts are equal. An empty table gives none; the row travels in a struct, so columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import broadcast_if_small, column_type, stage, texts_of

SHINGLE = 5
#: The similarity as a fraction, so that bounds are whole numbers.
SIMILAR = (4, 5)
#: Shingles that go last in the order: found OFTEN times or more in chunks of texts, the most frequent HOT of them at most.
OFTEN, HOT = 64, 100_000
#: Shingles of a chunk, pairs that are looked at together, and word hashes a worker remembers.
CHUNK, PAIRS, CACHE = 4_000_000, 1_000_000, 250_000
#: Row numbers (8 bytes each) up to which they are broadcast.
NUMBERS = 1_000_000
#: Rows of a list up to which it is short, neighbours that are proposed in a long one, and 64-bit parts of a list's bitmaps.
SHORT, NEIGHBOURS, PARTS = 32, 2, 4


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = made = xxhash.xxh64_intdigest(word, 42)
        return made


_known = _Known()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The set of the text's shingle hashes, ascending."""
    import xxhash

    words = text.lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    if len(_known) > CACHE:
        _known.clear()
    one = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    return np.unique(_mix(sum(_mix(one[k : k + n] + _FACTORS[k]) * _FACTORS[k] for k in range(SHINGLE))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _digest(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def fingerprint(own: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(own):
        return 0
    octets = own.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + simhash._BYTE).ravel(), minlength=2048).reshape(8, 256) @ simhash._BITS
    return int.from_bytes(np.packbits(counts * 2 > len(own), axis=1, bitorder="little").tobytes(), "little")


def bitmap(own: np.ndarray, bits: int = 0) -> bytes:
    """Parity of the hashes by their low bits: a power of two of bits, if not given about one a hash, 64 at least."""
    bits = bits or max(64, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of how many hashes two sets do not share; the longer bitmap is folded to the shorter."""
    short, long = (np.frombuffer(m, np.uint8) for m in sorted((a, b), key=len))
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def _row_batches(batches):
    for batch in batches:
        sets = [shingles(t) for t in texts_of(batch.column(2))]
        words, prints = (pa.array(np.array([f(own) for own in sets], np.uint64).view(np.int64)) for f in (_digest, fingerprint))
        bits, sig = ([bitmap(own, n) for own in sets] for n in (0, 64 * PARTS))
        columns = [batch.column(0), batch.column(1), words, pa.array([len(own) for own in sets], pa.int32()), prints, pa.array(bits, pa.binary()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["number", "row", "word", "size", "fp", "bits", "sig"])


def _often_batches(batches):
    """(shingle, n) of those found in two texts or more of a chunk; equal sets count once."""
    seen, held, size = set(), [], 0

    def flush():
        every, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(every[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["shingle", "n"])

    for batch in batches:
        for word, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if word not in seen:
                seen.add(word)
                held.append(shingles(text))
                size += len(held[-1])
        if size > CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _prefix_batches(hot: np.ndarray):
    """(shingle, word, size, place) of each set's prefix; equal sets of a task come once."""

    def run(batches):
        seen = set()
        for batch in batches:
            parts = []
            for word, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                if word in seen:
                    continue
                seen.add(word)
                own = shingles(text)
                last = hot[np.searchsorted(hot, own) % len(hot)] == own if len(hot) else np.zeros(len(own), bool)
                n = len(own)
                first = np.r_[own[~last], own[last]][: n + (-n * SIMILAR[0] // SIMILAR[1]) + 1]
                if n:
                    parts.append((first, np.full(len(first), word, np.int64), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32)))
            if parts:
                shingle, word, size, place = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(word), pa.array(size), pa.array(place)], names=["shingle", "word", "size", "place"])

    return run


def _lists(batches):
    """The columns of rows that come sorted by shingle, in parts that end with a list."""
    held = None
    for batch in batches:
        new = [np.frombuffer(b"".join(texts_of(c)), np.uint64).reshape(-1, PARTS) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        held = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last list may go on
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _shared_batches(batches):
    """The rows of lists of two words or more, and whether the list is long."""
    for part in _lists(batches):
        _, back, n = np.unique(part[0], return_inverse=True, return_counts=True)
        shared = n[back] > 1
        yield pa.RecordBatch.from_arrays([*(pa.array(c[shared]) for c in part), pa.array(n[back][shared] > SHORT)], names=["shingle", "word", "size", "place", "long"])


class _Rows:
    """Rows of lists as columns, with the bounds on pairs of them."""

    def __init__(self, shingle, word, size, place, sig):
        self.word, self.size, self.place, self.sig = word, size.astype(np.int64), place.astype(np.int64), sig
        self.first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        self.last = np.r_[self.first[1:], len(shingle)]
        self.end = np.repeat(self.last, self.last - self.first)

    def fits(self, i: np.ndarray, j: np.ndarray, placed: bool = True) -> np.ndarray:
        """Whether pairs of different words pass the bounds; placed: also that by place, which holds where this is the first shingle they share."""
        up, down = SIMILAR
        x, y = self.size[i], self.size[j]
        at = (self.word[i] != self.word[j]) & (down * np.minimum(x, y) >= up * np.maximum(x, y))
        if placed:
            at &= (up + down) * np.minimum(x - self.place[i], y - self.place[j]) >= up * (x + y)
        # (up + down) * shared >= up * (x + y), and the sets differ in x + y - 2 * shared
        k = np.flatnonzero(at)
        at[k] = (down - up) * (x + y)[k] >= (up + down) * np.bitwise_count(self.sig[i[k]] ^ self.sig[j[k]]).sum(axis=1, dtype=np.int64)
        return at

    def pairs(self, i: np.ndarray, j: np.ndarray):
        a, b = self.word[i], self.word[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _first_batches(batches):
    """(a, b), a < b: all pairs of short lists within the bounds, and neighbours by word in long ones. Rows (shingle, word, size, place, sig) come sorted by shingle and word."""
    for part in _lists(batches):
        rows = _Rows(*part)
        short = rows.last - rows.first <= SHORT
        lists = np.repeat(short, rows.last - rows.first)
        i = np.arange(len(lists))
        for lag in range(1, max(SHORT, NEIGHBOURS + 1)):
            i = i[(i + lag < rows.end[i]) & (lists[i] | (lag <= NEIGHBOURS))]
            for own, placed in ((i[lists[i]], True), (i[~lists[i]], False)):
                at = own[rows.fits(own, own + lag, placed)]
                if len(at):
                    yield rows.pairs(at, at + lag)


def _rest_batches(batches):
    """(a, b), a < b: pairs of different roots within the bounds. Rows (shingle, word, size, place, sig, root) come sorted by shingle and size."""
    for *part, root in _lists(batches):
        rows = _Rows(*part)
        for a, b in zip(rows.first, rows.last):
            roots, n = np.unique(root[a:b], return_counts=True)
            odd = a + np.flatnonzero(root[a:b] != roots[n.argmax()])  # all pairs of different roots have one of these
            low = a + np.searchsorted(rows.size[a:b] * SIMILAR[1], rows.size[odd] * SIMILAR[0])
            high = a + np.searchsorted(rows.size[a:b] * SIMILAR[0], rows.size[odd] * SIMILAR[1], "right")
            step = max(1, PAIRS // (b - a))
            for k in range(0, len(odd), step):
                o, x, n = odd[k : k + step], low[k : k + step], (high - low)[k : k + step]
                i = np.repeat(o, n)
                j = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + np.repeat(x, n)
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                at = rows.fits(i, j)
                if at.any():
                    yield rows.pairs(i[at], j[at])


def _bound_batches(batches):
    """The pairs that their sizes and bitmaps do not rule out."""
    up, down = SIMILAR
    for batch in batches:
        size_a, size_b, bits_a, bits_b = (batch.column(i).to_pylist() for i in range(2, 6))
        # (up + down) * shared >= up * (a + b), and the sets differ in a + b - 2 * shared
        at = [(down - up) * (x + y) >= (up + down) * differ(p, q) for x, y, p, q in zip(size_a, size_b, bits_a, bits_b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(at, pa.bool_()))


def _similar_batches(batches):
    for batch in batches:
        a, b, left, right = batch.columns
        at = [similar(shingles(x), shingles(y)) for x, y in zip(texts_of(left), texts_of(right))]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(at, pa.bool_()))


def _sided(table: DataFrame, side: str, *columns: str) -> DataFrame:
    """The table's word as `side`, and its columns by names of that side."""
    return table.select(F.col("word").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def verified(pairs: DataFrame, prints: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs(a, b) that are similar."""
    known = pairs.distinct().join(_sided(words, "a", "size", "bits"), "a").join(_sided(words, "b", "size", "bits"), "b")
    held = stage(known.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(_bound_batches, "a bigint, b bigint"), "pairs")
    numbers = stage(held.select(F.explode(F.array("a", "b")).alias("word")).distinct().join(words, "word").select("first.number"), "candidates")
    asked = stage(prints.join(broadcast_if_small(numbers, NUMBERS), "number").select("word", F.col("row.text").cast("binary").alias("text")), "asked")
    both = held.join(_sided(asked, "a", "text"), "a").join(_sided(asked, "b", "text"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar_batches, "a bigint, b bigint")


def proposed(words: DataFrame) -> DataFrame:
    """(a, b): words of one fingerprint with their least, and the spanning links of simhash between fingerprints' least words."""
    least = stage(words.groupBy("fp").agg(F.min("word").alias("rep")), "prints")
    same = words.join(least, "fp").where("word <> rep").select(F.col("rep").alias("a"), F.col("word").alias("b"))
    ends = [least.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}")) for side in "ab"]
    near = simhash.links(least.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return same.unionByName(near)


def links(prints: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b): a set of similar pairs of different words that connects what all similar pairs connect. prints(number, row, word), words(word, first.number, size, fp, bits)."""
    texts = prints.select("word", F.col("row.text").cast("binary").alias("text"))
    often = texts.mapInArrow(_often_batches, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    hot = np.sort(np.array([r["shingle"] for r in often.orderBy(F.desc("n"), "shingle").limit(HOT).collect()], np.int64).view(np.uint64))  # HOT rows at most
    prefixes = texts.mapInArrow(_prefix_batches(hot), "shingle bigint, word bigint, size int, place int")
    met = prefixes.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_shared_batches, "shingle bigint, word bigint, size int, place int, long boolean")
    met = stage(met, "met")
    signed = met.join(words.select("word", "sig"), "word")
    lists = signed.select("shingle", "word", "size", "place", "sig").repartition("shingle").sortWithinPartitions("shingle", "word")
    near = stage(verified(lists.mapInArrow(_first_batches, "a bigint, b bigint").unionByName(proposed(words)), prints, words), "near")
    roots = simhash.components(near).select(F.col("node").alias("word"), "root")
    rooted = signed.where("long").join(roots, "word", "left").select("shingle", "word", "size", "place", "sig", F.coalesce("root", "word").alias("root"))
    rest = rooted.repartition("shingle").sortWithinPartitions("shingle", "size").mapInArrow(_rest_batches, "a bigint, b bigint")
    return near.unionByName(verified(rest, prints, words))


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each group stays, that with the smallest doc_id; a row without an id stays only where its group has none.

    Rows are told apart by a number written beside them, not by doc_id, which repeats in some tables: rows of one
    doc_id and different texts are in groups of their own, and repeats of a row are one group. Only the numbers of
    rows that go are brought to the rows, by broadcast up to NUMBERS of them.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("text"))
    prints = stage(rows.mapInArrow(_row_batches, f"number bigint, row {column_type(rows, 'row')}, word bigint, size int, fp bigint, bits binary, sig binary"), "numbered")
    least = F.struct(F.col("row.doc_id").isNull().alias("bare"), "row.doc_id", "number")
    words = stage(prints.groupBy("word").agg(F.min(least).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("sig").alias("sig")), "words")
    tops = simhash.components(links(prints, words)).select(F.col("node").alias("word"), "root")
    groups = words.join(tops, "word", "left").groupBy(F.coalesce("root", "word").alias("root")).agg(F.min("first").alias("first"))
    kept = stage(groups.select("first.number"), "kept")
    gone = stage(prints.select("number").join(kept, "number", "left_anti"), "gone")
    return prints.join(broadcast_if_small(gone, NUMBERS), "number", "left_anti").select("row.*")
