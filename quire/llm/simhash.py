"""SimHash near-duplicates by vantage-point trees.

Fingerprints within RADIUS bits of each other link; a document's component is the smallest doc_id reachable.

All distances are whole Hamming distances, and all pruning is the triangle bound |d(x,v) - d(y,v)| <= d(x,y):

* Across the cluster. A routing tree is built over a bounded sample of the fingerprints: a node has a vantage
  point from the sample and the median distance to it, inside goes left, outside goes right. A fingerprint is at
  home in the one leaf it falls into - a shard - and a guest in the shards that the bound cannot rule out. Of a
  pair that a node parts, only the outer one visits, so no pair is dealt twice at that node.
* Within a shard. A second tree is built over all words at home, down to leaves of LEAF words; homes and guests
  go down it together and skip the branches that the bound rules out.

Every pair within the radius meets in the shard where one of them is at home, so the links are exact. A shard
reports a spanning forest of its links, never its pairs. Components are then contracted round by round in
DataFrames. Guests of a shard are taken in blocks, so a task holds the words at home and one block.

Costs: random fingerprints lie 32 +- 4 apart, so a node rules out one side for about four words in ten; the README
has the measured visits per word.

Defined results: null text counts as empty; a text without words has fingerprint 0 and links like any other.
Repeated rows are returned as often as they come. Null doc_ids take part but never name a component while a
group has another id. The pipeline's stage has its own rule and module, near_copies. Only doc_id and text are
read, so extra columns cannot clash; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column_type, stage, texts_of

RADIUS = 3
SHINGLE = 3
#: Fingerprints at home in a shard, about; more where the sample allows no more shards.
SHARD_WORDS = 4096
#: Fingerprints in the routing tree's sample, in expectation and at most a quarter of all; a leaf keeps LEAST of them.
SAMPLE_WORDS, LEAST = 262_144, 16
LEAF = 64
#: Guests of a shard that are looked up at a time.
GUESTS = 32_768

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8) * 256)[None, :]


def fingerprint(text: bytes) -> int:
    """64-bit majority fingerprint of the text's word shingles, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20\x09-\x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -SHINGLE] + 1]
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""
    kind = column_type(docs, "doc_id")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp bigint")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _descend(words: np.ndarray, own: np.ndarray, asked: np.ndarray, links: _Union, radius: int) -> None:
    """Build the tree over `own` and send the queries `asked` down it in one go; unite what links (all are indexes into words)."""
    if not len(asked):
        return
    if len(own) <= LEAF:
        near = np.bitwise_count(words[asked][:, None] ^ words[own][None, :]) <= radius
        hit = near.any(axis=1)
        near, asked = near[hit], asked[hit]
        for q, j in zip(asked.tolist(), own[near.argmax(axis=1)].tolist() if len(near) else []):
            links.unite(q, j)
        shared = near.T.astype(np.float32) @ near.astype(np.float32) > 0  # leaf words that one query reaches
        for i, j in zip(*np.nonzero(np.triu(shared, 1))):
            links.unite(int(own[i]), int(own[j]))
        return
    vantage = words[own[len(own) // 2]]
    far = np.bitwise_count(words[own] ^ vantage).astype(np.int64)
    middle = int(np.median(far))
    inner = far <= middle
    if inner.all():
        inner = far < middle
    if not inner.any():  # all at one distance: nothing to prune, so halve by position
        half = len(own) // 2
        _descend(words, own[:half], asked, links, radius)
        _descend(words, own[half:], asked, links, radius)
        return
    reach = np.bitwise_count(words[asked] ^ vantage).astype(np.int64)
    _descend(words, own[inner], asked[reach <= far[inner].max() + radius], links, radius)
    _descend(words, own[~inner], asked[reach >= far[~inner].min() - radius], links, radius)


def _forest(links: _Union, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = np.fromiter((links.find(i) for i in range(len(words))), np.int64, len(words))
    moved = root != np.arange(len(words))
    return words[moved], words[root[moved]]


def spanning_links(words: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (word, representative) that connect the same words as all pairs within the radius would."""
    links, every = _Union(len(words)), np.arange(len(words))
    _descend(words, every, every, links, radius)
    return _forest(links, words)


def guest_links(homes: np.ndarray, guests: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The same for all pairs of a guest and a word at home."""
    words = np.concatenate([homes, guests])
    links = _Union(len(words))
    _descend(words, np.arange(len(homes)), np.arange(len(homes), len(words)), links, radius)
    return _forest(links, words)


class Router:
    """The routing tree: nodes as (vantage point, most distance inside, left, right), leaves as shard numbers."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS):
        self.radius, self.nodes, self.shards = radius, [], 0
        self.root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        """A node's place, or a shard as its number's complement."""
        if depth and len(sample) >= 2 * LEAST:
            tried = sample[:: max(1, len(sample) // 8)][:8]
            vantage = max(tried.tolist(), key=lambda v: float(np.bitwise_count(sample ^ np.uint64(v)).std()))  # the widest spread prunes most
            far = np.bitwise_count(sample ^ np.uint64(vantage)).astype(np.int64)
            most = int(np.median(far))
            inner = far <= most
            if inner.all():
                most -= 1
                inner = far <= most
            if inner.any():
                at = len(self.nodes)
                self.nodes.append(None)
                self.nodes[at] = (vantage, most, self._grow(sample[inner], depth - 1), self._grow(sample[~inner], depth - 1))
                return at
        self.shards += 1
        return -self.shards

    def route(self, words: np.ndarray):
        """(shard, guest, words) parts: each word once at home, and as a guest wherever a word within the radius may be at home."""
        todo = [(self.root, np.arange(len(words)), np.zeros(len(words), bool))]
        while todo:
            node, at, guest = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, guest, words[at]
                continue
            vantage, most, left, right = self.nodes[node]
            far = np.bitwise_count(words[at] ^ np.uint64(vantage)).astype(np.int64)
            inner = far <= most
            goes = np.where(guest, far <= most + self.radius, inner | (far <= most + self.radius))
            todo.append((left, at[goes], (guest | ~inner)[goes]))
            goes = np.where(guest, far > most - self.radius, ~inner)
            todo.append((right, at[goes], guest[goes]))


def _route_batches(shared):
    def run(batches):
        for batch in batches:
            parts = list(shared.value.route(batch.column(0).to_numpy().view(np.uint64)))
            if parts:
                shard = np.concatenate([np.full(len(w), k, np.int32) for k, _, w in parts])
                guest, words = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(guest.astype(np.int8)), pa.array(words.view(np.int64))], names=["shard", "guest", "fp"])

    return run


def _shard_links(radius: int):
    """(a, b) of rows (shard, guest, fp) that come sorted by shard, those at home first."""

    def edges(found):
        a, b = found
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        now, homes, coming, closed = None, [], [], False
        tree = np.zeros(0, np.uint64)

        def close_homes():
            nonlocal tree, closed
            tree, closed = np.concatenate(homes) if homes else np.zeros(0, np.uint64), True
            return edges(spanning_links(tree, radius))

        def look_up():
            guests = np.concatenate(coming)
            coming.clear()
            return edges(guest_links(tree, guests, radius))

        for batch in batches:
            shard, guest, words = (batch.column(i).to_numpy() for i in range(3))
            words = words.view(np.uint64)
            cut = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (guest[1:] != guest[:-1])]) if len(shard) else np.zeros(0, int)
            for i, j in zip(cut, np.r_[cut[1:], len(shard)]):
                if shard[i] != now:
                    if now is not None and not closed:
                        yield close_homes()
                    if coming:
                        yield look_up()
                    now, closed = shard[i], False
                    homes.clear()
                if not guest[i]:
                    homes.append(words[i:j])
                    continue
                if not closed:
                    yield close_homes()
                for k in range(i, j, GUESTS):
                    coming.append(words[k : min(k + GUESTS, j)])
                    if sum(map(len, coming)) >= GUESTS:
                        yield look_up()
        if now is not None and not closed:
            yield close_homes()
        if coming:
            yield look_up()

    return run


def router(words: DataFrame, n: int, shard_words: int = SHARD_WORDS, radius: int = RADIUS) -> Router:
    """The routing tree for n distinct words(fp), from a hash-chosen sample of SAMPLE_WORDS or a quarter of them."""
    depth = max(0, -(-n // shard_words) - 1).bit_length()
    if not depth:
        return Router(np.zeros(0, np.uint64), 0, radius)
    dice = F.pmod(F.xxhash64("fp", F.lit("vantage")), F.lit(1 << 30))
    chosen = words.where(dice < int(min(0.25, SAMPLE_WORDS / n) * (1 << 30))).select("fp").collect()  # SAMPLE_WORDS in expectation
    return Router(np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64)), depth, radius)


def shards(words: DataFrame, tree: Router) -> DataFrame:
    """(shard, guest, fp): every pair of words within the radius meets in a shard where one of them is at home."""
    shared = words.sparkSession.sparkContext.broadcast(tree)  # two nodes for each LEAST words of the sample at most
    return words.select("fp").mapInArrow(_route_batches(shared), "shard int, guest tinyint, fp bigint")


def links(words: DataFrame, shard_words: int = SHARD_WORDS, radius: int = RADIUS) -> DataFrame:
    """(a, b) over distinct fingerprints: a spanning set of the links."""
    dealt = shards(words, router(words, words.count(), shard_words, radius)).repartition("shard").sortWithinPartitions("shard", "guest")
    return dealt.mapInArrow(_shard_links(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): hook each node to its least neighbour, jump, contract, repeat."""
    edges = stage(edges, "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        for k in range(2):
            nearer = stage(up, f"hook{k}")
            up = nearer.join(nearer.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", F.col("top").alias("up"))
        up = stage(up, "up")
        root_of = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        if roots is None:
            roots = root_of
        else:
            roots = stage(roots.join(root_of.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        left = up.select("a", F.col("up").alias("ua"))
        right = up.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        edges = stage(edges.join(left, "a").join(right, "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = stage(fingerprints(docs), "fingerprints")
    words = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "words")
    tops = components(links(words.select("fp"), shard_words))
    linked = tops.join(words.withColumnRenamed("fp", "node"), "node")
    firsts = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = tops.join(firsts, "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that the last join stands alone and the rows of a fingerprint with many copies can be split
    final = stage(words.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")), "components")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: it has its own rule, see near_copies."""
    from quire.llm import near_copies

    return near_copies.keep_first(docs)
