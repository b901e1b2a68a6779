"""The operators against brute force, round trips and held-out accuracy, and on odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import langid, licenses, media, near_copies, packing, pieces, quality, sharding, simhash, site_quality, toxicity
from quire.llm.common import table

DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "   \n\t ", "en", "s", 0), (4, "a", "en", "s", 0), (5, "Permission is hereby granted, free of charge. MIT License", "en", "s", 0),
    (5, "Permission is hereby granted, free of charge. MIT License", "en", "s", 0), (None, "the cat sat on the mat " * 30, "en", "s", 0), (7, "the cat sat on the mat " * 3000, "en", "s", 0), (8, "é€😀 ▁x", "fr", "s", 0),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, kept int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeats and a column whose name clashes with results."""
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, DIR, "labels")


def brute_fingerprint(t: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(words: list[int]) -> list[int]:
    a = np.array(words, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash_matches_brute_force(spark, docs):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    groups = brute_components(prints)
    first = {}
    for r, g in zip(rows, groups):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{p:016x}", first[g]) for r, p, g in zip(rows, prints, groups)}
    for shard_words in (simhash.SHARD_WORDS, 20):  # one shard, and many that a routing tree deals
        got = simhash.near_duplicates(docs, shard_words).collect()
        assert {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in got} == want
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, docs).collect()} == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(0, 2**32))
def test_vantage_tree_links_what_brute_force_links(seeds, salt):
    rng = np.random.default_rng(salt)
    near = [s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(12)]
    words = np.unique(np.array(near, np.uint64))
    a, b = simhash.spanning_links(words)
    place = {int(w): i for i, w in enumerate(words)}
    union = simhash._Union(len(words))
    for x, y in zip(a, b):
        union.unite(place[int(x)], place[int(y)])
    got = [union.find(i) for i in range(len(words))]
    want = brute_components([int(w) for w in words])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def united(words: list[int], edges) -> list[int]:
    union, place = simhash._Union(len(words)), {w: i for i, w in enumerate(words)}
    for e in edges:
        union.unite(place[e[0] % (1 << 64)], place[e[1] % (1 << 64)])
    return [union.find(i) for i in range(len(words))]


def crowd(rng, n: int, spread: int) -> list[int]:
    """Words in a narrow ball and words anywhere, some of them near each other."""
    ball = [0x1234 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread), replace=False)) for _ in range(n)]
    far = [int(w) for w in rng.integers(0, 2**64, n // 2, dtype=np.uint64)]
    return sorted({*ball, *far, *(w ^ 5 for w in far[::3]), *(w ^ (1 << 63) for w in far[::7])})


@pytest.mark.parametrize("spread", [2, 9, 30])
def test_many_shards_lose_no_link(spark, spread):
    words = crowd(np.random.default_rng(3), 500, spread)
    df = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "fp long").repartition(3)
    tree = simhash.router(df, len(words), shard_words=24)
    dealt = simhash.shards(df, tree).collect()
    assert len(tree.nodes) > 0 and tree.shards > 1 and any(r.guest for r in dealt)
    assert sorted(r.fp for r in dealt if not r.guest) == sorted(r.fp for r in df.collect())
    got, want = united(words, simhash.links(df, shard_words=24).collect()), brute_components(words)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_guests_come_in_blocks(monkeypatch):
    """Shards that arrive in several batches, and more guests than are looked up at a time."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "GUESTS", 50)
    words = np.array(crowd(np.random.default_rng(4), 600, 8), np.uint64)
    tree = simhash.Router(words[::3], 3)
    rows = sorted((int(k), int(g), int(w)) for k, guest, own in tree.route(words) for g, w in zip(guest, own))
    kinds = (np.int32, np.int8, np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, t).view(np.int64) if t is np.uint64 else np.array(c, t)) for c, t in zip(zip(*rows[i : i + 37]), kinds)], names=["shard", "guest", "fp"]) for i in range(0, len(rows), 37)]
    edges = [e for out in simhash._shard_links(3)(batches) for e in zip(*(c.to_pylist() for c in out.columns))]
    got, want = united(words.tolist(), edges), brute_components(words.tolist())
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) and len(edges) < len(rows)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def brute_base(t: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    starts, found = [], []
    for label, phrase in licenses.BASE.items():
        p = phrase.split()
        own = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        starts, found = starts + own, found + [label] * bool(own)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def test_licenses_match_brute_force(spark, docs):
    for d in (docs, spark.createDataFrame(ODD, ODD_SCHEMA)):
        want = sorted((str(r.doc_id), brute_base(r.text)) for r in d.collect())
        got = sorted((str(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.query(spark, d).collect())
        assert [w[0] for w in want] == [g[0] for g in got] and [w[1] for w in want] == [g[1] for g in got]


def brute_labels(texts: list[str], templates) -> list[tuple[str, float]]:
    """Labels and scores from every alignment of every template, without an index."""
    docs = [licenses.split(t or "") for t in texts]
    df = {w: sum(w in set(d) for d in docs) for _, key, text in templates for w in (*licenses.split(text), *licenses.split(key))}
    index = licenses.postings(templates, len(docs), df)
    out = []
    for words in docs:
        base, score = set(brute_base(" ".join(words))[4].split(",")) - {""}, 0.0
        labels = set(base)
        for k, (label, key, _) in enumerate(templates):
            own = [(w, at, idf) for w, t, at, idf, _ in index if t == k]
            phrase, distinct = licenses.split(key), {w for w, *_ in own}
            anchor = next(w for w, t, _, _, a in index if t == k and a)
            stands = any(words[i : i + len(phrase)] == phrase for i in range(len(words)))
            starts = {i - at for i, word in enumerate(words) for w, at, _ in own if w == word}
            agree = [{w: idf for w, at, idf in own if 0 <= s + at < len(words) and words[s + at] == w} for s in starts]
            seen = sum({w: idf for w, _, idf in own if w in words}.values())
            best = max(((sum(x.values()), len(x)) for x in agree), default=(0, 0))
            if stands and anchor in distinct and best[1] >= min(licenses.LEAST, len(distinct)) and best[0] / seen >= licenses.AGREED - 1e-12:
                labels.add(label)
                score = max(score, min(1.0, best[0] / seen))
        out.append((",".join(sorted(labels)), 1.0 if base else score))
    return out


def test_licence_labels_match_brute_force(spark, docs):
    by = {label: text for label, _, text in licenses.TEMPLATES}
    texts = [r.text for r in docs.limit(60).collect()] + [r[1] for r in ODD]
    texts += [f"preface words {t} and an end" for t in by.values()] + [" ".join(t.split()[::-1]) for t in by.values()] + [" ".join(t.split()[: len(t.split()) // 3]) for t in by.values()]
    texts += [by["bsd"] + " " + by["isc"], by["mit"].replace("obtaining", "who is getting"), "redistribution binary forms without modification permitted", "under the GNU Lesser General Public License"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.query(spark, rows).collect()}
    for i, (labels, score) in enumerate(brute_labels(texts, licenses.TEMPLATES)):
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, (i, texts[i][:80], got[i], labels, score)
    whole = {i: set(labels.split(",")) for i, (labels, _) in got.items()}
    first = 60 + len(ODD) if len(texts) > 100 else None
    assert first and all(label in whole[first + i] for i, label in enumerate(by))


def special(spark):
    """Texts with the tokenizer's own token in them, blank ones and a null, which counts as empty."""
    return spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["<|endoftext|>", "a <|endoftext|> b <s>", "x" * 40 + "<|endoftext|>" * 3000, "", " "])], "doc_id long, text string")


def test_packing_matches_the_tokenizer_and_fills_sequences(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*docs.collect(), *[r for r in special(spark).collect()]]
    docs = docs.select("doc_id", "text").unionByName(special(spark))
    ids = {r.doc_id: np.array(e.ids + [0], "<u4") for r, e in zip(rows, tok.encode_batch([r.text for r in rows], add_special_tokens=False))}
    got = packing.query(spark, docs).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and sum(r.length for r in own) == len(ids[doc])
        assert all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and sum(r.length for r in own) <= 2048
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 2048) + 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t  ab'sé1.!😀\x1c\x85", max_size=40))
def test_encoder_cuts_only_at_token_bounds(t):
    enc = packing.encoder(*packing.vocabulary())
    assert enc.encode(t) == np.array(enc._encode(t), "<u4").tobytes()


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", " x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "two  <|endoftext|>  more"])
def test_added_tokens_are_the_tokenizers_own(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(*packing.vocabulary()).encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_places_each_item_once(counts):
    fill, seen = {}, {}
    for length, rank, n, first, per, at in packing.plan(counts, 64):
        for j in range(n):
            seen.setdefault(length, []).append(rank + j)
            fill.setdefault(first + j // per, []).append((at + j % per * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in fill.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 64


def fewest(sizes: tuple[int, ...], most: int) -> int:
    """The least number of bins, by trying all."""
    best = [len(sizes)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= most and bins[i] not in bins[:i]:
                put(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        put(rest[1:], [*bins, rest[0]])

    put(tuple(sorted(sizes, reverse=True)), [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=9))
def test_plan_is_within_one_sequence_of_the_fewest(sizes):
    counts = {n: sizes.count(n) for n in sizes}
    used = {first + j // per for _, _, n, first, per, _ in packing.plan(counts, 16) for j in range(n)}
    assert fewest(tuple(sizes), 16) <= len(used) <= fewest(tuple(sizes), 16) + 1


def test_sharding_keeps_groups_and_levels_bytes(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.query(spark, docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    where, slots, sizes = {}, {}, {}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        where.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))
    groups = {}
    for r in got:
        groups[text[r.doc_id]] = groups.get(text[r.doc_id], 0) + r.size
    alone = {r.shard for r in got if groups[text[r.doc_id]] == sizes[r.shard]}
    rest = [n for s, n in sizes.items() if s not in alone]
    # shards of several groups differ by no more than their largest group
    assert not rest or max(rest) - min(rest) <= max(n for t, n in groups.items() if not where[t] <= alone)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=200))
def test_best_fit_fits(sizes):
    placed = sharding.assign(list(zip(sizes, range(len(sizes)))), 7)
    loads = [sum(sizes[k] for k, s in placed.items() if s == j) for j in range(7)]
    assert set(placed) == set(range(len(sizes))) and max(loads) <= sum(sizes) / 7 + max(sizes)


@pytest.mark.parametrize("hot", [[0.03], [0.1], [1 / 3], [0.3, 0.2, 0.04]])
def test_a_hot_group_leaves_the_other_shards_level(hot):
    small = [int(n) for n in np.random.default_rng(5).integers(500, 1500, 20_000)]
    sizes = small + [int(h * sum(small) / (1 - sum(hot))) for h in hot]
    placed = sharding.assign(list(zip(sizes, range(len(sizes)))), 40)
    loads = np.bincount([placed[k] for k in range(len(sizes))], weights=sizes, minlength=40)
    own = {placed[k] for k in range(len(small), len(sizes))}
    assert len(own) == len(hot) and all(loads[placed[k]] == sizes[k] for k in range(len(small), len(sizes)))
    rest = [n for j, n in enumerate(loads) if j not in own]
    assert min(rest) > 0.97 * max(rest)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
def test_media_round_trip(texts):
    files = media.encode_documents(texts)
    assert [f.tobytes() for f in media.decode_documents(files)] == [media.pad(t) for t in texts]


def lossless(frame: np.ndarray, counts: tuple, symbols: tuple, extra: bytes = b"") -> bytes:
    """A lossless JPEG by the standard's rules, bit by bit, with a table and headers of its own."""
    codes, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s] = f"{code:0{bits}b}"
            code += 1
        at, code = at + n, code << 1
    h, w = frame.shape
    word = ""
    for y, x in itertools.product(range(h), range(w)):
        left = int(frame[y, x - 1]) if x else int(frame[y - 1, 0]) if y else 128
        d = int(frame[y, x]) - left
        size = abs(d).bit_length()
        word += codes[size] + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
    word += "1" * (-len(word) % 8)
    data = bytes(int(word[i : i + 8], 2) for i in range(0, len(word), 8)).replace(b"\xff", b"\xff\0")
    table = b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([1, *counts, *symbols])
    size = b"\xff\xc3\0\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\1\1\x11\0"
    return b"\xff\xd8" + extra + size + table + b"\xff\xda\0\x08\1\1\x10\1\0\0" + data + b"\xff\xd9"


def test_other_writers_files_are_read():
    """Frames of another size, table and header order; an index by absolute places, or none and rec lists; sound between the frames."""
    rng = np.random.default_rng(9)
    counts, symbols = (0, 2, 2, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (3, 2, 4, 1, 0, 5, 6, 7, 8)
    frames = [rng.integers(0, 256, (5, 7), dtype=np.uint8), np.zeros((5, 7), np.uint8), np.full((5, 7), 255, np.uint8)]
    jpegs = [lossless(f, counts, symbols, b"\xff\xfe\0\x06note") for f in frames]
    own = media._chunk
    walked = own(b"LIST", b"movi" + own(b"01wb", b"sound") + own(b"LIST", b"rec " + own(b"00dc", jpegs[0]) + own(b"01wb", b"x")) + own(b"00dc", jpegs[1]) + own(b"00db", jpegs[2]))
    head = b"RIFF" + bytes(4) + b"AVI " + own(b"JUNK", b"odd")
    places = [(head + walked).find(j) - 8 for j in jpegs]
    index = own(b"idx1", b"".join(n + (16).to_bytes(4, "little") + a.to_bytes(4, "little") + len(j).to_bytes(4, "little") for n, a, j in zip((b"00dc", b"00dc", b"00db"), places, jpegs)))
    for file in (head + walked, head + walked + index):
        assert media.read_avi(file) == jpegs
        assert np.array_equal(media.decode_documents([file])[0], np.stack([f.ravel() for f in frames]))
    both = media.decode_documents([head + walked, media.encode_documents([b"abc"])[0]])
    assert both[1].tobytes() == media.pad(b"abc") and both[0].shape == (3, 35)
    for broken in (b"RIFF", head, head + walked.replace(b"\xff\xc3", b"\xff\xc0"), head + own(b"LIST", b"movi" + own(b"00dc", jpegs[0][:-9] + jpegs[0][-2:]))):
        with pytest.raises(ValueError):
            media.decode_documents([broken])


def brute_cuts(frames: np.ndarray) -> list[int]:
    bars = [np.histogram(f, bins=16, range=(0, 256))[0] for f in frames]
    jump = [float(abs(a - b).sum()) for a, b in zip(bars[1:], bars)]
    out = [0]
    for i, j in enumerate(jump):
        near = jump[max(0, i - media.WINDOW) : i + media.WINDOW + 1]
        out += [i + 1] if j > np.mean(near) + media.CUT_SIGMAS * np.std(near) + 1e-9 else []
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 20)), min_size=1, max_size=6), st.integers(0, 2**32))
def test_cuts_match_brute_force(shots, seed):
    rng = np.random.default_rng(seed)
    frames = np.concatenate([np.clip(rng.integers(-3, 4, (n, media.FRAME)) + level, 0, 255).astype(np.uint8) for level, n in shots])
    got, want = media.cuts(frames).tolist(), brute_cuts(frames) if len(frames) > 2 else [0]
    assert got == want
    assert [c[1:3] for c in media.clips_of(frames)] == list(zip(got, [*got[1:], len(frames)]))


def test_media_query_and_clips(spark, odd):
    rows = media.query(spark, odd).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        data = media.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        frames = np.frombuffer(data, np.uint8).reshape(-1, media.FRAME)
        assert [tuple(c) for c in r.clips] == media.clips_of(frames) and f"clips={len(r.clips)};" in r.feature
    clips = media.clips(media.encode_media(odd)).collect()
    assert len({r.doc_id for r in clips}) == len(texts) and all(r.end_frame > r.first_frame for r in clips)
    frames = np.concatenate([np.full((20, media.FRAME), 10, np.uint8), np.full((20, media.FRAME), 200, np.uint8)])
    assert media.cuts(frames).tolist() == [0, 20]


def test_quality_matches_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({quality.ORACLE_SQL}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r) for r in quality.query(spark, docs).select(*names).collect()) == [tuple(r) for r in want]


def test_language_held_out(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.query(spark, docs).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def brute_shares(filters, text: bytes) -> list[float]:
    folded = b" " + bytes(c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in text) + b"  "
    grams = [folded[i : i + 4] for i in range(len(folded) - 3)]
    out = []
    for i, rate in enumerate(filters.false_rate):
        place = lambda g: [int(p[0]) for p in langid._places(np.array([int.from_bytes(g, "little")], np.uint32))]
        holds = sum(all(int(filters.planes[i // 64][p]) >> (i % 64) & 1 for p in place(g)) for g in grams)
        out.append(min(1.0, max(0.0, (holds / max(1, len(grams)) - rate) / (1 - rate))))
    return out


def test_language_shares_match_brute_force_wherever_a_text_stands(monkeypatch):
    texts = [b"", b"", b"a", b"the cat", "é€😀 ▁x".encode(), b"", b"le chat est la", b"   ", b"the cat " * 50, b"x"]
    grams = {x: np.unique(langid._grams([b" " + t.translate(langid._FOLD) + b"  "])[0]) for x, t in (("en", b"the cat sat"), ("fr", "le chat est là".encode()))}
    filters = langid.Filters(grams)
    want = np.array([brute_shares(filters, t) for t in texts])
    for block in (1, 20, 500_000):
        monkeypatch.setattr(langid, "BLOCK_BYTES", block)
        assert np.array_equal(filters.shares(texts), want)
        assert np.array_equal(filters.shares(texts[::-1]), want[::-1])
        for i, t in enumerate(texts):
            assert np.array_equal(filters.shares([t]), want[i : i + 1])


@pytest.mark.parametrize("texts", [[None], [""], [None, "", None], ["the cat sat on the mat"], ["12 !"]])
def test_language_of_few_and_blank_texts(spark, docs, texts):
    filters = langid.fit(langid.learnable(docs))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(len(texts))
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, filters, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == "en" if any(map(str.isalpha, t or "")) else got[i] == ("und", 0.0)


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.query_labels(spark, docs, labels).collect() if r.held_out and r.doc_id in toxic]
    clean = [r.score for r in rows if not toxic[r.doc_id]]
    bad = [r.score for r in rows if toxic[r.doc_id]]
    assert np.mean([a > b for a in bad for b in clean]) > 0.9


def brute_kernel(a: bytes, b: bytes) -> float:
    """The kernel from its definition: all letter triples at steps of 1 to 3, within SPAN characters."""
    def weights(t):
        code, out = [toxicity._symbol(c) for c in t], {}
        for i, j in itertools.product(range(len(code)), (1, 2, 3)):
            for k in (1, 2, 3):
                if j + k <= toxicity.SPAN - 1 and i + j + k < len(code) and all(code[x] for x in (i, i + j, i + j + k)):
                    triple = code[i], code[i + j], code[i + j + k]
                    out[triple] = out.get(triple, 0) + toxicity.DECAY ** (j + k + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(w * y.get(t, 0) for t, w in x.items())


@settings(max_examples=60, deadline=None)
@given(st.text("abc .é", max_size=14), st.text("abc .é", max_size=14))
def test_kernel_is_its_definition(a, b):
    assert abs(toxicity.kernel(a.encode(), b.encode()) - brute_kernel(a.encode(), b.encode())) < 1e-9


def test_folded_weights_are_the_kernel():
    a, b = b" idiot ", b"an i.d.i.o.t here"
    index, weight = toxicity.profile(a)
    weights = np.zeros(toxicity._SIZE)
    weights[index] = weight
    other, amount = toxicity.profile(b)
    assert abs(toxicity.kernel(a, b) - weights[other] @ amount) < 1e-9 and toxicity.kernel(a, b) > 0


def test_site_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    rows = [r for r in site_quality.query_labels(spark, docs, labels).collect() if r.doc_id in good]
    assert len(rows) > 50 and np.mean([r.kept == bool(good[r.doc_id]) for r in rows]) > 0.9


def test_site_posteriors_match_brute_force(spark, docs, labels):
    """Shrinkage by the method of moments, from the document probabilities alone; a null lang is no empty one."""
    extra = spark.createDataFrame([(9000 + i, f"word {i} of it. " * 40, lang, src) for i, (lang, src) in enumerate([(None, "s"), ("", "s"), (None, None), ("", "s"), ("en", "")])], "doc_id long, text string, lang string, source string")
    every = docs.select("doc_id", "text", "lang", "source").unionByName(extra)
    got = site_quality.query_labels(spark, every, labels).collect()
    where = {r.doc_id: (r.source, r.lang) for r in every.collect()}

    def shrink(key, above):
        sums = {}
        for r in got:
            n, t, q = sums.get(key(r), (0, 0.0, 0.0))
            sums[key(r)] = n + 1, t + r.document_p, q + r.document_p**2
        n, t, q = (sum(x[i] for x in sums.values()) for i in range(3))
        between = sum(x[1] ** 2 / x[0] for x in sums.values())
        within = max((q - between) / max(n - len(sums), 1), 1e-9)
        spread = max((between - n * (t / n) ** 2 - (len(sums) - 1) * within) / max(n, 1), 1e-9)
        prior = min(max(within / spread, site_quality.PRIOR_LIMITS[0]), site_quality.PRIOR_LIMITS[1])
        return {k: (x[1] + prior * (above(k) if above else t / n)) / (x[0] + prior) for k, x in sums.items()}, t / n

    hosts, mean = shrink(lambda r: where[r.doc_id][0], None)
    paths, _ = shrink(lambda r: where[r.doc_id], lambda k: hosts[k[0]])
    logit = lambda p: np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for r in got:
        odds = logit(r.document_p) + logit(paths[where[r.doc_id]]) - logit(mean)
        assert abs(r.host_p - hosts[where[r.doc_id][0]]) < 1e-6 and abs(r.path_p - paths[where[r.doc_id]]) < 1e-6
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-6 and r.kept == (r.score >= site_quality.KEEP)
    assert len({r.path_p for r in got if where[r.doc_id] in ((None, "s"), ("", "s"), (None, None))} | {0}) >= 2 and paths[(None, None)] != paths[("s", None)]


def test_pages_have_hosts_and_paths(spark, labels, docs):
    pages = spark.createDataFrame([(1, "https://www.Blog.example.org/en/12?x=1", "<p>Text <b>here</b></p><script>no()</script>"), (2, "not a url", None), (3, None, "x"), (4, "http://a.b/", "")], "page_id long, url string, html string")
    got = {r.doc_id: (r.source, r.lang, r.text and r.text.split()) for r in site_quality.of_pages(pages).collect()}
    assert got == {1: ("blog.example.org", "en", ["Text", "here"]), 2: ("", None, None), 3: ("", None, ["x"]), 4: ("a.b", None, "")}
    assert site_quality.score(site_quality.of_pages(table(spark, DIR, "pages")), site_quality.fit(docs, labels)).where("path_p is null").count() == 0


def test_pieces_are_optimal_and_come_back(spark, docs):
    t = pieces.pieces_of(pieces.default_model())

    def best(w):
        top = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            top[e] = top[e - 1] + (t.score[w[e - 1]][0] if w[e - 1] in t.score else t.low)
            for s in range(max(0, e - t.longest), e - 1):
                if w[s:e] in t.score:
                    top[e] = max(top[e], top[s] + t.score[w[s:e]][0])
        return top[-1]

    words = sorted({w for r in docs.limit(20).collect() for w in pieces.split(r.text)})[:300]
    for w, ids in zip(words, t.encode_words(words)):
        got = [t.text[i] for i in np.frombuffer(ids, "<u4")]
        if all(p in t.score for p in got):
            assert abs(sum(t.score[p][0] for p in got) - best(w)) < 1e-6
    assert all(r.round_trip for r in pieces.query(spark, docs).collect())


def test_long_words_are_encoded_like_short_ones(monkeypatch):
    import time

    p = pieces.pieces_of(pieces.default_model())
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("theandofing é€x"), n)).replace(" ", "_") for n in (1, 2, 17, 60, 64, 200)] + ["a" * 50, "😀" * 9, "▁the"]
    want = p.encode_words(words)
    monkeypatch.setattr(pieces, "LONG", 0)
    for stretch in (1, 7, 65_536):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        assert p.encode_words(words) == want
    began = time.time()
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 200_000))
    assert p.decode(p.encode([text])[0]) == text and time.time() - began < 20


def test_pieces_against_the_library(spark, docs):
    """Best paths of a merge-ordered table are not its own library's pieces; the share of equal words is what the README says."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.pieces_of(pieces.default_model())
    words = sorted({w for r in docs.collect() for w in pieces.split(r.text)})[:5000]
    same = np.mean([np.frombuffer(ids, "<u4").tolist() == sp.encode(w[1:]) for w, ids in zip(words, p.encode_words(words))])
    assert 0.2 < same < 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_pieces_round_trip(t):
    if any(0xD800 <= ord(c) < 0xE000 for c in t):
        return
    p = pieces.pieces_of(pieces.default_model())
    assert p.decode(p.encode([t])[0]) == t


def test_relational_lattice(spark):
    table_ = spark.createDataFrame([("▁", -5.0), ("▁h", -2.0), ("el", -1.5), ("lo", -1.0), ("h", -3.0), ("e", -3.0), ("l", -3.0), ("o", -3.0), ("hello", -20.0)], "piece string, score double")
    got = pieces.lattice(spark.createDataFrame([("▁hello",)], "word string"), table_, 6, -50.0).collect()
    assert [list(r.pieces) for r in got] == [["▁h", "el", "lo"]]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, odd, labels, empty):
    d = odd.limit(0) if empty else odd
    n = 0 if empty else len(ODD)
    for f in (simhash.query, licenses.query, quality.query, media.query, sharding.query, langid.query, pieces.query):
        assert f(spark, d).count() == n, f
    assert toxicity.query_labels(spark, d, labels).count() == n
    assert site_quality.query_labels(spark, d, labels).count() == n
    assert packing.query(spark, d).where("piece = 0").count() == n
    for f in (quality.keep_good, langid.keep_known, simhash.keep_first):
        assert f(d).columns == d.columns


def test_keep_first_keeps_one_row_a_group(spark):
    """Also where doc_ids repeat or are missing, and with columns named like the stage's own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a, 1, 1), (2, a, 1, 2), (2, a, 1, 2), (2, b, 2, 3), (None, b, 2, 4), (None, c, 3, 5), (None, c, 3, 5), (9, None, 4, 6), (8, "", 4, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp int, number int")
    got = sorted(r.number for r in simhash.keep_first(d).collect())
    assert got == [2, 3, 5, 7]
    assert simhash.keep_first(d.limit(0)).collect() == []


def brute_groups(texts: list[str]) -> list[int]:
    """Components of five-word Jaccard 0.8 or more over all pairs; empty sets are equal."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("hot", [True, False])
def test_near_copies_match_brute_force(spark, docs, monkeypatch, hot):
    """Also with shared lines in every text, near copies on both sides of 0.8 and shingles that go last."""
    if hot:
        monkeypatch.setattr(near_copies, "OFTEN", 2)
    rng = np.random.default_rng(8)
    texts = [r.text for r in docs.collect()]
    for n in (60, 200, 800):
        for base in range(6):
            words = ["all rights reserved by the same long line"] * (n // 40) + [f"{base}x{k}" for k in rng.integers(0, 5000, n)]
            for edits in (0, 1, 2, 3, n // 60, n // 50, n // 45, n // 40, n // 20):
                copy = list(words)
                for at in rng.choice(len(copy), edits, replace=False):
                    copy[at] = f"e{rng.integers(10**9)}"
                texts.append(" ".join(copy))
    groups = brute_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_first(rows).collect()) == sorted(set(groups))


@pytest.mark.parametrize("short", [2, 4, 32])
def test_lists_lose_no_pair(monkeypatch, short):
    """Short lists whole, and of long ones all pairs of different roots, in batches that cut lists."""
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "SHORT", short)
    monkeypatch.setattr(near_copies, "PAIRS", 40)
    rng = np.random.default_rng(6)
    core = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = [(int(s), int(size), int(w), int(place)) for w, (s, size, place) in enumerate(zip(rng.integers(0, 9, 150), rng.integers(40, 60, 150), rng.integers(0, 12, 150)))]
    sets = {w: np.unique(np.r_[core[: size - int(k)], rng.integers(0, 2**63, int(k), dtype=np.uint64)]) for (_, size, w, _), k in zip(rows, rng.integers(0, 30, 150))}
    sigs = {w: near_copies.bitmap(s, 64 * near_copies.PARTS) for w, s in sets.items()}
    root = {w: int(rng.choice([0, 0, 0, 0, 1, w])) for *_, w, _ in rows}

    def run(f, key, rooted):
        own = sorted(rows, key=key)
        columns = [pa.array([r[i] for r in own]) for i in (0, 2, 1, 3)] + [pa.array([sigs[r[2]] for r in own], pa.binary())] + ([pa.array([rooted[r[2]] for r in own])] if rooted else [])
        batches = [pa.RecordBatch.from_arrays([c[i : i + 23] for c in columns], names=list("abcdef")[: len(columns)]) for i in range(0, 150, 23)]
        return {p for out in f(batches) for p in zip(*(c.to_pylist() for c in out.columns))}

    def fits(x, y):
        a, b = (np.frombuffer(sigs[r[2]], np.uint64) for r in (x, y))
        sized = 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1]) and 9 * min(x[1] - x[3], y[1] - y[3]) >= 4 * (x[1] + y[1])
        return sized and 9 * int(np.bitwise_count(a ^ b).sum()) <= x[1] + y[1]

    size = {s: sum(r[0] == s for r in rows) for s in range(9)}
    every = {(min(x[2], y[2]), max(x[2], y[2])): (x[0], root[x[2]] != root[y[2]]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and fits(x, y)}
    first, rest = run(near_copies._first_batches, lambda r: (r[0], r[2]), None), run(near_copies._rest_batches, lambda r: r[:2], root)
    assert {p for p, (s, _) in every.items() if size[s] <= short} <= first and rest == {p for p, (_, apart) in every.items() if apart} and rest
    assert not run(near_copies._rest_batches, lambda r: r[:2], dict.fromkeys(root, 0))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.floats(0, 1))
def test_bitmaps_never_differ_more_than_sets(a, extra, share):
    b = set(sorted(a)[: int(share * len(a))]) | extra
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    p, q = near_copies.bitmap(x), near_copies.bitmap(y)
    assert near_copies.differ(p, q) <= len(a ^ b)
    assert near_copies.differ(near_copies.bitmap(x, 256), near_copies.bitmap(y, 256)) <= len(a ^ b)
