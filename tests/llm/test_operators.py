"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from quarrylog.llm import decontaminate, extract, hashing, imatch, lines, packing, pii, quality, simhash, substrings, warc
from quarrylog.llm.common import Scratch, connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeéß", k=draw.randint(1, 6))) for _ in range(60)]
    some = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", ",", ".", "\n"]) for _ in range(n))
    shared = [some(30) for _ in range(3)]
    out = [None, "", " \n\t", "One", "one", "x" * 300, some(4000)]
    out += [some(draw.randint(1, 60)) + (" " + draw.choice(shared) if draw.random() < 0.5 else "") + "\n" + some(5) for _ in range(40)]
    return out + out[10:14] + [t + " end" for t in out[14:18]] + ["Same line\n" + str(k) for k in range(12)]


def test_decontamination(spark, texts):
    items = [(0, texts[20]), (1, "tiny item"), (2, ""), (3, None), (4, texts[21][:40]), (None, "lost words"), (1, "Tiny, ITEM!")]
    docs = [*texts, "a tiny ITEM here", "lost words", texts[20].upper(), "tiny item tiny item"]
    window = 13

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    expected = set()
    for d, t in enumerate(docs):
        w, hit, ids = words(t), set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    ids |= own
        names = sorted(str(x) for x in ids if x is not None)
        expected.add((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 200):
        got = decontaminate.contamination(documents(spark, docs), bench, block_bytes=block).drop("spans").collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(docs)
    cleaned = {r.doc_id: r.text for r in decontaminate.decontaminate(documents(spark, docs), bench).collect()}
    assert not any(bad for d, *_, bad in expected if d in cleaned)
    assert all(cleaned[d] == docs[d] for d, _, hits, *_ in expected if not hits)
    assert decontaminate.contamination(documents(spark, docs), bench.limit(0)).where("n_hit > 0").isEmpty()
    long = documents(spark, ["Some " * 400 + texts[20] + " More" * 400])
    (row,) = decontaminate.decontaminate(long, bench).collect()
    assert row.n_chars == len(row.text) and texts[20] not in row.text and row.text.startswith("Some Some") and row.text.endswith("More More")


def hamming_components(fps, radius):
    ids, parent = sorted(fps), {d: d for d in fps}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {d: find(d) for d in ids}


def plain_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return builtins_sum(1 << b for b in range(64) if 2 * builtins_sum(v >> b & 1 for v in h) > len(h)) if h else 0


builtins_sum = sum


def test_simhash(spark, texts):
    fps = {d: plain_simhash(t) for d, t in enumerate(texts)}
    expected = {(d, f"{fps[d]:016x}", c) for d, c in hamming_components(fps, 3).items()}
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(texts)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert not list(simhash.near_pairs(np.zeros((0, 4), np.uint64), np.zeros(0, int), 3, np.zeros(0, int)))
    assert simhash.near_duplicates(documents(spark, ["a b", "a b", None], [5, 5, None])).count() == 3


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_links_in_hot_buckets(spark, tile):
    draw = random.Random(1)
    base = draw.getrandbits(64)
    fps = {}
    for d in range(120):
        v = base
        for b in draw.sample(range(64), draw.randint(0, 5)):
            v ^= 1 << b
        fps[d] = v if d % 3 else draw.getrandbits(64)
    df = spark.createDataFrame([(d, v - (1 << 64) if v >> 63 else v) for d, v in fps.items()], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.components(df, Scratch(spark), 3, tile).collect()}
    assert got == hamming_components(fps, 3)


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_bit_planes(radius):
    draw = np.random.default_rng(radius)
    fps = draw.integers(0, 1 << 63, 90, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << draw.integers(0, 60, 45).astype(np.uint64)) ^ np.uint64((1 << draw.integers(0, radius + 2)) - 1)
    bucket = draw.integers(0, 4, 90)
    root = simhash.linked(fps.reshape(-1, 1), bucket, radius)
    for b in range(4):
        mine = np.nonzero(bucket == b)[0].tolist()
        assert {frozenset(x for x in mine if root[x] == r) for r in {root[x] for x in mine}} == {frozenset(v for v in mine if c[v] == k) for c in [hamming_components({x: int(fps[x]) for x in mine}, radius)] for k in set(c.values())}


def test_blocks_of_lanes_are_abandoned_one_by_one():
    """One near pair keeps its own block of lanes going, and no other."""
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    planes, asked = simhash.Planes(fps), np.ones(19_990, bool)
    assert not len(planes.near(10, asked, 3))
    blocks, looked = 5, planes.looked
    assert looked <= blocks * 64
    fps[9_010] = fps[9_000]
    planes = simhash.Planes(fps)
    assert planes.near(10, asked, 3).tolist() == [9_000]
    assert planes.looked <= looked + 256


def test_bucket_masks_share_a_block_at_any_size():
    for n in (10, 10**7, 10**10):
        masks = simhash.bucket_masks(n)
        draw = random.Random(n)
        for _ in range(200):
            v = draw.getrandbits(64)
            u = v
            for b in draw.sample(range(64), 3):
                u ^= 1 << b
            assert any(u & m == v & m for m in masks)


def test_one_near_copy_stays(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(400)]
    originals = [[draw.choice(words) for _ in range(300)] for _ in range(12)]
    made, group = [], []
    for g, w in enumerate(originals):
        made.append(" ".join(w))
        group.append(g)
        for _ in range(3):
            other = list(w)
            for i in draw.sample(range(300), 5):
                other[i] = "new"
            made.append(" ".join(other))
            group.append(g)
    got = [r.doc_id for r in simhash.keep_one(documents(spark, [*made, None, "", made[0]]), 5, 0.8).collect()]
    assert sorted(got) == [k for k in range(len(made)) if k % 4 == 0] + [len(made), len(made) + 1]


def test_wide_fingerprints_find_similar_texts():
    """Measured on pairs of a Jaccard similarity of 0.8 to 0.85: share that is linked directly, and of pairs below 0.5 that is not."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(2000)]
    radius, near, far, total_near, total_far = simhash.wide_radius(0.8, 400, 2), 0, 0, 0, 0
    for _ in range(150):
        w = [draw.choice(words) for _ in range(400)]
        for changes in (8, 40):
            other = list(w)
            for i in draw.sample(range(400), changes):
                other[i] = "new"
            a, b = ({tuple(v[i : i + 5]) for i in range(396)} for v in (w, other))
            like = len(a & b) / len(a | b)
            d = builtins_sum(int(u ^ v).bit_count() for u, v in zip(simhash.wide_fingerprint(" ".join(w).encode()).tolist(), simhash.wide_fingerprint(" ".join(other).encode()).tolist(), strict=True))
            if like >= 0.8:
                total_near, near = total_near + 1, near + (d <= radius)
            elif like < 0.5:
                total_far, far = total_far + 1, far + (d <= radius)
    assert near / total_near > 0.9 and far / total_far < 0.02


def like(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def kept_by_hand(texts, least):
    """The places of the first text of each group that links of `least` or more join."""
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if label[i] != label[j] and like(a, b) >= least:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return [i for i, v in enumerate(label) if i == v]


def test_links_of_sets():
    draw = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(draw.integers(0, 12, draw.integers(1, 12)).astype(np.uint64)) for _ in range(15)]
        a, b = map(np.array, zip(*((i, j) for i in range(15) for j in range(i)), strict=True))
        label, groups = np.arange(15), np.arange(15)
        for i, j in zip(a, b, strict=True):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if 5 * len(x & y) >= 4 * len(x | y):
                groups[groups == max(groups[i], groups[j])] = min(groups[i], groups[j])
        for i, j in simhash.links_of(sets, a, b, np.arange(15), 0.8):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
        assert label.tolist() == groups.tolist()


@pytest.mark.parametrize("size", [9, 24, 300])
@pytest.mark.parametrize("tile", [4096, 8])
def test_near_copies_are_those_at_the_similarity(spark, size, tile):
    """Pairs at the limit and just below, short and long, and chains of them: all of the first are found and none of the second."""
    draw, texts = random.Random(size), []
    for k in range(60):
        w = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        n = size - 4
        cut = -(-4 * n // 5) + 4  # the first words, so that the pair lies at 0.8 or the next place above
        texts += [" ".join(w), " ".join(w[: cut if k % 2 else cut - 1])]
        if k % 3 == 0 and size > 9:
            texts.append(" ".join(w[: cut - 1][: -(-4 * (cut - 5) // 5) + 4]))  # alike to the second only
    expected = kept_by_hand(texts, 0.8)
    assert 60 < len(expected) < len(texts) - 20
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts), 5, 0.8, tile).collect()) == expected


def test_recall_of_candidates_at_the_similarity():
    """Pairs at 0.8 that share a key and lie within the radius, of sets of 4 and 5 to 400 and 500 shingles: all of 1500."""
    draw, found = np.random.default_rng(3), 0
    tables = simhash.tables_for(0.8)
    for k in range(1500):
        n = (5, 50, 500)[k % 3]
        both = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = np.unique(both), np.unique(both[: n * 4 // 5])
        key = (simhash.least_keys(a, tables) == simhash.least_keys(b, tables)).any()
        found += bool(key and builtins_sum(int(x ^ y).bit_count() for x, y in zip(simhash._wide(a).tolist(), simhash._wide(b).tolist(), strict=True)) <= simhash.wide_radius(0.8, len(b)))
    assert found == 1500


def plain_lines(texts, least):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    seen = {}
    for d, t in enumerate(texts):
        for k in {key(v) for v in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(d)
    often = {k for k, v in seen.items() if len(k) >= 1 and len(v) >= least}
    out = set()
    for d, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [v for v in own if key(v) not in often]
        out.add((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast", [1000, 0])
@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, texts, broadcast, least):
    docs = documents(spark, texts)
    index = lines.LineIndex.build(docs, least, broadcast_keys=broadcast, shard_keys=3)
    for inside in (False, True):
        got = index.apply(docs, inside=inside).drop("kept").collect()
        assert {tuple(r) for r in got} == plain_lines(texts, least) and len(got) == len(texts)


def test_lines_after_random_changes(spark):
    """Insertions and deletions move only keys that cross the limit, and filters and answers stay those of an index built anew."""
    draw = random.Random(9)
    batches = [["\n".join(f"line {draw.randrange(40)}" for _ in range(draw.randint(1, 6))) for _ in range(12)] for _ in range(6)]
    frames = [documents(spark, b) for b in batches]
    index, held = lines.LineIndex.build(frames[0], 4, shard_keys=5), [0]
    index.PARTS = 3
    for step in range(7):
        k = draw.randrange(6)
        index = index.delete(frames[k]) if k in held else index.insert(frames[k])
        held = [x for x in held if x != k] if k in held else [*held, k]
        anew = {}
        for t in (t for b in held for t in batches[b]):
            for key in set(t.split("\n")):
                anew[key] = anew.get(key, 0) + 1
        assert sorted(r.n for r in index.counts.collect()) == sorted(anew.values())
        often = {lines.key_hash(x.encode()) for x, n in anew.items() if n >= 4}
        tables = {r.shard: bytes(r.table) for r in index.filters.collect()}
        assert builtins_sum(np.count_nonzero(np.frombuffer(t, np.uint16)) for t in tables.values()) == len(often)
        every = [lines.key_hash(f"line {n}".encode()) for n in range(40)]
        assert often <= lines._Lookup(index.shards, list(tables.items()), b"")(every)
        if step % 3 == 2:
            for frame in frames[:2]:
                for r in index.apply(frame).collect():
                    own = batches[frames.index(frame)][r.doc_id].split("\n")
                    assert r.kept == "\n".join(x for x in own if lines.key_hash(x.encode()) not in often)


def test_full_filters_are_built_anew(spark):
    some = documents(spark, ["a\nb"] * 2)
    many = documents(spark, ["\n".join(f"line {k}" for k in range(500))] * 2)
    index = lines.LineIndex.build(some, 2).insert(many)
    assert builtins_sum(np.count_nonzero(np.frombuffer(bytes(r.table), np.uint16)) for r in index.filters.collect()) == 502
    assert all(r.n_dropped == r.n_lines for r in index.apply(many.union(some)).collect())
    assert index.delete(many).apply(many).agg({"n_dropped": "sum"}).first()[0] == 0


def test_keys_that_a_filter_has_by_mistake_stay(spark):
    """Lines that share the fingerprint and the buckets of a frequent one: the exceptions keep them."""
    index = lines.LineIndex.build(documents(spark, ["often"] * 3), 3)
    texts = [f"line {k}" for k in range(300_000)]
    docs = documents(spark, ["\n".join(texts[k : k + 1000]) for k in range(0, len(texts), 1000)])
    table = [(r.shard, bytes(r.table)) for r in index.filters.collect()]
    assert lines._Lookup(1, table, b"")([lines.key_hash(t.encode()) for t in texts])
    assert index.apply(docs).agg({"n_dropped": "sum"}).first()[0] == 0


def test_lines_are_reversible(spark, texts):
    first, second = documents(spark, texts[:30]), documents(spark, texts[30:])
    rows = lambda i: {tuple(r) for r in i.counts.collect()}
    one = lines.LineIndex.build(first, 2)
    both = one.insert(second)
    assert rows(both) == rows(lines.LineIndex.build(documents(spark, texts), 2)) != rows(one)
    assert rows(both.delete(second)) == rows(one)
    assert both.delete(documents(spark, texts)).counts.isEmpty()
    kept = lines.drop_frequent_lines(documents(spark, texts), 10).collect()
    assert len(kept) == len(texts) and all(r.text is None or r.n_chars == len(r.text) for r in kept)
    assert not any("Same line" in (r.text or "") for r in kept)


def test_cuckoo_filters():
    draw = np.random.default_rng(0)
    k1, k2 = draw.integers(0, 1 << 63, (2, 3000), dtype=np.uint64)
    held = lines.CuckooFilter.of(k1, k2)
    assert held.has(k1, k2).all()
    o1, o2 = draw.integers(0, 1 << 63, (2, 20000), dtype=np.uint64)
    assert held.has(o1, o2).mean() < 0.002
    assert all(held.delete(int(a), int(b)) for a, b in zip(k1[:1500], k2[:1500], strict=True))
    assert held.has(k1[1500:], k2[1500:]).all() and held.has(k1[:1500], k2[:1500]).mean() < 0.01
    assert not lines.CuckooFilter(4).delete(1, 2)


def unpack(rows, limits):
    sequences, pieces = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [builtins_sum(q.length for q in own[:k]) for k in range(len(own))]
        n = builtins_sum(r.length for r in own)
        assert n <= limits.tokens and len(own) <= limits.segments and builtins_sum(r.loss_tokens for r in own) <= limits.loss
        padding += 0 if n & (n - 1) == 0 else limits.tokens - n
        total += n
    return pieces, padding / max(1, total)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 64, 64), packing.Limits(64, 3, 40)])
def test_packing(spark, texts, limits):
    from tokenizers import Tokenizer

    odd = ["O'Neil's ²³¼ ªº İstanbul ΑΣ ß ſ áb x\xa0y z\x1c \x85q", "<|endoftext|> a", "日本語 text 123 -- $$$!! a,, b, c.\nd.. e", "a\x00\x7f."]
    every = [*texts, *odd]
    plain = Tokenizer.from_file(TOKENIZER)
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in every]
    docs = documents(spark, every).selectExpr("*", "pmod(doc_id, 7) * 3 AS prompt", "1 AS length", "2 AS ids")
    rows = packing.pack(docs.repartition(3, "doc_id"), TOKENIZER, limits, loss_from="prompt", with_ids=True).collect()
    pieces, padding = unpack(rows, limits)
    for d, ids in enumerate(expected):
        own = sorted(pieces[d, len(ids)], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == [builtins_sum(q.length for q in own[:k]) for k in range(len(own))]
        assert builtins_sum(r.loss_tokens for r in own) == max(0, len(ids) - d % 7 * 3)
    if limits.segments == limits.tokens:
        assert padding < 0.02
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    draw = random.Random(6)
    signs = [*"abzAZ_019 ,.\n\t'-!?<|>()\x00\x1c\x1d\x1e\x1f\x0b\x0c\r\x85\xa0\xad\u0300\u0301\u0130\u0131\xdf\u0149\u01c5\u02b0\xe9\xc9\xaa\xb2\xbd\u200d\u3000\u4e2d\ufeff", ", ", ". ", ".\n", "'s", "'S", "_, ", "_. ", "the ", "<|endoftext|>"]
    for some in (signs, [s for s in signs if max(s) < "\u0250"]):
        for _ in range(20_000):
            text = "".join(draw.choices(some, k=draw.randint(1, 14)))
            assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer.from_file(TOKENIZER)
    plain.pre_tokenizer = pre_tokenizers.ByteLevel()
    plain.save(path := str(tmp_path / "other.json"))
    own = packing.WordTokenizer(path)
    for text in ("Some words, of  text. And_, more", "a b", " x"):
        assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_turns_are_packed_under_all_limits(spark):
    from quarrylog.llm import queries

    rows = queries.conversations_packing(spark, "/root/testdata/sf0.001").collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        assert builtins_sum(r.length for r in own) <= 2048 and len(own) <= 12 and builtins_sum(r.loss_tokens for r in own) <= 1024
    assert all(r.loss_tokens == (r.length if r.role == "assistant" else 0) for r in rows)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.conv_id, r.turn, r.role), []).append(r.length)
    assert spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role").distinct().count() == len(pieces)


def test_pii(spark):
    key, texts = b"k", ["card 4111 1111 1111 1111, again 4111-1111-1111-1111", "4111111111111112 is none", None, "", "on 2024-02-29, 31.12.1999 and 02/28/2001; not 2023-02-30", "call +1 (017) 555-7713 or und.34@mail7.example.com from 97.51.17.173", "DE89 3704 0044 0532 0130 00 and 123-45-6789", "4111111111111111"]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(spark, texts), key).collect()}
    kinds = {d: [f.kind for f in r.found] for d, r in got.items()}
    assert kinds == {0: ["card", "card"], 1: [], 2: [], 3: [], 4: ["date"] * 3, 5: ["phone", "email", "ip"], 6: ["iban", "ssn"], 7: ["card"]}
    assert got[2].text is None and got[1].text == texts[1]
    plain = lambda s: re.sub(r"\D", "", s)
    same = {plain(f.pseudonym) for d in (0, 7) for f in got[d].found}
    assert len(same) == 1 and pii.luhn_digit((n := same.pop())[:-1]) == n[-1] and n != "4" + "1" * 15
    assert pii.iban_rest(got[6].found[0].pseudonym.replace(" ", "")) == 1
    assert all(re.sub(r"[0-9A-Za-z]", "", f.pseudonym) == re.sub(r"[0-9A-Za-z]", "", texts[d][f.start : f.end]) for d, r in got.items() for f in r.found)
    back = {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, [got[d].text for d in range(len(texts))]), key, back=True).collect()}
    assert [back[d] for d in range(len(texts))] == texts
    assert {r.doc_id: r.text for r in pii.pseudonymise(documents(spark, texts), b"other").collect()} != {d: r.text for d, r in got.items()}


def test_days_are_linked_across_formats():
    names, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", True)
    text = "2020-02-28 28/02/2020 02/28/2020 2/28/2020 28.2.2020 2020/2/28 3/4/2020 03/04/2020 11/12/1999"
    made, found = names.replace(text)
    assert [f[2] for f in found] == ["date"] * 9 and len(made) == len(text)
    numbers = [sorted(map(int, re.split("[-/.]", f[3]))) for f in found]
    assert all(x == numbers[0] for x in numbers[:6]) and numbers[6] == numbers[7] and numbers[0] != [2, 28, 2020]
    assert back.replace(made)[0] == text


def test_addresses_and_versions():
    names = pii.Pseudonyms(b"k")
    for text, n in [("a.b@x.co, c@mail.example.com. d@e", 2), ("@x.com a@@b.com x.@y.com", 0), ("version 1.2.3.4, v1.2.3.4, Release: 1.2.3.4", 0), ("at 1.2.3.4", 1), ("a@b.com9 c@d.e-f", 1)]:
        made, found = names.replace(text)
        assert len(found) == n and (made == text) == (n == 0)
        assert pii.Pseudonyms(b"k", True).replace(made)[0] == text


def test_long_runs_take_linear_time():
    draw = random.Random(1)
    for text in ("".join(draw.choices("0123456789", k=1 << 20)), "".join(draw.choices("ABCDEFabcdefXYZ0123456789+/", k=1 << 20)), "a@" * (1 << 19), "a." * (1 << 19) + "@"):
        began = time.time()
        pii.Pseudonyms(b"k").replace(text)
        assert time.time() - began < 20


def test_planted_values_are_found_and_undone(spark):
    """Valid values of every kind among words and invalid ones: these and no others are found, keep their form, and can be undone."""
    draw = random.Random(5)
    digits = lambda n: "".join(draw.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        return body + pii.luhn_digit(body)

    def iban():
        body = "DE00" + digits(18)
        return body[:2] + f"{98 - pii.iban_rest(body):02d}" + body[4:]

    valid = {"card": card, "iban": iban, "email": lambda: f"x{digits(3)}@mail.example.org", "ip": lambda: ".".join(str(draw.randint(1, 255)) for _ in range(4)), "date": lambda: f"{draw.randint(1, 28):02d}.{draw.randint(1, 12):02d}.{draw.randint(1900, 2099)}", "ssn": lambda: f"{draw.randint(1, 665):03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}", "secret": lambda: "a1" + "".join(draw.choices("0123456789abcdef", k=38)), "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}"}
    invalid = [lambda: "31.02.2001", lambda: "300.1.1.1", lambda: "000-11-2222", lambda: (c := card())[:-1] + str((int(c[-1]) + 1) % 10), lambda: "no@where"]
    texts, planted = [], []
    for _ in range(200):
        words, own = [], []
        for _ in range(draw.randint(1, 12)):
            kind = draw.random()
            if kind < 0.3:
                own.append((name := draw.choice(list(valid)), value := valid[name]()))
                words.append(value)
            elif kind < 0.5:
                words.append(draw.choice(invalid)())
            words.append("".join(draw.choices("qrstu", k=4)))
        texts.append(" ".join(words))
        planted.append(own)
    got = sorted(pii.pseudonymise(documents(spark, texts), b"k").collect(), key=lambda r: r.doc_id)
    seen = {}
    for r, text, own in zip(got, texts, planted, strict=True):
        assert [(f.kind, text[f.start : f.end]) for f in r.found] == own and r.n_found == len(own)
        assert len(r.text) == len(text) or any(k == "ip" for k, _ in own)
        for f in r.found:
            assert seen.setdefault((f.kind, text[f.start : f.end]), f.pseudonym) == f.pseudonym
    assert len(set(seen.values())) == len(seen)
    back = pii.pseudonymise(documents(spark, [r.text for r in got]), b"k", back=True).collect()
    assert [r.text for r in sorted(back, key=lambda r: r.doc_id)] == texts


@pytest.mark.parametrize("size", [1, 2, 10, 898, 4096])
def test_feistel_networks_permute(size):
    net = pii.Feistel(b"key")
    made = [net.permute(v, size, b"t") for v in range(size)]
    assert sorted(made) == list(range(size)) and [net.permute(v, size, b"t", back=True) for v in made] == list(range(size))


@pytest.fixture(scope="module")
def tree():
    return extract.TreeModel(*extract.trained())


def test_extraction_of_held_out_pages(tree):
    right = total = 0
    for page in extract.labelled_pages(120, seed=77):
        nodes = extract._labelled(page)
        for node, odds in zip(nodes, tree.messages(nodes)[0], strict=True):
            if node.chars:
                total += 1
                right += (odds >= 0) == node.label
    assert right / total > 0.98


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>Only &amp; text\n here", "Only & text here"), ("plain text", "plain text"),
        ('<body><nav><ul><li><a href="/">Home</a></li><li><a href=/b>More</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A title</h1><p><b>A title<br><p>First words, and <i>more</i> of them.</p><p>Second &lt;one&gt;.</article><section class=comments><p>I like it a lot.</p></section><footer>&copy; me</footer>', "A title\n\nA title\n\nFirst words, and more of them.\n\nSecond <one>."),
        ('<script>var t="</p>";</script><style>p{}</style><div class="content"><p>Some words of text here.<!-- <p>no</p> --></p></div>', "Some words of text here."),
    ],
)
def test_extraction(tree, page, text):
    assert extract.main_text(page, tree) == text


def test_extraction_of_broken_pages(spark, tree):
    pages = ["<<<>>>", "</p></p>" * 50, "<div>" * 3000 + "deep", "<p" + " a=b" * 1000, "<a href='" + "x" * 100000, "<table><tr><td>a<td>b<tr><td>c"]
    df = spark.createDataFrame([(k, "u", p, 1) for k, p in enumerate(pages)] + [(None, None, None, 2), (0, "u", "", 3)], "page_id bigint, url string, html string, text int")
    got = extract.extract(df).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)


def plain_article(page):
    """The blocks of the one article of a page of the test tables."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub("<[^>]*>", "", x.replace("<br>", " ")) for x in re.split("</?(?:h1|p)>", inner))
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in blocks) if t)


def test_extraction_against_the_articles_of_all_pages(spark):
    """Every row of the query, against the article that stands in the page's source."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = extract.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, plain_article(source[r.page_id].html), len(r.text))


@pytest.mark.parametrize("k", [1, 40, 80, 200, 2000])
def test_long_lists_of_short_blocks_stay(tree, k):
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Rech.</h1>" + "<p>Les Rech.</p>" * k + "</article><footer>me</footer>"
    assert extract.main_text(page, tree) == "\n\n".join(["Rech.", *["Les Rech."] * k])


def test_scripts_and_quotes(tree):
    article = "<article><h1>A title</h1><p>Some text of the article here, and a little more of it.</p>{}</article>"
    for odd, more in [("<script src=/x/>var a=1;</script>", ""), ("<script src='a.js'/>var a=1;</script>", ""), ("<style/>p{}</style>", ""), ("<svg/>", ""), ("<div class=foo/></div>", ""), ('<p><a title="it>word</a> and more words.</p>', "\n\nword and more words."), ("<p title=it's>More words here.</p>", "\n\nMore words here.")]:
        assert extract.main_text(article.format(odd), tree) == "A title\n\nSome text of the article here, and a little more of it." + more


def test_messages_are_exact(tree):
    """Against all labellings of a small tree."""
    nodes, _ = extract.parse("<div><p>some words</p><ul><li><a href=x>one</a>" + "<li>two" * 6 + "</ul></div>")
    odds, _, feats, kinds = tree.messages(nodes)
    weight = {}
    for bits in range(1 << len(nodes)):
        own = [bits >> k & 1 for k in range(len(nodes))]
        s = builtins_sum(nodes[k].share * builtins_sum(tree.unary[i] for i in feats[k]) * own[k] for k in range(len(nodes)))
        s += builtins_sum(tree.edge[kinds[k]][2 * own[nodes[k].parent] + own[k]] for k in range(1, len(nodes)))
        weight[tuple(own)] = np.exp(s)
    for k in range(len(nodes)):
        on = builtins_sum(v for own, v in weight.items() if own[k]) / builtins_sum(weight.values())
        assert extract._sigmoid(odds[k]) == pytest.approx(on)


def plain_repeats(rows, length):
    """rows: (doc_id, text); null doc_ids come before all others."""
    out, seen = [], {}
    order = sorted({d for d, _ in rows}, key=lambda d: (d is not None, d or 0))
    raws = [(d, (t or "").encode()) for d, t in rows]
    for rank, d in enumerate(order):
        for o, raw in raws:
            if o == d:
                for i in range(len(raw) - length + 1):
                    seen.setdefault(raw[i : i + length], rank)
    for d, raw in raws:
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] < order.index(d):
                hit[i : i + length] = b"\1" * length
        kept = bytes(v for v, h in zip(raw, hit, strict=True) if not h)
        out.append((d, len(raw), builtins_sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram", "more"), [(50, 28, {}), (50, 24, {"held": 50, "hot": 2, "group": 1}), (20, 8, {"hot": 3, "group": 4}), (20, 8, {"held": 300, "hot": 2, "group": 10**6}), (12, 12, {})])
def test_repeats(spark, texts, length, gram, more):
    draw = random.Random(length)
    rows = list(enumerate(texts)) + [(1000 + k, "".join(draw.choices("ab", k=draw.randint(0, 400)))) for k in range(15)]
    passage = "".join(draw.choices("abcdefgh", k=length - 5))
    rows += [(2000 + k, "".join(draw.choices("xyz", k=6)) + passage + "".join(draw.choices("xyz", k=draw.randint(0, 6)))) for k in range(40)]
    draw.shuffle(rows)
    df = documents(spark, [t for _, t in rows], [d for d, _ in rows])
    got = substrings.remove_repeats(df, length, gram, **more).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == plain_repeats(rows, length)


def test_repeats_in_long_texts(spark):
    """Passages over the seams between the parts in which a text is hashed, and texts that repeat themselves."""
    draw = random.Random(8)
    seam = hashing.PART
    base = bytes(draw.choices(b"abcdefghijklmnop ", k=2 * seam + 500)).decode()
    passages = [base[k : k + n] for k, n in ((seam - 30, 60), (seam - 49, 50), (seam, 50), (2 * seam - 70, 140), (seam + 1000, 49))]
    rows = [(1, base), (2, "-".join(passages)), (3, "ab" * 700_000), (4, "x" + "ab" * 30)]
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, [t for _, t in rows], [d for d, _ in rows])).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert bytes(got[2].kept).decode() == "----" + passages[-1]
    assert bytes(got[4].kept) == b"x"


def test_strings_at_the_end_of_a_frequent_passage(spark, monkeypatch):
    """Each document that goes on differently after a frequent passage leaves few strings to compare, as many in a larger group."""
    resolved = substrings._resolved

    def rows_of(n):
        draw, read = random.Random(4), spark.sparkContext.accumulator(0)
        passage = "".join(draw.choices("abcdefghijklmnop ", k=61))
        rows = [(k, passage + "".join(draw.choices("abcdefghijklmnop ", k=90))) for k in range(n)]

        def counting(whole, some):
            def counted(batches):
                for batch in batches:
                    read.add(batch.num_rows if some is None else 0)
                    yield batch

            inner = resolved(whole, some)
            return lambda batches: inner(counted(batches))

        monkeypatch.setattr(substrings, "_resolved", counting)
        got = substrings.remove_repeats(documents(spark, [t for _, t in rows], [d for d, _ in rows]), group=200).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == plain_repeats(rows, 50)
        return read.value

    few, many = rows_of(400), rows_of(800)
    assert 0 < few <= 10 * 400 and many <= 2.2 * few


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_windows_that_go_on_over_batches(size):
    """The same strings are opened, however the sorted windows are cut into batches: those of pieces in several documents, or with a sign."""
    import pyarrow as pa

    draw = random.Random(6)
    kinds = {"g": pa.int64(), "c": pa.int64(), "doc": pa.int64(), "pos": pa.int64(), "piece": pa.binary()}
    windows = [(draw.randrange(12), draw.randrange(60), draw.randrange(3), substrings.MAYBE, bytes(draw.choices(b"abc", k=draw.randint(50, 54)))) for _ in range(30)]
    rows = sorted(windows + [(g, -(1 << 63), -(1 << 63), substrings.SIGN, None) for g in (2, 5, 5, 20)], key=lambda r: (r[0], r[2]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds.values(), strict=True)], names=list(kinds)) for i in range(0, len(rows), size)]
    got = sorted((r["doc"], r["pos"]) for b in substrings._opened(50, 28)(batches) for r in b.to_pylist())
    docs = {g: {r[2] for r in rows if r[0] == g} for g in range(12)}
    assert any(len(x) == 1 for x in docs.values())
    assert got == sorted((d, c + k) for g, c, d, _, piece in windows if len(docs[g]) > 1 for k in range(len(piece) - 49))


def test_texts_whose_contexts_had_equal_short_hashes(spark):
    """Two texts that share 28 bytes and no string of 50."""
    rows = [(1, "hgssndxdlavaau igoiglyiieecddsycymmcyzwemmzhiopkzslniee qxgppcmmzygmdtrg"), (2, "eqibmxclwczhwgzaoptinciieecddsycymmcyzwemmzhiopkzssddueswlctlcjlyyydnrgq")]
    assert all(r.n_removed == 0 for r in substrings.remove_repeats(documents(spark, [t for _, t in rows], [1, 2])).collect())


def test_every_string_has_its_anchor_wherever_it_stands():
    draw = random.Random(2)
    for length, gram in ((50, 28), (20, 8), (12, 12), (9, 3)):
        string = bytes(draw.choices(b"abc", k=length))
        seen = set()
        for _ in range(20):
            before = bytes(draw.choices(b"abc", k=draw.randint(0, 90)))
            text = before + string + bytes(draw.choices(b"abc", k=draw.randint(0, 90)))
            places = {int(p) - len(before) for p in substrings.anchors(np.frombuffer(text, np.uint8), length, gram)[0]}
            seen = seen & places if seen else places
        assert any(0 <= p <= length - gram for p in seen)


def test_repeats_with_repeated_and_null_ids(spark, texts):
    rows = [(None, texts[20]), (3, texts[20]), (3, texts[20] + "x"), (3, texts[20]), (4, texts[20]), (None, "a" * 80), (5, "a" * 200), (-7, None), (2**62, texts[20]), (-(2**46), "b" * 60), (-(2**50), "b" * 70)]
    df = documents(spark, [t for _, t in rows], [d for d, _ in rows])
    assert sorted(map(tuple, substrings.remove_repeats(df).drop("kept").collect()), key=str) == plain_repeats(rows, 50)
    assert sorted(map(tuple, substrings.remove_repeats(df, held=3, hot=1, group=0).drop("kept").collect()), key=str) == plain_repeats(rows, 50)
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_runs_that_go_on_over_batches():
    """The same marks, however the sorted rows are cut into batches."""
    import pyarrow as pa

    draw = random.Random(3)
    least = -(1 << 63)
    rows = sorted([(draw.randrange(6) << 16, draw.randrange(3), draw.randrange(8), draw.randrange(50)) for _ in range(80)] + [(7 << 16, least, least, -1), (7 << 16, 5, 3, 9), (8 << 16, 5, 3, 9)])

    def marks(size):
        batches = [pa.RecordBatch.from_pydict({"g": [r[0] for r in part], "c": [r[1] for r in part], "doc": [r[2] for r in part], "pos": [r[3] for r in part]}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        return sorted((r["doc"], r["a"], r["b"]) for b in substrings._resolved(substrings.COVERED, substrings.OPEN)(batches) for r in b.to_pylist())

    expected = []
    for g, c, d, p in rows:
        group = [r for r in rows if r[0] == g]
        first = min(r[2] for r in group if r[1] == c)
        if p < 0:
            continue
        if d > first:
            expected.append((d, p, substrings.COVERED))
        elif len({r[1] for r in group}) > 1:
            expected.append((d, p, substrings.OPEN))
    for size in (1, 2, 3, 7, 83):
        assert marks(size) == sorted(expected)


def plain_fingerprints(texts):
    """By hand: the words in the band, which subsets have them, and the hash of each subset's terms, with whole numbers only."""
    full = (1 << 64) - 1

    def word_hash(w):
        x = builtins_sum(int(hashing.VALUE[c]) * pow(hashing.BASE, k, 1 << 64) for k, c in enumerate(w.lower())) & full
        return mixed(x)

    def mixed(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & full
        x = (x ^ x >> 29) * 0x9E3779B97F4A7C15 & full
        return x ^ x >> 32

    words = lambda t: {w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())}
    seen = {}
    for t in texts:
        for w in words(t):
            seen[w] = seen.get(w, 0) + 1
    band = {w for w, n in seen.items() if 2 <= n <= max(2, 0.05 * len(texts))}
    cache = {}

    def of(text):
        own = words(text)
        own = own & band or own
        out = ""
        for w in own:
            cache.setdefault(w, word_hash(w))
        for j in range(1, imatch.GRADES + 1):
            for salt in map(int, imatch._SALTS):
                inside = [cache[w] for w in own if mixed(cache[w] * salt & full) < 1 << 64 - j]
                total = builtins_sum(mixed(h + 1 & full) for h in inside) & full
                out += f"{mixed(total + 7 & full) % 65535 + 1 if total else 0:04x}"
        return out

    return of


@pytest.mark.parametrize("most", [10**6, 0])
def test_imatch(spark, texts, most):
    ids = [7 * k - 50 for k in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    random.Random(1).shuffle(rows)
    docs = documents(spark, [t for _, t in rows], [d for d, _ in rows]).selectExpr("*", "1 AS bucket", "2 AS extra", "'x' AS fingerprint")
    got = {r.doc_id: r for r in imatch.imatch(docs, most=most).collect()}
    assert len(got) == len(rows)
    of = plain_fingerprints(texts)
    for k, d in enumerate(ids):
        text, following = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (of(text), of(edited))
        assert got[d].near_edited == imatch.likeness(of(text), of(edited)) and got[d].near_next == imatch.likeness(of(text), of(following))
        assert 0 <= got[d].near_edited <= 1
        if edited == text:
            assert got[d].fingerprint == got[d].edited_fingerprint and got[d].near_edited == 1
    assert got[ids[10]].fingerprint == got[ids[texts.index(texts[10], 11)]].fingerprint
    assert imatch.imatch(documents(spark, [])).count() == 0
    odd = imatch.imatch(documents(spark, ["a b", "a b c", None, "d", "d"], [None, 2**60 + 1, 2**60 + 2, 5, 5])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in odd if r.doc_id) == [(False, 5, 1), (False, 5, 1), (False, 2**60 + 1, 5), (False, 2**60 + 2, 0)]


def test_edited_texts_are_told_from_next_ones(spark):
    rows = imatch.imatch(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    edited, others = np.array([r.near_edited for r in rows]), np.sort([r.near_next for r in rows])
    above = (np.searchsorted(others, edited, "left") + np.searchsorted(others, edited, "right")).mean() / 2 / len(rows)
    assert above > 0.985


def test_warc_audit(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>page {k}</p>", 5) for k in range(600)] + [(None, None, None, 1), (5, "again", "x", 2)], "page_id bigint, url string, html string, length int")
    recs = warc.records(pages)
    held = {r.page_id: r for r in warc.audit(recs, recs).collect()}
    assert {r.status for r in held.values()} == {"sound"} and len(held) == 601
    hurt = warc.audit(recs, warc.damaged(recs)).where("status <> 'sound'").collect()
    assert sorted(r.page_id for r in hurt) == [0, 97, 194, 291, 388, 485, 582] and {r.status for r in hurt} == {"damaged"}
    gone = warc.audit(recs, recs.where("page_id is null or page_id <> 599")).where("status <> 'sound'").collect()
    assert [(r.page_id, r.status) for r in gone] == [(599, "missing")]
    more = warc.audit(recs.where("page_id is null or page_id <> 599"), recs).where("status <> 'sound'").collect()
    assert [(r.page_id, r.status) for r in more] == [(599, "extra")]
    assert warc.audit(recs.limit(0), recs.limit(0)).count() == 0
    for r in warc.files(recs.where("page_id >= 512")).collect():
        parsed = warc.parse(bytes(r.bytes))
        assert [(at, f["WARC-Target-URI"], block) for at, f, block in parsed] == [(held[k].offset, f"http://a/{k}", f"<p>page {k}</p>".encode()) for k in range(512, 600)]
    m = warc.manifest(recs.where("page_id between 256 and 511")).orderBy("place").collect()
    levels = warc.tree(warc.manifest(recs.where("page_id between 256 and 511")), Scratch(spark), "t")
    assert levels[-1].first().hash == warc.root_of([r.leaf for r in m])


def test_records_are_placed_in_order(spark):
    """Against plain sorting: null, negative, huge and repeated page_ids, equal and different records."""
    draw = random.Random(3)
    rows = [(draw.choice([None, -5, 7, 8, 300, 2**60 + 1, 2**60 + 2]), draw.choice("ab"), "x" * draw.randint(0, 3)) for _ in range(200)]
    recs = warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    files = {}
    for r in recs.collect():
        assert r.page_id is None or r.file == r.page_id // 256
        files.setdefault(r.file, []).append((r.page_id is not None, r.page_id or 0, hashlib.sha256(r.record).hexdigest(), len(r.record)))
    expected = set()
    for file, own in files.items():
        at = 0
        for place, (known, page, digest, length) in enumerate(sorted(own)):
            expected.add((file, page if known else None, place, at, length, digest))
            at += length
    got = warc.manifest(recs).drop("leaf").collect()
    assert {tuple(r) for r in got} == expected and len(got) == 200


def plain_score(model, text):
    """The logistic of the dot product, feature by feature, with whole numbers of Python."""
    weights, bias, scale = model
    raw, bits = (text or "").encode(), int(np.log2(len(weights)))
    kind = lambda c: 1 if c >= 128 or chr(c).isalnum() else 0 if c <= 32 or c == 127 else 2
    words, at = [], 0
    while at < len(raw):
        end = at + 1
        while end < len(raw) and kind(raw[end]) == kind(raw[at]):
            end += 1
        words += [raw[at:end]] if kind(raw[at]) else []
        at = end
    if not words:
        shares = {0: 1.0}
    else:
        full = (1 << 32) - 1

        def coded(w):
            x = builtins_sum(int(hashing.VALUE[c]) * pow(hashing.BASE, k, 1 << 64) for k, c in enumerate(w.lower() if kind(w[0]) == 1 else w)) % (1 << 64)
            return int(hashing.scrambled(np.array([x], np.uint64))[0]) >> 32

        def shape(w):
            if kind(w[0]) == 2:
                return 4096 + w[0] * 8 + min(len(w), 4)
            upper, digits = builtins_sum(65 <= c <= 90 for c in w), builtins_sum(48 <= c <= 57 for c in w)
            case = 1 if digits == len(w) else 2 if not upper else 3 if upper == len(w) > 1 else 4 if upper == 1 and 65 <= w[0] <= 90 else 5
            return case * 16 + min(len(w) // 4, 7)

        a, b, c = map(int, quality._MIX)
        word, form = [coded(w) for w in words], [shape(w) for w in words]
        kinds = [[x * a for x in word], [x * b for x in form]]
        for x in (word, form):
            pairs = [(u * b + v * c) & full for u, v in zip(x, x[1:], strict=False)]
            kinds.append([p ^ p >> 15 for p in pairs])
        triples = [((u * b + v) * c + w) & full for u, v, w in zip(form, form[1:], form[2:], strict=False)]
        kinds.append([t ^ t >> 13 for t in triples])
        shares = {}
        for own in filter(None, kinds):
            for x in own:
                place = (x * a & full) >> 32 - bits
                shares[place] = shares.get(place, 0) + 1 / len(own)
    z = scale * builtins_sum(float(weights[p]) * v for p, v in shares.items()) + bias
    return 1 / (1 + np.exp(-z))


def test_scores_by_hand(spark, texts):
    labelled = [("Plain words in a sentence, " + str(k), 1) if k % 2 else ("BUY $$$ NOW!!! " * 5, 0) for k in range(60)]
    model = quality.train(labelled)
    rows = [*texts, "A1b2 CAPS, x-y?! \x7f\t\x00 é"]
    for r in quality.score(documents(spark, rows), model).collect():
        assert r.score == pytest.approx(plain_score(model, rows[r.doc_id]), abs=1e-5)
    dear = spark.createDataFrame([(k, "en", "x", t, k) for k, t in enumerate(rows)], "doc_id bigint, lang string, label string, text string, score int")
    assert quality.score(dear, model).count() == len(rows) and quality.score(dear.limit(0), model).count() == 0


def test_held_out_documents_are_told(spark):
    from quarrylog.llm import queries

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and builtins_sum(a == b for a, b in held) >= 0.95 * len(held)


def test_ties_among_labels_and_texts(spark):
    docs = documents(spark, ["b", "a", "c"], [1, 1, 3])
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 1)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality.training_rows(docs, labels).select("doc_id", "text", "label").collect())) == [(1, "a", 0), (3, "c", 1)]


def test_quality():
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 9)))
    good = lambda: " ".join(word() for _ in range(draw.randint(5, 200))).capitalize() + "."
    bad = lambda: draw.choice([lambda: " ".join(word().upper() + "!!" for _ in range(50)), lambda: " | ".join(word() for _ in range(60)), lambda: (word() + " ") * 60])()
    made = [(good(), 1) if draw.random() < 0.8 else (bad(), 0) for _ in range(900)]
    score = quality.scorer(quality.train(made[:600]))
    right = builtins_sum((score(t) >= 0.7) == bool(label) for t, label in made[600:])
    assert right >= 0.97 * 300
    assert all(0 <= score(t) <= 1 for t in (None, "", " ", "é", "x" * 3_000_000))


def test_quality_scores(spark, texts):
    docs = documents(spark, [*texts, "a"], [*range(len(texts)), None])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(texts) + 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    learnt = {r.doc_id for r in quality.training_rows(docs, labels).collect()}
    assert learnt and not any(zlib.crc32(str(d).encode()) % 4 == 2 for d in learnt)
    empty = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in empty} == {0.5}


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, k) for k in range(5001, 5100)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    assert got == {v: find(v) for v in parent}


def test_hashes_are_the_same_anywhere():
    words = hashing.words_hashed("Ab ab  AB xyz".encode())
    assert len(set(words.tolist())) == 2
    assert hashing.words_hashed(None).size == 0 == hashing.words_hashed(b" \n").size
    long = b"word " * 700_000
    assert len(set(hashing.words_hashed(long).tolist())) == 1
    grams = hashing.grams_hashed(np.frombuffer(b"abcabcab", np.uint8), 3)
    assert grams[0] == grams[3] and grams[1] == grams[4] and len(set(grams.tolist())) == 3


def test_quality_learns_from_whole_texts(spark):
    tail = {0: " bad junk spam" * 40, 1: " good plain prose" * 40}
    texts = ["same words here " * 1500 + tail[k % 2] for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    weights, bias, scale = quality.fit(documents(spark, texts), labels)
    rows = sorted((r.doc_id for r in quality.training_rows(documents(spark, texts), labels).collect()), key=lambda d: zlib.crc32(str(d).encode()))
    whole = quality.train([(texts[d], d % 2) for d in rows])
    assert np.array_equal(weights, whole[0]) and (bias, scale) == whole[1:]
    of = quality.scorer((weights, bias, scale))
    assert min(of(t) for t in texts[1::2]) > max(of(t) for t in texts[::2])


@pytest.mark.parametrize("text", ["the _word_, next", "a snake_. b", "x_.\ny", "q\x1c, r \x1f. s", "\u0130, a. \u0130. b"])
def test_signs_before_commas_are_one_piece(text):
    from tokenizers import Tokenizer

    expected = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordTokenizer(TOKENIZER)(text), "<u4").tolist() == expected


@pytest.mark.parametrize("ids", [None, "null", "repeated"])
def test_frequent_lines_go_by_join_as_by_broadcast(spark, texts, ids):
    own = None if ids is None else [None] * len(texts) if ids == "null" else [k % 3 for k in range(len(texts))]
    docs = documents(spark, texts, own)
    small, large = (lines.drop_frequent_lines(docs, 10, broadcast_keys=n).collect() for n in (1000, 0))
    order = lambda rows: sorted(rows, key=repr)
    assert order(large) == order(small) != order(docs.collect()) and len(large) == len(texts)


def test_blocks_of_items_are_cut_as_one(spark):
    draw = random.Random(8)
    w = [f"w{draw.randrange(10**6)}" for _ in range(3000)]
    j = " ".join
    # parts of 3 % from each of several items; windows of two items that overlap; parts that are brought together by a cut
    items = [j(w[20 * k : 20 * k + 20]) for k in range(12)] + [j(w[300:320]), j(w[310:330]), j(w[340:347] + w[367:374]), j(w[347:367])]
    docs = [j(w[:20] + w[1000:1297] + w[20:40] + w[1297:1600]), j(w[300:330] + w[1600:2600]), j(w[340:374] + w[1600:2600]), j(w[1600:1900]), None, ""]
    docs += [j(w[20 * a : 20 * a + 20] + w[1000:1300] + w[20 * b : 20 * b + 20] + w[1300:1650]) for a in range(12) for b in range(a)]
    benchmark = spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string")
    once, blocks = (sorted(decontaminate.decontaminate(documents(spark, docs), benchmark, max_bytes=n).collect(), key=lambda r: r.doc_id) for n in (1 << 20, 100))
    assert blocks == once and {1, 2, 3, 4, 5} <= {r.doc_id for r in once} and len(once) < len(docs)


CARD, IBAN = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize(
    ("text", "value"),
    [(f"{CARD} 12/27", CARD), (f"{CARD} 123", CARD), (f"1234 {CARD}", CARD), (f"{IBAN} BIC X", IBAN), (f"{IBAN} 2024 a", IBAN), (f"{IBAN.replace(' ', '')} BIC", IBAN.replace(" ", "")), ("3782 822463 10005", "3782 822463 10005"), ("3782-822463-10005 1", "3782-822463-10005")],
)
def test_values_inside_failed_candidates(text, value):
    for k in range(60):  # with other keys some pseudonyms would pass the longer check by chance
        key = b"key%d" % k
        new, found = pii.Pseudonyms(key).replace(text)
        assert [text[a:b] for a, b, *_ in found] == [value] and value not in new and new != text
        assert pii.Pseudonyms(key, back=True).replace(new)[0] == text


OPERATORS = {
    "contamination": lambda docs, items, labels: decontaminate.contamination(docs, items),
    "contamination in blocks": lambda docs, items, labels: decontaminate.contamination(docs, items, block_bytes=20),
    "decontaminate": lambda docs, items, labels: decontaminate.decontaminate(docs, items).select("doc_id", "text"),
    "near duplicates": lambda docs, items, labels: simhash.near_duplicates(docs),
    "keep one": lambda docs, items, labels: simhash.keep_one(docs).select("doc_id", "text"),
    "lines": lambda docs, items, labels: lines.LineIndex.build(docs).apply(docs),
    "lines by join": lambda docs, items, labels: lines.LineIndex.build(docs, broadcast_keys=0).apply(docs),
    "frequent lines": lambda docs, items, labels: lines.drop_frequent_lines(docs).select("doc_id", "text"),
    "packing": lambda docs, items, labels: packing.pack(docs, TOKENIZER).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct(),
    "pii": lambda docs, items, labels: pii.pseudonymise(docs, b"k").drop("found"),
    "repeats": lambda docs, items, labels: substrings.remove_repeats(docs),
    "imatch": lambda docs, items, labels: imatch.imatch(docs),
    "quality": lambda docs, items, labels: quality.score(docs, quality.fit(docs, labels)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    """Nulls, ties, repeated rows, a very long text, columns of clashing names, and no rows at all: each operator has its result, and
    what is in other columns makes no difference."""
    draw = random.Random(12)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(500)]
    long = " ".join(draw.choices(words, k=400_000)) + "\n" + "x" * 1_200_000
    texts = [None, "", " ", "One short text.", "One short text.", long, "a\nb\nc", "4111 1111 1111 1111", None]
    ids = [0, 1, 2, 3, 3, 5, None, 7, None]
    docs = documents(spark, texts, ids)
    items = spark.createDataFrame([(1, "one short text of an item that is long enough to have a window of its own"), (None, None), (2, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id bigint, quality int")
    run = OPERATORS[name]
    plain = sorted(map(str, run(docs, items, labels).collect()))
    assert plain
    taken = "n_words n_hit spans ids row fp fp0 rep component component_id node mark keys n t key tile own places drop k1 k2 shard table kept doc at a b g c pos context bucket extra place terms term which score label quality values first found start end bytes digest held_out".split()
    more = docs.selectExpr("*", *(f"'z' AS `{c}`" for c in taken))
    assert sorted(map(str, run(more, items.selectExpr("*", "1 AS id", "2 AS row"), labels.selectExpr("*", "1 AS text", "2 AS label")).collect())) == plain
    assert run(docs.limit(0), items, labels).count() == 0
    assert run(docs.limit(0), items.limit(0), labels.limit(0)).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "Some words of a page. " * 60_000 + "</p></article>", "x", 1), (None, None, None, "y", 2), (1, "u", "", "z", 3), (1, "u", "", "z", 3)], "page_id bigint, url string, html string, text string, n_chars int")
    got = extract.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 60_000 * 22 - 1] and extract.extract(pages.limit(0)).count() == 0
    recs = warc.records(pages)
    assert {r.status for r in warc.audit(recs, recs).collect()} == {"sound"}
