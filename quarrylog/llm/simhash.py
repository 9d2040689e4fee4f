"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by bit-sliced comparison.

By the pigeonhole principle two fingerprints within the radius agree on `blocks - radius` of `blocks` bit blocks, so
each distinct fingerprint goes to one bucket for each choice of so many blocks. In a bucket the fingerprints are stored as 64
vertical bit planes. Shifting the planes by d compares every fingerprint with the one d places on, all at once:
the XOR of each plane with its shifted self is added to carry-save counters of two bits a lane, and a whole block of
lanes is abandoned as soon as every lane is over the radius.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, batch_of, bounded_batches, connected_components, schema, texts
from .hashing import scrambled, shingles_hashed, words_hashed

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half the XXH64 of the shingles, repeats included. No words: zero."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    counts, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for start in range(0, n, 1 << 16):
        part = words[start : start + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.array([h(g, seed) for g in grams], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts have fingerprint zero; rows stay as they are."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield batch_of({"doc_id": (batch["doc_id"], pa.int64()), "fp": (fps, pa.int64())})

    body = texts(docs, doc_id, text).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    return body.mapInArrow(run, schema(doc_id="long", fp="long"))


def bucket_masks(n: int, radius: int = 3, most: int = 64) -> list[int]:
    """The masks of the bit blocks that two fingerprints within the radius share one of. Finer blocks for more
    fingerprints, so that a bucket of evenly spread ones has about `most` at any n; the links found are the same."""
    m = radius + 1
    while n >> (BITS * (m - radius) // m) > most and m < 2 * radius + 6:
        m += 1
    edges = [BITS * k // m for k in range(m + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, m - radius)]


class Planes:
    """Fingerprints as bit planes: plane b holds bit b of every fingerprint, eight to a byte. LANES of them are compared at a time,
    and each such block is abandoned by itself, as soon as all of its lanes are over the radius."""

    LANES = 4096

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        packed = np.packbits(bits, axis=0, bitorder="little")
        self.planes = [np.ascontiguousarray(packed[:, b]).tobytes() for b in range(bits.shape[1])]
        self.looked = 0  # planes of blocks that were compared so far

    def near(self, shift: int, asked: np.ndarray, radius: int) -> np.ndarray:
        """The places i asked for such that fingerprints i and i + shift differ in `radius` bits or fewer."""
        found = [np.array([], np.int64)]
        for start in range(0, len(asked), self.LANES):
            part = asked[start : start + self.LANES]
            if part.any():
                lanes = self._block(start, shift, int.from_bytes(np.packbits(part, bitorder="little").tobytes(), "little"), radius)
                if lanes:
                    bits = np.unpackbits(np.frombuffer(lanes.to_bytes((len(part) + 7) // 8, "little"), np.uint8), bitorder="little")
                    found.append(start + np.nonzero(bits)[0])
        return np.concatenate(found)

    def _block(self, start: int, shift: int, lanes: int, radius: int) -> int:
        width, size = radius.bit_length(), self.LANES >> 3
        counters, over = [0] * width, 0
        a, b, rest = start >> 3, start + shift >> 3, start + shift & 7
        for n, plane in enumerate(self.planes):
            carry = int.from_bytes(plane[a : a + size], "little") ^ (int.from_bytes(plane[b : b + size + 1], "little") >> rest)
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if n % 8 == 7:
                self.looked += 8
                if radius + 1 != 1 << width:  # the counters reach beyond the radius
                    over |= _above(counters, radius)
                lanes &= ~over
                if not lanes:
                    break
        return lanes


def _above(counters: list[int], radius: int) -> int:
    """The lanes whose count exceeds radius, from the highest counter bit down."""
    above, equal = 0, -1
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _near(fps: np.ndarray, ids: np.ndarray, sizes: np.ndarray, radius: int, label: np.ndarray):
    """(places i, shift) such that i and i + shift are in one bucket, within the radius, and of different labels; rows are
    in order of falling bucket size. Labels may be changed between steps."""
    if not len(fps):
        return
    planes = Planes(fps)
    for shift in range(1, int(sizes[0])):
        prefix = int(np.searchsorted(-sizes, -shift, side="left"))  # the rows in buckets of more than `shift`
        # lanes of a bucket, and of those only pairs that are not linked yet
        asked = (ids[: prefix - shift] == ids[shift:prefix]) & (label[: prefix - shift] != label[shift:prefix])
        places = planes.near(shift, asked, radius)
        if len(places):
            yield places, shift


def _by_size(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket numbers, sizes), the largest buckets first: a shift concerns a prefix of the rows."""
    _, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, -count[inverse]))
    return order, inverse[order], count[inverse][order]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels of places a and b, each with each, and makes every label that of its group's first place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, deeper := label[label]):
            label[:] = deeper


def linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (a row of 64-bit words) the place of one that it reaches by links inside its bucket; the
    same place for all that reach each other."""
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    order, ids, sizes = _by_size(bucket)
    for places, shift in _near(fps[order], ids, sizes, radius, label):
        _join(label, places, places + shift)
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int, label: np.ndarray):
    """Arrays of places (a, b) that share a bucket and lie within the radius, of different labels."""
    order, ids, sizes = _by_size(bucket)
    for places, shift in _near(fps[order], ids, sizes, radius, label[order]):
        yield order[places], order[places + shift]


def _buckets(batches, words: int, *more: str):
    """(fingerprints, bucket numbers, further columns) of the rows (t, key, tile, rep, ...) that are not alone in a bucket."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts)
    t, key, tile, rep, *fp = (table[c].to_numpy() for c in ("t", "key", "tile", "rep", *(f"fp{k}" for k in range(words))))
    order = np.lexsort((rep, tile, key, t))
    t, key, tile = (x[order] for x in (t, key, tile))
    fps = np.stack([x[order] for x in fp], axis=1).view(np.uint64)
    bucket = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    full = np.bincount(bucket)[bucket] > 1
    return fps[full], bucket[full], *(table[c].to_numpy()[order][full] for c in ("rep", *more))


def _bucket_links(radius: int, words: int):
    """Spanning links inside each bucket (t, key, tile) of a partition, as pairs of representatives."""

    def run(batches):
        if not (found := _buckets(batches, words)):
            return
        fps, bucket, rep = found
        root = linked(fps, bucket, radius)
        link = root != np.arange(len(root))
        yield batch_of({"a": (rep[link], pa.int64()), "b": (rep[root[link]], pa.int64())})

    return run


def _dealt(reps: DataFrame, keys: list, n: int, tile: int, scratch: Scratch, name: str = "hot") -> DataFrame:
    """Rows of reps once for each key and tile, (t, key, tile, ...), dealt to partitions by these."""
    spark = scratch.spark
    spread = reps.select(*(c for c in reps.columns if c != "keys"), F.posexplode(F.array(*keys)).alias("t", "key"))
    hot = spread.groupBy("t", "key").count().where(F.col("count") > tile).select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    hot = scratch.write(hot, name)
    if hot.isEmpty():
        tiled = spread.withColumn("tile", F.lit(0))
    else:
        pairs = F.expr("transform(filter(sequence(0, tiles - 1), x -> x <> own), x -> least(x, own) * tiles + greatest(x, own))")
        tiled = spread.join(hot, ["t", "key"], "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("tile", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("tiles", "own")
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(keys) // 200_000)
    return tiled.repartition(deal, "t", "key", "tile")


def _classes(reps: DataFrame, keys: list, radius: int, words: int, n: int, tile: int, scratch: Scratch) -> DataFrame:
    """(node, component) of representatives (rep, fp0, ...) that share one of the keys and lie within the radius."""
    tiled = _dealt(reps.select("rep", *(f"fp{k}" for k in range(words))), keys, n, tile, scratch)
    links = tiled.mapInArrow(_bucket_links(radius, words), schema(a="long", b="long"))
    return connected_components(links, scratch)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def components(fps: DataFrame, scratch: Scratch, radius: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): component_id is the smallest doc_id that links reach.

    Equal fingerprints are brought to one representative first, with partial aggregation, so groups of exact copies
    cost one row. A bucket of more than `tile` distinct fingerprints is dealt to tiles; each pair of tiles is a group of
    its own, so none has more than about 2 * tile fingerprints. Only spanning links leave a task. Rows with null
    doc_id get their fingerprint's component. An empty table gives an empty one.
    """
    fps = scratch.write(fps, "fps")
    reps = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    n = reps.count()
    keys = [F.col("fp0").bitwiseAND(F.lit(_signed(m))) for m in bucket_masks(n, radius)]
    found = _classes(reps.where("rep is not null").select("rep", F.col("fp").alias("fp0")), keys, radius, 1, n, tile, scratch)
    classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), a row per document.

    Null and empty texts have fingerprint zero and are linked like any other. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = components(fingerprints(docs, shingle), scratch, radius, tile)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A wide fingerprint has as many 64-bit words; more bits make its distance a sharp estimate of similarity.
WIDE = 4
#: Odd constants that derive the other words' hashes from the first one's.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(shingles_hashed(words_hashed(text), shingle))


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> np.ndarray | None:
    """A fingerprint of WIDE words over the distinct shingles; None if there are no words."""
    hashes = shingle_set(text, shingle)
    return _wide(hashes) if len(hashes) else None


def _wide(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros((WIDE, BITS), np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        for k in range(WIDE):
            x = (part ^ (part >> np.uint64(29))) * _ODD[k]
            x = np.ascontiguousarray(x ^ (x >> np.uint64(32)), "<u8")
            counts[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<u8").reshape(-1)


def wide_radius(similarity: float, least: np.ndarray | int, sigmas: float = 5) -> np.ndarray:
    """The distance of wide fingerprints up to which shingle sets of this Jaccard similarity lie, the smaller of which has `least` members,
    with so many standard deviations of it: the cosine of two sets of like size is 2J / (1 + J), and a bit differs with probability
    angle / pi; in small sets, whose sums are coarse, somewhat more often (4 of 5: 3/16)."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.25 / np.asarray(least, float)
    n = BITS * WIDE
    return np.ceil(n * p + sigmas * np.sqrt(n * p * (1 - p))).astype(np.int64)


#: A key is made of so many least shingles: two sets share it with probability similarity ** ROWS, whatever their size.
ROWS = 5


@lru_cache
def _orders(n: int) -> np.ndarray:
    """Odd multipliers, each of which puts uniform hashes in an order of its own."""
    return (np.random.default_rng(11).integers(1 << 40, 1 << 63, (n, 1), dtype=np.uint64) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def least_keys(hashes: np.ndarray, tables: int) -> np.ndarray:
    """`tables` keys of a set of shingles: each mixes the least of its shingles under ROWS different orders."""
    orders = _orders(tables * ROWS)
    least = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 256):
        np.minimum(least, (hashes[start : start + 256] * orders).min(axis=1), out=least)
    return _mixed(least.reshape(tables, ROWS))


def _mixed(rows: np.ndarray) -> np.ndarray:
    x = rows[:, 0]
    for k in range(1, rows.shape[1]):
        x = x * np.uint64(0x9FB21C651E98DF25) + rows[:, k]
    return scrambled(x)


def tables_for(similarity: float, miss: float = 1e-4) -> int:
    """So many keys that sets at the similarity share none with probability `miss` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-min(similarity**ROWS, 1 - 1e-9))))


def _near_members(similarity: float, sigmas: float):
    """The rows (rep, t, key, tile, component) of those that have, in their bucket, another of like size within the radius for it
    and of another component."""

    def run(batches):
        if not (found := _buckets(batches, WIDE, "n", "component", "t", "key", "tile")):
            return
        fps, bucket, rep, n, label, *place = found
        chosen = np.zeros(len(rep), bool)
        for a, b in near_pairs(fps, bucket, int(wide_radius(similarity, 4, sigmas)), label):
            good = _in_reach(fps, n, a, b, similarity, sigmas)
            chosen[a[good]] = chosen[b[good]] = True
        names = ("rep", "component", "t", "key", "tile")
        for at in np.array_split(np.nonzero(chosen)[0], 1 + int(chosen.sum()) // 50_000):
            yield batch_of({k: (x[at], pa.from_numpy_dtype(x.dtype)) for k, x in zip(names, (rep, label, *place), strict=True)})

    return run


def _in_reach(fps, n, a, b, similarity: float, sigmas: float) -> np.ndarray:
    """Which pairs could have the similarity, by the sizes of their sets and by their distance."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    numerator, denominator = Fraction(str(similarity)).as_integer_ratio()
    distance = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1)
    return (denominator * low >= numerator * high) & (distance <= wide_radius(similarity, low, sigmas))


def links_of(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of the pairs of places (a, b) those that have the similarity, by the whole sets; pairs whose labels earlier ones have
    joined are left out. Labels change."""
    numerator, denominator = Fraction(str(similarity)).as_integer_ratio()
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    sizes = np.array([len(sets[i]) for i in used])
    words, items = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [items[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    labels, here, out = label[used], np.zeros(len(words), bool), []
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edges = np.r_[np.nonzero(np.r_[True, a[1:] != a[:-1]])[0], len(a)]
    for s, e in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        i = int(a[s])
        others = b[s:e][labels[b[s:e]] != labels[i]]
        for k in range(0, len(others), 256):
            part = others[k : k + 256]
            here[own[i]] = True
            common = np.add.reduceat(here[np.concatenate([own[j] for j in part])], np.r_[0, np.cumsum(sizes[part])[:-1]], dtype=np.int64)
            here[own[i]] = False
            for j in part[denominator * common >= numerator * (sizes[i] + sizes[part] - common)]:
                if labels[j] != labels[i]:
                    labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
                    out.append((int(used[i]), int(used[j])))
    return out


def _set_rows(shingle: int):
    """The whole set of each document's shingles, once for each bucket that it is a member of."""

    def run(batches):
        for batch in batches:
            for rep, component, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "component", "text", "places")), strict=True):
                own = shingle_set(text, shingle)
                for at in range(0, len(places), 64) if len(own) else ():
                    part = places[at : at + 64]
                    k = len(part)
                    fields = {c: ([x[c] for x in part], kind) for c, kind in (("t", pa.int32()), ("key", pa.int64()), ("tile", pa.int32()))}
                    yield batch_of(fields | {"rep": ([rep] * k, pa.int64()), "component": ([component] * k, pa.int64()), "own": ([own.tobytes()] * k, pa.binary())})

    return run


def _verified(similarity: float, sigmas: float, rows: int = 2048, size: int = 64 << 20):
    """Links (a, b) that join the members of each bucket (t, key, tile) which have the similarity: near ones by their fingerprints,
    held against each other on their whole sets. Buckets stream by, sorted, and no pair leaves but a link."""

    def told(held):
        bucket, rep, component, own = ([x for part in held for x in part[k]] for k in range(4))
        sets = [np.frombuffer(x, np.uint64) for x in own]
        codes = {b: k for k, b in enumerate(dict.fromkeys(bucket))}
        bucket, label = np.array([codes[b] for b in bucket]), np.array(component)
        fps, n = np.stack([_wide(x) for x in sets]), np.array([len(x) for x in sets])
        a, b = ([np.array([], np.int64)] for _ in range(2))
        for i, j in near_pairs(fps, bucket, int(wide_radius(similarity, 4, sigmas)), label):
            good = _in_reach(fps, n, i, j, similarity, sigmas)
            a.append(i[good])
            b.append(j[good])
        found = links_of(sets, np.concatenate(a), np.concatenate(b), label, similarity) if len(a) > 1 else []
        return batch_of({"a": ([rep[i] for i, _ in found], pa.int64()), "b": ([rep[j] for _, j in found], pa.int64())})

    def run(batches):
        held, n, weight = [], 0, 0
        for batch in batches:
            part = [list(zip(*(batch[c].to_pylist() for c in ("t", "key", "tile")), strict=True)), *(batch[c].to_pylist() for c in ("rep", "component", "own"))]
            held.append(part)
            n, weight = n + batch.num_rows, weight + batch.nbytes
            last = part[0][-1] if part[0] else None
            if (n >= rows or weight >= size) and last is not None and held[0][0] and held[0][0][0] != last:  # whole buckets only
                whole = [x for p in held for x in p[0]]
                cut = whole.index(last)
                cols = [[x for p in held for x in p[k]] for k in range(4)]
                yield told([[x[:cut] for x in cols]])
                held = [[x[cut:] for x in cols]]
                n, weight = len(cols[0]) - cut, sum(map(len, held[0][3]))
        if n:
            yield told(held)

    return run


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tile: int = 1024) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group of near-duplicates; all columns stay.

    Near-duplicates have a Jaccard similarity of `similarity` or more on distinct word shingles; groups are what such links
    join. Candidates share a key of least shingles, of which a pair at the similarity has none with probability 0.0001,
    have sets of like size, and wide fingerprints within the distance at which such sets lie and five standard deviations of it. Members of
    buckets that have a candidate there meet again with their whole sets of shingles (64-bit hashes) and are held against
    each other, so no pair below the similarity is linked, and no pairs but links leave a task. Equal sets are one node. A first round
    over two keys joins most copies, and nodes that it joins are not compared again. A bucket of more than `tile` nodes is dealt to
    pairs of tiles. Documents without words stay, as do rows with a null doc_id. Repeated rows of a doc_id stay or go together. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    fps, tables = [f"fp{k}" for k in range(WIDE)], tables_for(similarity)

    def run(batches):
        for batch in batches:
            ids, marks, sizes, words, keys = [], [], [], [], []
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if d is not None and len(hashes := shingle_set(t, shingle)):
                    ids.append(d)
                    marks.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    words.append(_wide(hashes))
                    keys.append(least_keys(hashes, tables).view(np.int64))
            words = np.array(words, np.uint64).reshape(-1, WIDE).view(np.int64)
            yield batch_of({"doc_id": (ids, pa.int64()), "mark": (marks, pa.binary()), "n": (sizes, pa.int32()), "keys": (keys, pa.list_(pa.int64()))} | {c: (words[:, k], pa.int64()) for k, c in enumerate(fps)})

    own = scratch.write(texts(docs).mapInArrow(run, schema(doc_id="long", mark="binary", n="int", keys="array<long>", **dict.fromkeys(fps, "long"))), "wide")
    least = own.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    reps = scratch.write(own.join(least, "mark").where("doc_id = rep").dropDuplicates(["mark"]).select("mark", "rep", "n", "keys", *fps), "reps")
    n = reps.count()

    def links(nodes: DataFrame, tables: int, sigmas: float, name: str) -> DataFrame:
        """The links that join nodes of different components which share one of the first `tables` keys."""
        dealt = _dealt(nodes, [F.col("keys")[k] for k in range(tables)], n, tile, scratch, f"hot{name}")
        members = dealt.mapInArrow(_near_members(similarity, sigmas), schema(rep="long", component="long", t="int", key="long", tile="int"))
        members = members.groupBy("rep").agg(F.min("component").alias("component"), F.collect_list(F.struct("t", "key", "tile")).alias("places"))
        sets = texts(docs).join(members.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id").mapInArrow(_set_rows(shingle), schema(t="int", key="long", tile="int", rep="long", component="long", own="binary"))
        met = sets.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile")
        return scratch.write(met.mapInArrow(_verified(similarity, sigmas), schema(a="long", b="long")), f"links{name}")

    nodes = reps.select("rep", "n", "keys", *fps)
    first = links(nodes.withColumn("component", F.col("rep")), min(2, tables), 0, "0")
    known = scratch.write(connected_components(first, scratch, "cc0_"), "known")
    nodes = nodes.join(known, nodes.rep == known.node, "left").select("rep", "n", "keys", *fps, F.coalesce("component", "rep").alias("component"))
    every = first.union(links(nodes, tables, 5, "1"))
    same = own.join(reps.select("mark", "rep"), "mark").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(every.union(same), scratch)
    extra = scratch.write(found.where("node <> component").select(F.col("node").alias("__extra")).distinct(), "extra")
    scratch.drop("wide", "reps", "links0", "links1", "known", "hot0", "hot1")
    return docs.join(extra, docs.doc_id == extra["__extra"], "left_anti")
