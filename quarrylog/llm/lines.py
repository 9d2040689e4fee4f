"""Line deduplication: reference counts of lines, exact and reversible, behind sharded cuckoo filters.

The counts are tables (k1, k2, n), one a change: the 128-bit hash of a line's key and by how many documents that have it the count
grew or fell. For each shard of the keys a cuckoo filter holds those whose count has reached the limit. A change writes its own counts
only, and of the filters those of shards with keys that it took across the limit: these are inserted or deleted one by one.
Documents' lines are looked up in the filters, which go to every worker; the few keys that a filter has by mistake are found by the
exact counts before and go along as exceptions, so the answer is exact without the keys themselves.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, batch_of, bounded_batches, schema, texts

COUNTS = schema(k1="long", k2="long", n="long")


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends and with A-Z lower-cased; the empty key stands for no line."""
    return line.strip(SPACE).translate(LOWER)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key's other bucket follows from its fingerprint, so keys can be moved and
    deleted without being known. Keys are pairs of unsigned 64-bit hashes: arrays for lookups, integers else.

    Its size follows from `capacity`, so that it is at most 84 % full; it doubles by being built anew from the exact counts.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * self.SLOTS * 0.84 < capacity:
            buckets *= 2
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table.reshape(-1, self.SLOTS)
        if table is not None:
            self.mask = np.uint64(len(self.table) - 1)

    @staticmethod
    def _print(k2: np.ndarray) -> np.ndarray:
        return (k2 % np.uint64(65535)).astype(np.uint16) + np.uint16(1)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        prints = self._print(k2)
        first = (k1 >> np.uint64(8)) & self.mask
        return prints, first, self._other(first, prints)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(k1, k2)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, k1: int, k2: int) -> bool:
        """False if no place is left; the filter must then be built with a larger capacity."""
        prints, a, b = (x[0] for x in self._places(np.array([k1], np.uint64), np.array([k2], np.uint64)))
        for bucket in (a, b):
            if len(free := np.nonzero(self.table[bucket] == 0)[0]):
                self.table[bucket, free[0]] = prints
                return True
        undo = []
        for kick in range(self.KICKS):
            slot = (int(prints) + kick) % self.SLOTS
            undo.append((b, slot, self.table[b, slot]))
            self.table[b, slot], prints = prints, self.table[b, slot]
            b = self._other(np.array([b], np.uint64), np.array([prints], np.uint16))[0]
            if len(free := np.nonzero(self.table[b] == 0)[0]):
                self.table[b, free[0]] = prints
                return True
        for bucket, slot, was in reversed(undo):
            self.table[bucket, slot] = was
        return False

    def delete(self, k1: int, k2: int) -> bool:
        """Of a key that was inserted; False if it is not there."""
        prints, a, b = (x[0] for x in self._places(np.array([k1], np.uint64), np.array([k2], np.uint64)))
        for bucket in (a, b):
            if len(held := np.nonzero(self.table[bucket] == prints)[0]):
                self.table[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, capacity: int = 16) -> CuckooFilter:
        """All keys at once: each to its first bucket, if there is room, else to the other one, and the rest by moving others."""
        capacity = max(capacity, len(k1))
        while True:
            made = cls(capacity)
            prints, *buckets = made._places(k1, k2)
            left = np.arange(len(k1))
            for bucket in buckets:
                own = bucket[left].astype(np.int64)
                order = np.argsort(own, kind="stable")
                own, left = own[order], left[order]
                new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.array([], bool)
                rank = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
                slot = rank + (made.table[own] != 0).sum(axis=1)
                fits = slot < cls.SLOTS
                made.table[own[fits], slot[fits]] = prints[left[fits]]
                left = left[~fits]
            if all(made.insert(int(k1[i]), int(k2[i])) for i in left):
                return made
            capacity *= 2


def _hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: int = 300_000) -> DataFrame:
    """(k1, k2, n): the number of documents (rows) with each non-empty line key.

    Counts are added up inside each task before they are shuffled, `held` keys at a time, so a line that a third of all
    documents have costs a row or so a task.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            k1, k2 = _hashes(list(counts))
            out = batch_of({"k1": (k1.view(np.int64), pa.int64()), "k2": (k2.view(np.int64), pa.int64()), "n": (list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for body in batch["text"].to_pylist():
                if body:
                    counts.update(map(key_hash, {k for line in body.split(b"\n") if (k := line_key(line))}))
            if len(counts) > held:
                yield flush()
        if counts:
            yield flush()

    body = texts(docs, doc_id, text).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    return body.mapInArrow(run, COUNTS).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


class LineIndex:
    """The exact counts, the filters of the keys that reach the limit, and what follows from them. Every change gives a new
    index; the one it was made from still holds. Tables are in the shared folder."""

    #: After so many changes their counts are added up into one table.
    PARTS = 8

    def __init__(self, parts: list[DataFrame], filters: DataFrame | None, shards: int, scratch: Scratch, min_docs: int = 10, shard_keys: int = 200_000, broadcast_keys: int = 20_000_000):
        self.parts, self.shards, self.scratch, self.min_docs, self.shard_keys, self.broadcast_keys = parts, shards, scratch, min_docs, shard_keys, broadcast_keys
        self.filters = filters

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, **more) -> LineIndex:
        scratch = Scratch(docs.sparkSession)
        new = cls([scratch.write(line_counts(docs), scratch.fresh("counts"))], None, 1, scratch, min_docs, **more)
        new.shards = max(1, -(-new.frequent().count() // new.shard_keys))
        new.filters = scratch.write(new._built(new.frequent()), scratch.fresh("filters"))
        return new

    @property
    def counts(self) -> DataFrame:
        """(k1, k2, n) of all documents that are in."""
        if len(self.parts) == 1:
            return self.parts[0]
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n <> 0")

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs).select("k1", "k2")

    def _shard(self):
        return F.pmod("k2", F.lit(self.shards)).alias("shard")

    def _built(self, keys: DataFrame) -> DataFrame:
        """(shard, table): filters of the keys, with room for as many again."""

        def run(batches):
            parts = [b for b in batches if b.num_rows]
            if parts:
                t = pa.Table.from_batches(parts)
                shard, k1, k2 = t["shard"].to_numpy(), t["k1"].to_numpy().view(np.uint64), t["k2"].to_numpy().view(np.uint64)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    yield batch_of({"shard": ([s], pa.int64()), "table": ([CuckooFilter.of(k1[own], k2[own], 2 * int(own.sum())).table.tobytes()], pa.binary())})

        return keys.select(self._shard(), "k1", "k2").repartition(self.shards, "shard").mapInArrow(run, _FILTERS)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        scratch, limit = self.scratch, self.min_docs
        delta = scratch.write(line_counts(docs).select("k1", "k2", (F.col("n") * sign).alias("n")), scratch.fresh("delta"))
        was = self.counts.join(delta.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", F.col("n").alias("was"), F.lit(0).cast("long").alias("n"))
        both = was.unionByName(delta.select("k1", "k2", F.lit(0).cast("long").alias("was"), "n")).groupBy("k1", "k2").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))
        now = F.col("was") + F.col("n") >= limit
        crossed = scratch.write(both.where(now != (F.col("was") >= limit)).select(self._shard(), "k1", "k2", now.alias("enters")), scratch.fresh("crossed"))
        told = crossed.select("shard", F.lit(None).cast("binary").alias("table"), "k1", "k2", "enters")
        kept = self.filters.join(crossed.select("shard").distinct(), "shard", "left_semi").select("shard", "table", *(F.lit(None).cast(k).alias(c) for c, k in (("k1", "long"), ("k2", "long"), ("enters", "boolean"))))
        moved = kept.unionByName(told).repartition("shard").sortWithinPartitions("shard", F.col("table").isNull()).mapInArrow(_updated, _FILTERS)
        moved = scratch.write(moved, scratch.fresh("moved"))
        new = LineIndex([*self.parts, delta], None, self.shards, scratch, limit, self.shard_keys, self.broadcast_keys)
        if len(new.parts) > self.PARTS:
            new.parts = [scratch.write(new.counts, scratch.fresh("counts"))]
        filters = self.filters.join(moved.select("shard"), "shard", "left_anti").unionByName(moved.where("table is not null"))
        if not (full := moved.where("table is null").select("shard")).isEmpty():  # no room is left: these are built anew, with more
            keys = new.frequent().select(new._shard(), "k1", "k2").join(full, "shard", "left_semi")
            filters = filters.unionByName(scratch.write(new._built(keys), scratch.fresh("filters")))
        new.filters = scratch.write(filters, scratch.fresh("filters")) if len(new.parts) == 1 else filters
        return new

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents that were inserted."""
        return self._changed(docs, -1)

    def lookup(self, keys: DataFrame):
        """What finds the frequent ones of `keys` (k1, k2) on every worker: the filters and the exceptions; None if they are too large
        to go there, beyond broadcast_keys slots of two bytes."""
        tables = self.filters
        if (tables.agg(F.sum(F.octet_length("table"))).first()[0] or 0) > 2 * self.broadcast_keys:
            return None
        spark = self.scratch.spark
        shared = spark.sparkContext.broadcast((self.shards, [tuple(r) for r in tables.collect()], b""))

        def passed(batches):
            look = _Lookup(*shared.value)
            for batch in batches:
                k1, k2 = (batch[c].to_numpy() for c in ("k1", "k2"))
                yield batch.filter(pa.array(look.has(k1.view(np.uint64), k2.view(np.uint64)), pa.bool_()))

        wrong = keys.select("k1", "k2").mapInArrow(passed, schema(k1="long", k2="long")).distinct().join(self.frequent(), ["k1", "k2"], "left_anti").toPandas()
        digests = np.stack([wrong.k1.to_numpy(np.int64), wrong.k2.to_numpy(np.int64)], axis=1).astype(">i8").tobytes()
        return spark.sparkContext.broadcast((*shared.value[:2], digests))

    def _keys(self, docs: DataFrame, inside: bool) -> DataFrame:
        """The keys of the lines of docs; of all documents that are in, if docs are among them."""
        return self.counts if inside else line_counts(docs)

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True, inside: bool = False) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256, and kept, if asked for): the documents without lines that are frequent.

        inside: docs are all in the index. Null text counts as one empty line, which never goes; its kept text is empty. An empty table
        gives no rows; other columns are ignored. Filters beyond broadcast_keys stay where they are: rows are written with numbers,
        and each row's distinct keys meet the frequent keys in an equi-join that AQE can split at a hot key.
        """
        spark = docs.sparkSession
        bounded_batches(spark)
        body = texts(docs, doc_id, text).withColumnsRenamed({doc_id: "doc_id", text: "text"})
        if shared := self.lookup(self._keys(body, inside)):
            return body.mapInArrow(_apply(shared, with_kept), _KEPT + ", kept string" * with_kept)
        rows = self.scratch.write(body.withColumn("row", F.monotonically_increasing_id()), self.scratch.fresh("rows"))
        return rows.join(self._drops(rows), "row", "left").mapInArrow(_apply(None, with_kept), _KEPT + ", kept string" * with_kept)

    def _drops(self, rows: DataFrame) -> DataFrame:
        """(row, drop): the frequent keys of each numbered row that has any."""
        asked = rows.select("row", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_keys_of, schema(row="long", k1="long", k2="long"))
        return asked.join(self.frequent(), ["k1", "k2"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))


_FILTERS = schema(shard="long", table="binary")


def _updated(batches):
    """Each shard's filter, first of its rows, after the keys behind it entered or left; null if one found no room."""
    shard, held = None, None

    def out():
        return batch_of({"shard": ([shard], pa.int64()), "table": ([held.table.tobytes() if held else None], pa.binary())})

    for batch in batches:
        for s, table, k1, k2, enters in zip(*(batch[c].to_pylist() for c in ("shard", "table", "k1", "k2", "enters")), strict=True):
            if s != shard:
                if shard is not None:
                    yield out()
                shard, held = s, CuckooFilter(16) if table is None else None
            if table is not None:
                held = CuckooFilter(0, np.frombuffer(table, np.uint16).copy())
            elif held:
                key = k1 % (1 << 64), k2 % (1 << 64)
                if not (held.insert(*key) if enters else held.delete(*key)):
                    held = None
    if shard is not None:
        yield out()


_KEPT = schema(doc_id="long", n_lines="long", n_dropped="long", kept_sha256="string")


def _keys_of(batches):
    for batch in batches:
        rows, digests = [], []
        for row, body in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = {k for line in (body or b"").split(b"\n") if (k := line_key(line))}
            rows += [row] * len(own)
            digests += map(key_hash, own)
        k1, k2 = _hashes(digests)
        yield batch_of({"row": (rows, pa.int64()), "k1": (k1.view(np.int64), pa.int64()), "k2": (k2.view(np.int64), pa.int64())})


class _Lookup:
    """Which of many key hashes are frequent: those that their shard's filter has, but for the exceptions."""

    def __init__(self, shards: int, tables: list[tuple[int, bytes]], exceptions: bytes):
        self.shards = shards
        self.filters = {s: CuckooFilter(0, np.frombuffer(bytes(t), np.uint16)) for s, t in tables}
        self.exceptions = {exceptions[k : k + 16] for k in range(0, len(exceptions), 16)}

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k1), bool)
        shard = k2.view(np.int64) % np.int64(self.shards)
        for s in np.unique(shard).tolist():
            if f := self.filters.get(s):
                mine = np.nonzero(shard == s)[0]
                out[mine] = f.has(k1[mine], k2[mine])
        return out

    def __call__(self, digests: list[bytes]) -> set[bytes]:
        found = {digests[i] for i in np.nonzero(self.has(*_hashes(digests)))[0]} if digests else set()
        return found - self.exceptions


def _apply(shared, with_kept: bool):
    def run(batches):
        lookup = _Lookup(*shared.value) if shared else None
        for batch in batches:
            bodies = [(t or b"").split(b"\n") for t in batch["text"].to_pylist()]
            digests = [[key_hash(k) if (k := line_key(line)) else None for line in lines] for lines in bodies]
            if lookup:
                drops = [lookup(list({d for own in digests for d in own if d}))] * len(bodies)
            else:
                drops = _listed(batch["drop"])
            kept = [b"\n".join(line for line, d in zip(lines, own, strict=True) if d not in drop) for lines, own, drop in zip(bodies, digests, drops, strict=True)]
            lost = [sum(d in drop for d in own) for own, drop in zip(digests, drops, strict=True)]
            yield batch_of({"doc_id": (batch["doc_id"], pa.int64()), "n_lines": (list(map(len, bodies)), pa.int64()), "n_dropped": (lost, pa.int64()), "kept_sha256": ([hashlib.sha256(k).hexdigest() for k in kept], pa.string())} | ({"kept": ([k.decode(errors="replace") for k in kept], pa.string())} if with_kept else {}))

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, **more) -> DataFrame:
    """docs with text (and n_chars, if there is one) after the frequent lines went; all rows and columns stay.

    Null and empty texts stay as they are, as do rows with null or repeated doc_ids, which count as documents of their own. A document may
    be left with an empty text. An empty table gives no rows.
    """
    index = LineIndex.build(docs, min_docs, **more)
    bounded_batches(docs.sparkSession)
    if shared := index.lookup(index.counts):
        return docs.mapInArrow(_without(shared, docs.columns), docs.schema)
    rows = index.scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    drops = index._drops(rows.withColumnRenamed("__row", "row")).withColumnsRenamed({"row": "__row", "drop": "__drop"})
    return rows.join(drops, "__row", "left").mapInArrow(_without(None, docs.columns), docs.schema)


def _without(shared, columns: list[str]):
    """Rows of `columns` without the frequent lines: those that the broadcast index has, or that column __drop lists."""

    def run(batches):
        lookup = _Lookup(*shared.value) if shared else None
        for batch in batches:
            olds = batch["text"].to_pylist()
            lines = [t.split("\n") if t else [] for t in olds]
            digests = [[key_hash(k) if (k := line_key(x.encode())) else None for x in own] for own in lines]
            if lookup:
                drops = [lookup(list({d for own in digests for d in own if d}))] * len(olds)
            else:
                drops = _listed(batch["__drop"])
            new = [t if not t else "\n".join(x for x, d in zip(own, ds, strict=True) if d not in drop) for t, own, ds, drop in zip(olds, lines, digests, drops, strict=True)]
            fields = [batch.schema.field(c) for c in columns]
            yield pa.RecordBatch.from_arrays([_replaced(f, batch[f.name], new) for f in fields], schema=pa.schema(fields))

    return run


def _listed(column) -> list[set[bytes]]:
    """Each row's list of key hashes (k1, k2) as digests."""
    return [{np.array([x["k1"], x["k2"]], np.int64).astype(">i8").tobytes() for x in own or []} for own in column.to_pylist()]


def _replaced(field, column, new):
    if field.name == "text":
        return pa.array(new, field.type)
    if field.name == "n_chars":
        return pa.array([n if t is None else len(t) for n, t in zip(column.to_pylist(), new, strict=True)], field.type)
    return column
