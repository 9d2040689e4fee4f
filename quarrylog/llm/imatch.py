"""I-Match fingerprints: hashes of a document's distinct, sorted terms within a band of document frequency, for several
randomised subsets of that lexicon.

Subsets keep each term with probability 1/2, 1/4 and so on. Large subsets only agree for texts of the same terms, small ones
also for texts that share a part of them, so the share of equal hashes tells degrees of likeness for short and long texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, bounded_batches, schema
from .hashing import ALNUM, scrambled, words_hashed

#: Subsets keep a term with probability 2^-j, for each j from 1 to GRADES; EACH independent draws of them.
GRADES, EACH = 10, 32
_LEAST = -(1 << 63)
_SALTS = np.random.default_rng(11).integers(1, 1 << 62, EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def terms_of(text: str | None) -> np.ndarray:
    """The distinct terms of a text, as sorted hashes of its lower-cased words of letters and digits."""
    return np.unique(words_hashed((text or "").encode(), ALNUM))


def document_frequencies(docs: DataFrame, text: str = "text", held: int = 2_000_000) -> DataFrame:
    """(term, n): the number of documents with each term, over all documents, added up in each task first."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        parts, size = [], 0

        def out():
            terms, n = np.unique(np.concatenate(parts), return_counts=True)
            return batch_of({"term": (terms.view(np.int64), pa.int64()), "n": (n, pa.int64())})

        for batch in batches:
            for t in batch["text"].to_pylist():
                if len(found := terms_of(t)):
                    parts.append(found)
                    size += len(found)
            if size > held:
                yield out()
                parts, size = [], 0
        if parts:
            yield out()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, schema(term="long", n="long")).groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, scratch: Scratch, low: float = 1e-4, high: float = 0.05, text: str = "text") -> DataFrame:
    """(term): the hashes of the terms that a share from low to high of all documents has, and two at least."""
    counts = scratch.write(document_frequencies(docs, text), "frequencies")
    n = docs.count()
    return counts.where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).select("term")


def _inside(terms: np.ndarray, band: np.ndarray) -> np.ndarray:
    if not len(band) or not len(terms):
        return terms[:0]
    at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
    return terms[band[at] == terms]


def fingerprint(terms: np.ndarray, inside: np.ndarray) -> str:
    """Four hex digits for each subset, grade by grade: a hash of the sorted distinct terms in it, 0000 if there are none.

    inside: the terms of the text in the lexicon; a text without any is fingerprinted by all its terms, so that different ones differ.
    A draw gives each term a random number, whose leading zeros say in which grades it is: the subset of grade j has the terms
    with j zeros or more. The hash adds up the hashes of its terms.
    """
    terms = inside if len(inside) else terms
    sums = np.zeros(EACH * (GRADES + 1), np.uint64)
    if len(terms):
        numbers = scrambled(terms[None, :] * _SALTS[:, None])
        zeros = np.clip(64 - np.frexp(numbers.astype(float))[1], 0, GRADES)
        np.add.at(sums, (zeros + np.arange(EACH)[:, None] * (GRADES + 1)).ravel(), np.tile(scrambled(terms + np.uint64(1)), EACH))
    sums = sums.reshape(EACH, GRADES + 1)[:, ::-1]
    sums = np.cumsum(sums, axis=1, dtype=np.uint64)[:, ::-1][:, 1:]
    codes = np.where(sums == 0, np.uint64(0), scrambled(sums + np.uint64(7)) % np.uint64(65535) + np.uint64(1))
    return codes.T.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal hashes in the grade where it is highest, among its subsets that have a term of either, but of half of the
    grade's subsets at least. 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(v), ">u2").reshape(GRADES, EACH) for v in (a, b))
    equal, told = ((x == y) & (x != 0)).sum(axis=1), ((x != 0) | (y != 0)).sum(axis=1)
    return float((equal / np.maximum(told, EACH // 2)).max())


def with_next(docs: DataFrame, per_partition: int = 16) -> DataFrame:
    """(bucket, extra, doc_id, text), sorted in each partition by bucket and extra and in the order of doc_id, such that
    in each bucket every row with extra = 0 is followed by the next document, after the last one by the first.

    Buckets are ranges of doc_id. The first document of each goes to the bucket before too, as its extra last row. So
    each text is shuffled once, and no order over all documents is made in one place. Ties are ordered by text; nulls first.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(_LEAST)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = n * per_partition
    found = body.approxQuantile("place", [k / count for k in range(1, count)], 0.25 / count)
    bounds = np.unique(np.array([x for x in found if x > _LEAST], np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))

    starts = body.select(bucket_of("place").alias("bucket"), "place").groupBy("bucket").agg(F.min("place").alias("head")).orderBy("bucket").toPandas()
    heads, before = starts["head"].to_numpy(np.int64), np.roll(starts["bucket"].to_numpy(np.int32), 1)

    @F.pandas_udf("int")
    def ended_by(place: pd.Series) -> pd.Series:
        """The bucket whose last document is followed by this one; -1 if none is."""
        at = np.minimum(np.searchsorted(heads, place.to_numpy()), len(heads) - 1)
        return pd.Series(np.where(heads[at] == place.to_numpy(), before[at], -1).astype(np.int32))

    both = F.array(F.struct(bucket_of("place").alias("bucket"), F.lit(0).alias("extra")), F.struct(ended_by("place").alias("bucket"), F.lit(1).alias("extra")))
    dealt = body.withColumn("at", F.explode(both)).where("at.bucket >= 0").select("at.bucket", "at.extra", "doc_id", "text", "place")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "place", F.xxhash64("text"), "text").drop("place")


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string()}
_PRINTS = {"fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _edited(batches):
    """For each document and the one behind it: (doc_id, n_chars, hash of the edited text, the terms of the text, of the edited text and of
    the next text), a batch at a time."""
    now = None  # bucket, extra, doc_id, text, terms
    for batch in batches:
        out = []
        for bucket, extra, doc, text in zip(*(batch[c].to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
            row = (bucket, extra, doc, text or "", terms_of(text))
            if now and not now[1] and now[0] == bucket:
                n = len(now[3])
                edited = now[3][: n - n // 2] + row[3][: n // 2]
                out.append((now[2], n, hashlib.sha256(edited.encode()).hexdigest(), now[4], terms_of(edited), row[4]))
            now = row
        yield out


def _told(out: list[tuple], prints) -> pa.RecordBatch:
    """prints: (fingerprint, edited, next) of each row."""
    cols = list(zip(*((*row[:3], own, edited, likeness(own, edited), likeness(own, following)) for row, (own, edited, following) in zip(out, prints, strict=True)), strict=True)) or [()] * 7
    return batch_of({c: (v, k) for (c, k), v in zip((_OUT | _PRINTS).items(), cols, strict=True)})


def imatch(docs: DataFrame, low: float = 1e-4, high: float = 0.05, most: int = 4_000_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document in ascending doc_id. Null texts count as empty; texts without terms have a fingerprint of zeros.
    Null doc_ids come first; repeated doc_ids are in the order of their texts' hashes. A single document is its own next one. Other
    columns are ignored, and an empty table gives no rows.

    A lexicon of up to `most` terms, 8 bytes each, goes to every worker. A larger one stays where it is, and the terms of all
    texts meet it in an equi-join; the fingerprints are the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    band = scratch.write(lexicon(docs, scratch, low, high), "lexicon")
    scratch.drop("frequencies")
    kinds = schema(doc_id="long", n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")
    if band.count() > most:
        return _by_join(with_next(docs), band, scratch, kinds)
    shared = spark.sparkContext.broadcast(np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64)))
    scratch.drop("lexicon")

    def run(batches):
        held, last = shared.value, (None, "")
        for out in _edited(batches):
            prints = []
            for row in out:
                own = last[1] if last[0] is row[3] else fingerprint(row[3], _inside(row[3], held))
                last = row[5], fingerprint(row[5], _inside(row[5], held))
                prints.append((own, fingerprint(row[4], _inside(row[4], held)), last[1]))
            yield _told(out, prints)

    return with_next(docs).mapInArrow(run, kinds)


def _by_join(pairs: DataFrame, band: DataFrame, scratch: Scratch, kinds: str) -> DataFrame:
    """The same, with each text's terms held against the lexicon where it is. Rows are numbered and written, so that numbers hold."""
    names = ("own", "edited", "next")

    def listed(batches):
        for out in _edited(batches):
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield batch_of({c: (v, k) for (c, k), v in zip(_OUT.items(), cols[:3], strict=True)} | {c: ([x.view(np.int64) for x in v], pa.list_(pa.int64())) for c, v in zip(names, cols[3:], strict=True)})

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            prints = [tuple(fingerprint(*(np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in (r[c], r[f"in_{c}"]))) for c in names) for r in rows]
            yield _told([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows], prints)

    rows = pairs.mapInArrow(listed, schema(doc_id="long", n_chars="long", edited_sha256="string", **dict.fromkeys(names, "array<long>")))
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.select("row", F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).alias("terms")) for c in names))).alias("x")).select("row", "x.which", F.explode("x.terms").alias("term"))
    inside = asked.join(band, "term", "left_semi").groupBy("row").agg(*(F.collect_list(F.when(F.col("which") == c, F.col("term"))).alias(f"in_{c}") for c in names))
    return rows.join(inside, "row", "left").mapInArrow(run, kinds)
