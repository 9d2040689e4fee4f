"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or of other signs. Features are the words, their shapes (case, digits, length class), and
pairs and triples of neighbours, hashed to 2^bits places. A document is the sparse vector of its places' shares, and its
score the logistic of the dot product with the weights: one fixed-size array, whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, schema
from .hashing import DIGIT, SIGNS, UPPER, parts_of, word_hashes

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _shapes(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A code of each word's case, digits and length class, or of the first sign and the number of signs."""
    upper, digits = np.add.reduceat(UPPER[b], starts, dtype=np.int32), np.add.reduceat(DIGIT[b], starts, dtype=np.int32)
    length = np.add.reduceat(SIGNS[b] != 0, starts, dtype=np.int32)
    first = b[starts]
    case = np.select([digits == length, upper == 0, (upper == length) & (length > 1), (upper == 1) & UPPER[first]], [1, 2, 3, 4], 5)
    return np.where(SIGNS[first] == 2, 4096 + first.astype(np.int32) * 8 + np.minimum(length, 4), case * 16 + np.minimum(length // 4, 7)).astype(np.uint32)


class Features:
    """Text to (places, shares): for each kind of feature, the shares of its places in the document add up to 1."""

    def __init__(self, bits: int = 18):
        self.bits = bits

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words, shapes = [], []
        for part in parts_of((text or "").encode()):
            hashes, starts, b = word_hashes(part, SIGNS)
            if len(starts):
                words.append((hashes >> np.uint64(32)).astype(np.uint32))
                shapes.append(_shapes(b, starts))
        if not words:
            return np.array([0]), np.array([1.0])
        word, shape = np.concatenate(words), np.concatenate(shapes)
        n = len(word)
        kinds = [word * _MIX[0], shape * _MIX[1]]
        if n > 1:
            for x in (word, shape):
                pair = x[:-1] * _MIX[1] + x[1:] * _MIX[2]
                kinds.append(pair ^ (pair >> np.uint32(15)))
        if n > 2:
            triple = (shape[:-2] * _MIX[1] + shape[1:-1]) * _MIX[2] + shape[2:]
            kinds.append(triple ^ (triple >> np.uint32(13)))
        places = (np.concatenate(kinds) * _MIX[0]) >> np.uint32(32 - self.bits)
        return places.astype(np.int64), np.repeat([1 / len(k) for k in kinds], [len(k) for k in kinds])


class FtrlModel:
    """FTRL-proximal logistic regression: per place a sum of gradients z and of their squares n; weights follow from both."""

    def __init__(self, bits: int = 18, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(2)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        z, n = self.z[places], self.n[places]
        w = self._weights(z, n)
        b = -self.bias[0] / (self.beta + np.sqrt(self.bias[1])) * self.alpha
        error = (1 / (1 + np.exp(-np.clip(w @ values + b, -35, 35))) - label) * weight
        g = error * values
        self.z[places] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g
        self.bias += (error - (np.sqrt(self.bias[1] + error * error) - np.sqrt(self.bias[1])) / self.alpha * b, error * error)

    def weights(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n).astype(np.float32), float(-self.bias[0] / (self.beta + np.sqrt(self.bias[1])) * self.alpha)


def train(examples, bits: int = 18, passes: int = 3, scale: float = 8.0, **more) -> tuple[np.ndarray, float, float]:
    """(weights, bias, scale) from [(text, label)], in the order given, the classes weighed to count alike (at most 3 times)."""
    features = Features(bits)
    return train_sparse([(*sparse(features, text, scale), int(label)) for text, label in examples], bits, passes, scale, **more)


def sparse(features: Features, text: str | None, scale: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, values) of a whole text."""
    places, shares = features(text)
    distinct, inverse = np.unique(places, return_inverse=True)
    return distinct.astype(np.int32), (scale * np.bincount(inverse, shares)).astype(np.float32)


def train_sparse(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = 18, passes: int = 3, scale: float = 8.0, **more) -> tuple[np.ndarray, float, float]:
    """The same from [(places, values, label)]."""
    model = FtrlModel(bits, **more)
    ones = sum(label for *_, label in rows)
    weigh = {1: 1.0, 0: min(3.0, max(1.0, ones / max(1, len(rows) - ones)))}
    order = np.random.default_rng(1)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            places, values, label = rows[i]
            model.learn(places, values.astype(float), label, weigh[label])
    return *model.weights(), scale


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 5000, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled documents with crc32(doc_id as text) mod 4 other than 2, chosen by a hash of
    doc_id, a sample without regard to order or place. Rows without a label, or with null doc_id or label, are left out. Of several labels
    of a doc_id the least counts, and of several texts the first in order."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 5000, **more) -> tuple[np.ndarray, float, float]:
    """The model from a bounded sample of labelled rows, of `bound` documents.

    Workers turn each whole text into its places and values, and only these come to the driver.
    Without any usable row the model scores everything 0.5.
    """
    bounded_batches(docs.sparkSession)
    bits, scale = more.get("bits", 18), more.get("scale", 8.0)

    def run(batches):
        features = Features(bits)
        for batch in batches:
            found = [sparse(features, t, scale) for t in batch["text"].to_pylist()]
            yield batch_of({"doc_id": (batch["doc_id"], pa.int64()), "label": (batch["label"], pa.int32()), "places": ([p.tobytes() for p, _ in found], pa.binary()), "values": ([v.tobytes() for _, v in found], pa.binary())})

    rows = training_rows(docs, labels, bound).mapInArrow(run, schema(doc_id="long", label="int", places="binary", values="binary")).collect()
    if not rows:
        return np.zeros(1 << bits, np.float32), 0.0, 1.0
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return train_sparse([(np.frombuffer(bytes(r.places), np.int32), np.frombuffer(bytes(r["values"]), np.float32), r.label) for r in rows], **more)


def scorer(model: tuple[np.ndarray, float, float]):
    weights, bias, scale = model
    features = Features(int(np.log2(len(weights))))

    def score(text: str | None) -> float:
        places, shares = features(text)
        return float(1 / (1 + np.exp(-np.clip(scale * (weights[places] @ shares) + bias, -35, 35))))

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. held_out: crc32(doc_id as text) mod 4 is 2, false for null doc_id.

    Null and empty texts are scored by the bias and the weight of the place for no words. Repeated rows score alike.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = scorer(shared.value)
        for batch in batches:
            ids, scores = batch["doc_id"].to_pylist(), [of(t) for t in batch["text"].to_pylist()]
            yield batch_of({"doc_id": (ids, pa.int64()), "held_out": ([d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in ids], pa.bool_()), "score": (scores, pa.float64()), "predicted": ([int(s >= threshold) for s in scores], pa.int32())})

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(run, schema(doc_id="long", held_out="boolean", score="double", predicted="int"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([of(t) >= threshold for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
