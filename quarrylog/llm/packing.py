"""Packing of token sequences: vector bin packing by the dot-product heuristic.

A piece of a document is a vector of tokens, segments (one) and loss-bearing tokens, and a sequence has a limit on each.
The open sequence takes the waiting piece with the largest dot product of its vector with the room that is left, both
relative to the limits. If none fits whole, the best one is cut to the room. Each partition packs its own rows as they
stream by, with a bounded number of waiting pieces, so nothing is shuffled and the result does not depend on what other
tasks do. What is left at a partition's end becomes sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, schema

#: Up to here a code point has no part in compositions, and lower-casing and its classes are plain.
_PLAIN = 0x250
_SPACES = "\t-\r \x85\xa0"


def _class(kind: str) -> str:
    return "".join(c for c in map(chr, range(_PLAIN)) if unicodedata.category(c)[0] == kind)


#: The vocabulary's own split into contractions, letters, single digits and other signs, for plain code points.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACES}{_class('L')}{_class('N')}]+")
_OTHER = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")


#: The sign that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on, in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE = [chr(b) if b in _PRINTS else chr(256 + b - sum(p < b for p in _PRINTS)) for b in range(256)]


#: A sign before a comma or full stop that ends a piece; without any, these can be pieces of their own.
_SIGNS_END = re.compile(f"[^{_SPACES}{_class('L')}{_class('N')}][,.][ \n]")


class _Pieces(dict):
    """Of pieces met before, their ids; the others are made on the way. It is emptied when it holds `most`."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[piece] = self.make(piece)
        return found


#: What a vocabulary's file says of how texts are normalised and split, if they are handled piece by piece here. Fixed values.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of a vocabulary, as bytes of little-endian unsigned 32-bit ids.

    Vocabularies that split texts as _KNOWN says are handled piece by piece; texts go to any other's tokenizer whole. As no token crosses white space, the ids of a text are those of its pieces between spaces; they are kept for up to
    `most` pieces met before. Texts with code points from U+0250 on are not lower-cased or split here: their pieces go
    to the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.tokenize = self.encode.model.tokenize
        own = json.loads(self.encode.to_str())
        self.known = all(own[k] == v for k, v in _KNOWN.items()) and all(t["content"].startswith("<|") for t in own["added_tokens"])
        self.plain, self.raw = _Pieces(self._plain, most), _Pieces(self._raw, most // 4)

    def _raw(self, piece: str) -> bytes:
        return np.array(self.encode.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, piece: str) -> bytes:
        ids = [t.id for w in _WORD.findall(piece) for t in self.tokenize(w if w.isascii() and w.isprintable() else "".join(map(_BYTE.__getitem__, w.encode())))]
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self._raw(text)
        if _OTHER.search(text) or "<|" in text:
            return b"".join(map(self.raw.__getitem__, text.replace("\n", " ").split(" ")))
        apart = text.lower()
        if not _SIGNS_END.search(apart):
            apart = apart.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return b"".join(map(self.plain.__getitem__, apart.replace("\n", " ").split(" ")))


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048


class Packer:
    """Sequences out of documents, one after another. A piece waits as [row, start, end, first loss-bearing token]."""

    def __init__(self, limits: Limits, waiting: int = 512, least_cut: int = 8):
        self.limits, self.most, self.least_cut = limits, waiting, least_cut
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.rows: list[list] = []
        self.size = np.zeros((waiting + 1, 3))
        self.next_sequence = 0
        self.out: list[tuple] = []  # (row, start, end, sequence, offset)

    def _loss(self, start: int, end: int, first: int) -> int:
        return max(0, end - max(start, first))

    def _fitting(self, start: int, end: int, first: int, tokens: float, loss: float) -> int:
        """How far a piece can be cut to take `tokens` and `loss` at most."""
        return int(min(end, start + tokens, max(start, first) + loss))

    def add(self, row, n: int, first_loss: int = 0) -> None:
        start = 0
        while n - start >= self.limits.tokens or self._loss(start, n, first_loss) >= self.limits.loss:
            end = self._fitting(start, n, first_loss, self.limits.tokens, self.limits.loss)
            self.out.append((row, start, end, self._sequence(), 0))
            start = end
        if start < n:
            self._wait(row, start, n, first_loss)
            if len(self.rows) > self.most:
                self._fill()

    def _sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def _wait(self, *piece) -> None:
        self.size[len(self.rows)] = (piece[2] - piece[1], 1, self._loss(*piece[1:]))
        self.rows.append(list(piece))

    def _take(self, i: int) -> list:
        piece, last = self.rows[i], len(self.rows) - 1
        self.rows[i], self.size[i] = self.rows[last], self.size[last]
        self.rows.pop()
        return piece

    def _picks(self) -> list[tuple]:
        """The pieces of one sequence, cut where needed: (row, start, end)."""
        room, picks = self.full.copy(), []
        while self.rows and room[0] > 0 and room[1] >= 1:
            size = self.size[: len(self.rows)]
            score = (size / self.full) @ (room / self.full)
            fits = (size <= room).all(axis=1)
            if fits.any():
                row, start, end, first = self._take(int(np.argmax(np.where(fits, score, -1))))
            elif room[0] < self.least_cut:
                break
            else:
                best = int(np.argmax(score))
                row, start, end, first = self.rows[best]
                stop = self._fitting(start, end, first, room[0], room[2])
                if stop <= start:
                    break
                self._take(best)
                self._wait(row, stop, end, first)
                end = stop
            picks.append((row, start, end))
            room -= (end - start, 1, self._loss(start, end, first))
        return picks

    def _fill(self) -> None:
        at, sequence = 0, self._sequence()
        for row, start, end in self._picks():
            self.out.append((row, start, end, sequence, at))
            at += end - start

    def finish(self) -> None:
        """The rest: full sequences while there is enough, then sequences of power-of-two lengths."""
        while self.rows:
            picks = self._picks()
            used = sum(e - s for _, s, e in picks)
            ends, total = [], 0
            if used + self.least_cut > self.limits.tokens:
                ends = [used]
            else:
                for bit in reversed(range(used.bit_length())):
                    if used >> bit & 1:
                        total += 1 << bit
                        ends.append(total)
            at = begun = 0
            sequence = self._sequence()
            for row, start, end in picks:
                while start < end:
                    stop = min(end, start + ends[0] - at)
                    self.out.append((row, start, stop, sequence, at - begun))
                    at, start = at + stop - start, stop
                    if at == ends[0] and len(ends) > 1:
                        begun = ends.pop(0)
                        sequence = self._sequence()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer: str, limits: Limits | None = None, end_id: int = 1, waiting: int = 512, loss_from: str | None = None, with_ids: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset (and ids, and the columns `also`).

    A document is the ids of its text and then end_id; null and empty texts are just end_id. start counts the
    document's ids before the piece, offset those of the sequence. loss_from names a column with the number of a document's
    leading tokens that bear no loss (null: 0). Each id lies in one piece. Sequences are to be padded to limits.tokens,
    unless their length is a power of two; where no limit but that on tokens holds, fewer than 8 ids of a sequence are padding.
    Rows are packed as they are, so repeated doc_ids make pieces of their own; null doc_ids stay null; other columns are ignored.
    Identical partitions give identical sequences, so a task that is run again changes nothing. An empty table gives no rows.

    sequence_id is the partition's number times 2^32 and a count. Tokenizer files are read at `tokenizer` on the workers.
    """
    limits = limits or Limits()
    bounded_batches(docs.sparkSession)
    first_loss = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), first_loss.alias("first"), *(F.col(c).alias(f"also_{c}") for c in also))

    def run(batches):
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        ids_of = _TOKENIZERS[tokenizer]
        base = TaskContext.get().partitionId() << 32
        packer = Packer(limits, waiting)
        end = np.array([end_id], "<u4").tobytes()

        def drained():
            out = packer.drain()
            ids = [r[1][4 * s : 4 * e] for r, s, e, _, _ in out]
            yield batch_of(
                {
                    "doc_id": ([r[0] for r, *_ in out], pa.int64()),
                    "start": ([s for _, s, *_ in out], pa.int64()),
                    "length": ([e - s for _, s, e, *_ in out], pa.int64()),
                    "ids_crc32": (list(map(zlib.crc32, ids)), pa.int64()),
                    "doc_tokens": ([len(r[1]) // 4 for r, *_ in out], pa.int64()),
                    "loss_tokens": ([max(0, e - max(s, r[2])) for r, s, e, *_ in out], pa.int64()),
                    "sequence_id": ([base + q for *_, q, _ in out], pa.int64()),
                    "offset": ([o for *_, o in out], pa.int64()),
                }
                | ({"ids": (ids, pa.binary())} if with_ids else {})
                | {c: ([r[3][k] for r, *_ in out], kind) for k, (c, kind) in enumerate(zip(also, own, strict=True))}
            )

        own = [pa.null()] * len(also)
        for batch in batches:
            own = [batch[f"also_{c}"].type for c in also]
            rest = zip(*(batch[f"also_{c}"].to_pylist() for c in also), strict=True) if also else repeat(())
            for doc, text, first, more in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "first")), rest):  # noqa: B905  rest may be endless
                ids = ids_of(text) + end
                packer.add((doc, ids, first, more), len(ids) // 4, first)
            yield from drained()
        packer.finish()
        if packer.out:
            yield from drained()

    kinds = {k: "long" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")}
    kept = {c: body.schema[f"also_{c}"].dataType.simpleString() for c in also}
    return body.mapInArrow(run, schema(**kinds, **({"ids": "binary"} if with_ids else {}), **kept))
