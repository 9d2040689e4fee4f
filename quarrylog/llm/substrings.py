"""Exact substring deduplication: every byte covered by a long string that also starts in an earlier document goes.

A full suffix order is not built (see the README for why and for figures). Suffixes are sampled instead, by content: in
every string of `length` bytes one position is an anchor, chosen by the string's bytes alone, so two copies of the string hold the
same anchor at the same place. The anchors' suffixes, as hashes of the gram at the anchor and of all bytes that a string over it
could have, are sorted externally by Spark's exchange and sort. Neighbours in this order with the same context settle
whole neighbourhoods at once. Only where contexts of one gram differ, at the ends of passages, are the contexts themselves brought
together by their gram, and the strings in them compared.

Contexts are told apart by 128 bits: 48 of the gram, and 80 of the whole context that are independent of these; strings by 128 too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, bounded_batches, schema
from .hashing import BASE, INVERSE, PART, VALUE, _powers, scrambled

#: (doc, a, b, g): b > 0: the span [a, a + b); b = -1: all strings over the anchor at a are copies; b = -2: some may be.
MARKS = schema(doc="long", a="int", b="int", g="long")
COVERED, OPEN = -1, -2
#: What a row of an exchange is, by pos: a place; a sign that others have its key too; a span; an open anchor; strings that may have copies.
SIGN, SPAN, UNTOLD, MAYBE = -1, -2, -3, -4
_LOW = (1 << 32) - 1
_LEAST = -(1 << 63)
#: A second random value for each byte, with which sums are independent of those with the first.
OTHER = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


class _Base:
    """Powers of the base and of its inverse for a part of a text."""

    up = down = None

    @classmethod
    def of(cls, n: int):
        if cls.up is None or len(cls.up) < n:
            size = max(1 << 12, 1 << (n - 1).bit_length())
            cls.up, cls.down = _powers(BASE, size), _powers(INVERSE, size)
        return cls.up, cls.down


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every `width` neighbours, in log(width) whole-array steps."""
    size, y = 1, x
    while size * 2 <= width:
        y = op(y[:-size], y[size:])
        size *= 2
    return op(y[: len(y) - (width - size)], y[width - size :]) if size < width else y


def _prefix(b: np.ndarray, values: np.ndarray = VALUE) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Base.of(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * up[: len(b)], out=total[1:])
    return total, down


def _places(total: np.ndarray, down: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """The anchors of a text of n bytes, which has the prefix sums `total`.

    In a string, the leftmost of the small grams with the least hash is at x; the anchor is at x modulo the number of places
    for a gram. With the right size of small grams this picks fewer places than the least gram itself.
    """
    width = length - gram + 1
    small = min(4, gram) + (gram - min(4, gram)) % width
    m = n - small + 1
    h = (((total[small:] - total[:m]) * down[:m]) & ~_PLACE) | np.arange(m, dtype=np.uint64)
    start = np.arange(n - length + 1)
    x = (sliding(np.minimum, h, length - small + 1) & _PLACE).astype(np.int64)
    here = np.zeros(n, bool)
    here[start + (x - start) % width] = True
    return np.nonzero(here)[0]


def anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes of 48 bits with 16 bits of the context behind them, context hashes) of a document's anchors.

    The context of an anchor is every byte of the strings over its gram, cut at the document's ends; how it is cut is
    part of its hash."""
    side, found = length - gram, []
    for core in range(0, len(b), PART):  # an anchor depends on the strings over it only, so parts overlap by these
        lo, hi = max(0, core - length), min(len(b), core + PART + 2 * length)
        part = b[lo:hi]
        if len(part) < length:
            continue
        total, down = _prefix(part)
        p = _places(total, down, len(part), length, gram)
        p = p[(p + lo >= core) & (p + lo < core + PART)]
        s, e = np.maximum(p - side, 0), np.minimum(p + length, len(part))
        other, _ = _prefix(part, OTHER)
        cut = ((p - s) * (length + 1) + (e - p)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        g = scrambled((total[p + gram] - total[p]) * down[p])
        more = scrambled((total[e] - total[s]) * down[s] + cut) >> np.uint64(48)
        found.append((p + lo, (g & ~np.uint64(0xFFFF)) | more, scrambled((other[e] - other[s]) * down[s] + cut)))
    if not found:
        return np.array([], np.int64), np.array([], np.uint64), np.array([], np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any of the sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one; sorted by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shifted = end + (np.cumsum(_runs(doc)) - 1) * (1 << 33)  # so that the running maximum starts anew with each document
    reach = np.maximum.accumulate(shifted)
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] + (np.cumsum(_runs(doc)) - 1)[1:] * (1 << 33) > reach[:-1])
    at = np.nonzero(first)[0]
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], (reach - (np.cumsum(_runs(doc)) - 1) * (1 << 33))[last]


class _Combined:
    """Rows (g, c, document, pos) of one task, brought down to those of the first document for each (g, c) before they leave it; what
    the others cover leaves as merged spans. `reach`: what a row covers, relative to pos.

    Where a gram has `hot` contexts or more in here, its anchors leave as open ones, dealt by their document, and only a sign that
    they exist goes to the gram's task; so no task gets them all."""

    def __init__(self, own: bool, reach: tuple[int, int], held: int, hot: int | None):
        self.own, self.reach, self.held, self.hot = own, reach, held, hot
        self.parts, self.size = [], 0

    def add(self, g, c, doc: int, own: int, pos, n: int):
        self.parts.append((g, c, np.full(len(g), doc, np.int64), np.full(len(g), own, np.int64), pos, np.full(len(g), n, np.int64)))
        self.size += len(g)
        if self.size >= self.held:
            yield self.flush()

    def flush(self):
        g, c, doc, own, pos, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((own, c, g))
        g, c, doc, own, pos, n = (x[order] for x in (g, c, doc, own, pos, n))
        new = _runs(g, c)
        first = own[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        later, kind = own > first, pos.astype(np.int64)
        rows = [(g.view(np.int64)[~later], c.view(np.int64)[~later], doc[~later], own[~later], kind[~later])]
        if self.hot is not None:
            gram = g >> np.uint64(16)
            run = np.cumsum(_runs(gram)) - 1
            many = (np.bincount(run, weights=new) >= self.hot)[run]
            if many.any():
                untold, gone = many & ~later, np.unique(gram[many]) << np.uint64(16)
                none = np.full(len(gone), _LEAST)
                told = ~many & ~later
                rows = [
                    (g.view(np.int64)[told], c.view(np.int64)[told], doc[told], own[told], kind[told]),
                    (g.view(np.int64)[untold], kind[untold], doc[untold], own[untold], np.full(int(untold.sum()), UNTOLD)),
                    (gone.view(np.int64), none, none, none, np.full(len(gone), SIGN)),
                ]
        if later.any():
            d, s, e = _merged(doc[later], np.maximum(pos[later] + self.reach[0], 0), np.minimum(pos[later] + self.reach[1], n[later]))
            rows.append((np.zeros(len(d), np.int64), (s << 32) | (e - s), d, np.full(len(d), _LEAST), np.full(len(d), SPAN)))
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
        names = ("g", "c", "doc", "own", "pos")
        return batch_of({k: (v, pa.int64()) for k, v in zip(names, cols, strict=True) if k != "own" or self.own})


def _columns(own: bool) -> dict[str, str]:
    return {"g": "long", "c": "long", "doc": "long"} | ({"own": "long"} if own else {}) | {"pos": "long"}


def _bodies(batch, *more: str):
    """The rows (document's key, its place among documents, text, more) of a batch."""
    own = "own" if "own" in batch.schema.names else "doc"
    return zip(*(batch[x].to_pylist() for x in ("doc", own, "text", *more)), strict=True)


def _anchor_rows(length: int, gram: int, own: bool, held: int, hot: int):
    def run(batches):
        rows = _Combined(own, (gram - length, length), held, hot)
        for batch in batches:
            for doc, place, text in _bodies(batch):
                if text and len(text) >= length:
                    pos, g, c = anchors(np.frombuffer(text, np.uint8), length, gram)
                    yield from rows.add(g, c, doc, place, pos, len(text))
        if rows.parts:
            yield rows.flush()

    return run


def _marks(doc, a, b, g=None) -> pa.RecordBatch:
    g = pa.nulls(len(doc), pa.int64()) if g is None else g
    return batch_of({"doc": (doc, pa.int64()), "a": (a.astype(np.int32), pa.int32()), "b": (b.astype(np.int32), pa.int32()), "g": (g, pa.int64())})


def _resolved(whole: int, some: int | None):
    """Of rows sorted by g, c and document: a mark `whole` for those with the same g and c in an earlier document; and
    `some` for the first document's rows of each c, if their gram has several. Rows stream by: of a run of one gram that
    goes on in the next batch, only the first document's rows are held back until a second c comes."""

    def run(batches):
        last_g = last_c = last_gram = first_own = None
        several, waiting = False, []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, doc, pos = (batch[x].to_numpy() for x in ("g", "c", "doc", "pos"))
            own = batch["own"].to_numpy() if "own" in batch.schema.names else doc
            if (known := pos <= SPAN).any():
                span, untold = pos == SPAN, pos == UNTOLD
                yield _marks(doc[span], c[span] >> 32, c[span] & _LOW)
                yield _marks(doc[untold], c[untold], np.full(int(untold.sum()), OPEN), g[untold] >> 16)
                g, c, doc, own, pos = (x[~known] for x in (g, c, doc, own, pos))
                if not len(g):
                    continue
            gram = g >> 16
            new_gram, new = _runs(gram), _runs(g, c)
            goes_on = last_gram is not None and gram[0] == last_gram
            if goes_on:
                new_gram[0], new[0] = False, (g[0], c[0]) != (last_g, last_c)
            at = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            first = np.where(at >= 0, own[np.maximum(at, 0)], first_own if first_own is not None else 0)
            later = own > first
            if later.any():
                yield _marks(doc[later], pos[later], np.full(int(later.sum()), whole))
            if some is not None:
                run_of = np.cumsum(new_gram)
                run_of -= run_of[0]
                many = np.bincount(run_of, weights=new & ~new_gram) > 0  # changes of c inside each run
                if goes_on:
                    many[0] |= several
                if goes_on and many[0]:
                    yield from waiting
                if not goes_on or many[0] or run_of[-1]:
                    waiting = []
                real = ~later & (pos >= 0)
                stay = real & many[run_of]
                if stay.any():
                    yield _marks(doc[stay], pos[stay], np.full(int(stay.sum()), some), gram[stay])
                several = bool(many[-1])
                if not several:
                    keep = real & (run_of == run_of[-1])
                    waiting.append(_marks(doc[keep], pos[keep], np.full(int(keep.sum()), some), gram[keep]))
            last_g, last_c, last_gram, first_own = g[-1], c[-1], gram[-1], first[-1]

    return run


def _context_rows(length: int, gram: int, own: bool):
    """The contexts of the open anchors of each document: rows (g, doc, pos and bytes behind it, the bytes, padded)."""
    side = length - gram

    def run(batches):
        for batch in batches:
            parts, contexts = [], []
            for doc, place, text, at, g in _bodies(batch, "at", "g"):
                pos = np.frombuffer(at, np.int32).astype(np.int64)
                pos, chosen = np.unique(pos, return_index=True)
                for k in range(0, len(pos), 1 << 14):
                    p = pos[k : k + (1 << 14)]
                    lo, hi = max(0, int(p[0]) - side), int(p[-1]) + length
                    left, piece = int(p[0]) - side - lo, text[lo:hi]
                    padded = np.frombuffer(bytes(-left) + piece + bytes(hi - lo - len(piece)), np.uint8)
                    contexts += np.ascontiguousarray(padded[(p - p[0])[:, None] + np.arange(side + length)]).view(f"S{side + length}").ravel().tolist()
                    parts.append((np.frombuffer(g, np.int64)[chosen][k : k + (1 << 14)], np.full(len(p), doc, np.int64), np.full(len(p), place, np.int64), p << 32 | np.minimum(length, len(text) - p)))
            if parts:
                g, doc, place, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield batch_of({"g": (g, pa.int64()), "doc": (doc, pa.int64())} | ({"own": (place, pa.int64())} if own else {}) | {"pos": (pos, pa.int64()), "context": (contexts, pa.binary())})

    return run


def _string_hashes(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string in each of the rows of bytes."""
    wide = b.shape[1]
    up, down = _Base.of(wide + 1)
    hashes = []
    for values in (VALUE, OTHER):
        total = np.zeros((len(b), wide + 1), np.uint64)
        np.cumsum(values[b] * up[:wide], axis=1, out=total[:, 1:])
        hashes.append(scrambled((total[:, length:] - total[:, : wide - length + 1]) * down[: wide - length + 1]))
    return hashes[0], hashes[1]


def _compared(length: int, gram: int, rows: int = 8192):
    """Of contexts sorted by gram and document: a span for each string in them that an earlier document's context of the gram has too."""
    side = length - gram
    wide = side + length

    def told(g, doc, own, pos, contexts):
        b = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in contexts), np.uint8).reshape(-1, wide)
        behind, p = pos & _LOW, pos >> 32
        hashes = _string_hashes(b, length)
        start = p[:, None] - side + np.arange(side + 1)
        valid = (start >= 0) & (start + length <= (p + behind)[:, None])
        h, k, start = hashes[0][valid], hashes[1][valid], start[valid]
        row = np.repeat(np.arange(len(b)), side + 1).reshape(valid.shape)[valid]
        place = own[row]
        order = np.lexsort((place, k, h))
        new = _runs(h[order], k[order])
        first = place[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = order[place[order] > first]
        d, s, e = _merged(doc[row[later]], start[later], start[later] + length)
        return _marks(d, s, e - s)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = "own" if "own" in batch.schema.names else "doc"
            part = [batch[x].to_numpy() for x in ("g", "doc", own, "pos")] + [batch["context"].to_numpy(zero_copy_only=False)]
            held.append(part)
            size += batch.num_rows
            if size >= rows:  # whole grams only; the last one may go on
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
                if cut:
                    yield told(*(x[:cut] for x in cols))
                held, size = [[x[cut:] for x in cols]], len(cols[0]) - cut
        if size:
            yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _window(length: int, gram: int) -> int:
    """How many neighbouring strings share a row until another document is known to have their common piece: about as many as such rows an anchor has."""
    return round((length - gram + 1) ** 0.5)


def _strings_in(b: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash, row, start) of the n strings that begin at `first` and behind it, whose bytes are the rows of b."""
    hashes = _string_hashes(b, length)
    valid = np.arange(hashes[0].shape[1]) < n[:, None]
    row, k = np.nonzero(valid)
    return hashes[0][valid], hashes[1][valid], row, first[row] + k


class _Windows:
    """Windows of neighbouring strings over open anchors in one task: (piece, document, first start, strings, bytes).

    The piece is what all strings of a full window share, so a string with a copy elsewhere has its piece there too. Where
    documents in here share a piece, the strings leave, combined, with a sign for the piece; else the window does, as one row."""

    def __init__(self, own: bool, length: int, held: int):
        self.own, self.length, self.held = own, length, held
        self.parts, self.size = [], 0

    def add(self, piece, doc: int, own: int, first, n, b, size: int):
        self.parts.append((piece, np.full(len(piece), doc, np.int64), np.full(len(piece), own, np.int64), first, n, b, np.full(len(piece), size, np.int64)))
        self.size += len(piece)
        if self.size >= self.held:
            yield from self.flush()

    def flush(self):
        piece, doc, own, first, n, b, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((own, piece))
        new = _runs(piece[order])
        run, least = np.cumsum(new) - 1, own[order][new]
        shared = np.zeros(len(piece), bool)
        shared[order] = (np.bincount(run, weights=own[order] != least[run]) > 0)[run]
        if shared.any():
            h, k, row, start = _strings_in(b[shared], first[shared], n[shared], self.length)
            once = np.unique(np.stack([doc[shared][row], start]), axis=1, return_index=True)[1]  # windows of several anchors overlap
            row = row[once]
            strings = _Combined(self.own, (0, self.length), self.held, None)
            strings.parts.append((h[once], k[once], doc[shared][row], own[shared][row], start[once], size[shared][row]))
            out = strings.flush()
            yield out.append_column("piece", pa.nulls(out.num_rows, pa.binary()))
        told = np.unique(piece[shared])
        none, alone = np.full(len(told), _LEAST), ~shared
        cols = [np.concatenate(x) for x in ((told.view(np.int64), piece[alone].view(np.int64)), (none, first[alone]), (none, doc[alone]), (none, own[alone]), (np.full(len(told), SIGN), np.full(int(alone.sum()), MAYBE)))]
        pieces = [None] * len(told) + [x[: self.length - 1 + m].tobytes() for x, m in zip(b[alone], n[alone].tolist(), strict=True)]
        names = ("g", "c", "doc", "own", "pos")
        yield batch_of({k: (v, pa.int64()) for k, v in zip(names, cols, strict=True) if k != "own" or self.own} | {"piece": (pieces, pa.binary())})


def _window_rows(length: int, gram: int, own: bool, held: int):
    """The strings over the open anchors of each document, in windows: see _Windows."""
    step, wide = _window(length, gram), length - gram + 1
    tail = length + step - 1

    def run(batches):
        rows = _Windows(own, length, max(1, held // step))
        for batch in batches:
            for doc, place, text, at in _bodies(batch, "at"):
                b, p = np.frombuffer(text, np.uint8), np.unique(np.frombuffer(at, np.int32)).astype(np.int64)
                near = np.arange(0, wide, step)  # a window's strings begin so many bytes before the anchor, and some more
                last, least = (p[:, None] - near).ravel(), (p[:, None] - np.minimum(near + step, wide) + 1).ravel()
                kind = np.tile(near, len(p)).astype(np.uint64)
                first, end = np.maximum(least, 0), np.minimum(last, len(b) - length)
                for core in range(0, len(b), PART):
                    mine = (first <= end) & (first >= core) & (first < core + PART)
                    if not mine.any():
                        continue
                    part = b[core : core + PART + tail]
                    total, down = _prefix(part)
                    x, y = last[mine] - core, least[mine] + length - core
                    piece = scrambled((total[y] - total[x]) * down[x] + kind[mine])
                    padded = np.append(part, np.zeros(tail, np.uint8))
                    yield from rows.add(piece, doc, place, first[mine], (end - first + 1)[mine], padded[(first[mine] - core)[:, None] + np.arange(tail)], len(b))
        if rows.parts:
            yield from rows.flush()

    return run


def _opened(length: int, gram: int):
    """Of windows and signs sorted by piece and document: the strings of the windows whose piece has a sign or is in several
    documents. Rows stream by: of a piece that goes on in the next batch, only one document's windows are held back."""
    tail = length + _window(length, gram) - 1

    def strings(doc, own, first, pieces, named):
        b = np.frombuffer(b"".join(x.ljust(tail, b"\0") for x in pieces), np.uint8).reshape(-1, tail)
        h, k, row, start = _strings_in(b, first, np.array([len(x) - length + 1 for x in pieces], np.int64), length)
        cols = {"g": h.view(np.int64), "c": k.view(np.int64), "doc": doc[row]} | ({"own": own[row]} if named else {}) | {"pos": start}
        return batch_of({x: (v, pa.int64()) for x, v in cols.items()})

    def run(batches):
        last = place = None
        several, waiting = False, []
        for batch in batches:
            if not batch.num_rows:
                continue
            named = "own" in batch.schema.names
            g, first, doc, pos = (batch[x].to_numpy() for x in ("g", "c", "doc", "pos"))
            own, pieces = batch["own"].to_numpy() if named else doc, batch["piece"].to_pylist()
            new = _runs(g)
            run_of, least = np.cumsum(new) - 1, own[new]
            goes_on = last is not None and g[0] == last
            if goes_on:
                least[0] = place
            many = np.bincount(run_of, weights=(own != least[run_of]) | (pos == SIGN)) > 0
            if goes_on:
                many[0] |= several
            if goes_on and many[0]:
                for part in waiting:
                    yield strings(*part, named)
            if not goes_on or many[0] or run_of[-1]:
                waiting = []
            several = bool(many[-1])
            for chosen, out in ((many[run_of], True), (run_of == (-1 if several else run_of[-1]), False)):
                at = np.nonzero(chosen & (pos == MAYBE))[0]
                if len(at):
                    part = doc[at], own[at], first[at], [pieces[i] for i in at.tolist()]
                    if out:
                        yield strings(*part, named)
                    else:
                        waiting.append(part)
            last, place = g[-1], least[-1]

    return run


def _packed(*kinds: str):
    """Sorted marks of a partition as one row a document: its key, and each column's values in order, as bytes."""

    def run(batches):
        doc, parts = None, []

        def row():
            return doc, *(b"".join(x) for x in zip(*parts, strict=True))

        def out(rows):
            return batch_of({k: (v, pa.binary() if k != "doc" else pa.int64()) for k, v in zip(("doc", *kinds), zip(*rows, strict=True), strict=True)})

        for batch in batches:
            if not batch.num_rows:
                continue
            docs, values = batch["doc"].to_numpy(), [batch[k].to_numpy() for k in kinds]
            edges, ready = np.nonzero(_runs(docs))[0].tolist() + [len(docs)], []
            for s, e in zip(edges, edges[1:], strict=False):
                if docs[s] != doc and parts:
                    ready.append(row())
                    parts = []
                doc = int(docs[s])
                parts.append([x[s:e].tobytes() for x in values])
            if ready:
                yield out(ready)
        if parts:
            yield out([row()])

    return run


def _finish(length: int, gram: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, a, b in zip(*(batch[x].to_pylist() for x in ("doc_id", "text", "a", "b")), strict=True):
                raw = text or b""
                if not a:
                    out.append((doc, len(raw), 0, 0, raw))
                    continue
                a, b = (np.frombuffer(x, np.int32).astype(np.int64) for x in (a, b))
                start = np.where(b == COVERED, np.maximum(a - (length - gram), 0), a)
                end = np.where(b == COVERED, np.minimum(a + length, len(raw)), a + b)
                _, s, e = _merged(np.zeros(len(start), np.int64), start, end)
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                out.append((doc, len(raw), int((e - s).sum()), len(s), b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield batch_of({"doc_id": (cols[0], pa.int64()), "n_bytes": (cols[1], pa.int64()), "n_removed": (cols[2], pa.int64()), "n_spans": (cols[3], pa.int64()), "kept_sha256": ([hashlib.sha256(k).hexdigest() for k in cols[4]], pa.string()), "kept": (cols[4], pa.binary())})

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(doc_id, doc, text), and own, if needed: doc is a key that differs for every row, own the document's place among documents.

    The key is doc_id itself and its own place, unless some are null or repeated. Then rows are numbered and written, so that numbers
    hold, and the place is doc_id, with null as the least number.
    """
    own = F.col(doc_id).cast("long")
    body = docs.select(own.alias("doc_id"), own.alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
    if body.groupBy("doc").count().where("doc is null or count > 1").isEmpty():
        return body
    numbered = body.withColumns({"doc": F.monotonically_increasing_id(), "own": F.coalesce("doc_id", F.lit(_LEAST))})
    return scratch.write(numbered, "keyed")


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 28, doc_id: str = "doc_id", text: str = "text", held: int = 400_000, hot: int = 64, group: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): the documents without repeated bytes.

    A byte of the UTF-8 text goes if a string of `length` bytes over it also starts in a document with a smaller doc_id.
    Null and empty texts have no bytes; null doc_ids come first, as the least long; documents of one doc_id, which may be
    repeated, do not count as earlier than each other. Other columns are ignored. An empty table gives no rows. kept holds the
    remaining bytes, which need not be valid UTF-8.

    held: rows that a task gathers before it combines them. hot: from so many contexts of a gram in these on, they are not dealt by
    gram. group: grams with more open contexts are compared string by string, dealt by the string, not by gram; strings of which no other
    document has the piece that they share with their neighbours are left out before. None changes the result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    body = _keyed(docs, doc_id, text, scratch)
    own = "own" in body.columns
    place = "own" if own else "doc"
    gram_of = F.when(F.col("pos") >= SIGN, F.shiftright("g", 16)).otherwise(F.xxhash64("doc", "c"))

    rows = body.drop("doc_id").mapInArrow(_anchor_rows(length, gram, own, held, hot), schema(**_columns(own)))
    marks = scratch.write(rows.repartition(gram_of).sortWithinPartitions("g", "c", place).mapInArrow(_resolved(COVERED, OPEN), MARKS), "marks")
    pending = marks.where(F.col("b") == OPEN).select("doc", F.col("a").alias("at"), "g")
    crowded = scratch.write(pending.groupBy("g").count().where(F.col("count") > group).select("g"), "crowded")
    many = not crowded.isEmpty()

    def opened(marked: DataFrame) -> DataFrame:
        per_doc = marked.repartition("doc").sortWithinPartitions("doc", "at").mapInArrow(_packed("at", "g"), schema(doc="long", at="binary", g="binary"))
        return body.drop("doc_id").join(per_doc.hint("shuffle_hash"), "doc")

    contexts = opened(pending.join(crowded, "g", "left_anti") if many else pending).mapInArrow(_context_rows(length, gram, own), schema(g="long", doc="long", **({"own": "long"} if own else {}), pos="long", context="binary"))
    found = scratch.write(contexts.repartition("g").sortWithinPartitions("g", place).mapInArrow(_compared(length, gram), MARKS), "compared")
    every = marks.where(F.col("b") != OPEN).unionByName(found)
    if many:
        windows = scratch.write(opened(pending.join(crowded, "g", "left_semi")).mapInArrow(_window_rows(length, gram, own, held // 2), schema(**_columns(own), piece="binary")), "windows")
        maybe = F.col("pos").isin(SIGN, MAYBE)
        shared = windows.where(maybe).repartition("g").sortWithinPartitions("g", place).mapInArrow(_opened(length, gram), schema(**_columns(own)))
        strings = windows.where(~maybe).drop("piece").unionByName(shared)
        dealt = F.when(F.col("pos") >= 0, F.col("g")).otherwise(F.xxhash64("doc", "c"))
        every = every.unionByName(scratch.write(strings.repartition(dealt).sortWithinPartitions("g", "c", place).mapInArrow(_resolved(length, None), MARKS), "strings"))
        scratch.drop("windows")
    scratch.drop("crowded")
    spans = every.repartition("doc").sortWithinPartitions("doc", "a").mapInArrow(_packed("a", "b"), schema(doc="long", a="binary", b="binary"))
    return body.join(spans.hint("shuffle_hash"), "doc", "left").mapInArrow(_finish(length, gram), schema(doc_id="long", n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string", kept="binary"))
