"""Hashes of all words of a text, or of all its substrings of one length, by whole-array arithmetic.

A word's hash is the sum of a random value of each byte times a power of an odd base, modulo 2^64, scrambled at the end.
Equal words have equal hashes anywhere; words are bytes, so the text needs no decoding.
"""

from __future__ import annotations

import re

import numpy as np

_DRAW = np.random.default_rng(20240607)
#: A random value for each byte, and an odd base with its inverse modulo 2^64.
VALUE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_DRAW.integers(1 << 40, 1 << 62)) * 8 + 5
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in parts of about so many bytes.
PART = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


class _Table:
    """Powers of the base and of its inverse, made once a process."""

    up = down = None

    @classmethod
    def of(cls, n: int):
        if cls.up is None or len(cls.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            cls.up, cls.down = _powers(BASE, size), _powers(INVERSE, size)
        return cls.up, cls.down


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: Kinds of bytes: 0 separates, words are runs of one kind. Signs apart from letters and digits; bytes from 0x80 are letters.
SIGNS = np.array([1 if c >= 128 or chr(c).isalnum() else 0 if c <= 32 or c == 127 else 2 for c in range(256)], np.uint8)
#: Letters and digits only.
ALNUM = np.where(SIGNS == 1, SIGNS, 0).astype(np.uint8)
#: Whatever is between ASCII white space.
BLACK = np.array([0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256)], np.uint8)
UPPER = np.array([65 <= c <= 90 for c in range(256)])
DIGIT = np.array([48 <= c <= 57 for c in range(256)])
LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def parts_of(raw: bytes):
    """raw in parts of PART bytes and what is left of the word there: cut at ASCII white space only, so no word is cut."""
    at = 0
    while len(raw) - at > PART and (m := _SPACES.search(raw, at + PART)):
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:] if at else raw


def word_hashes(raw: bytes, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words, their places, the bytes) of one part."""
    b = np.frombuffer(raw, np.uint8)
    kind = kinds[b]
    starts = np.nonzero((kind != 0) & (kind != np.r_[np.uint8(0), kind[:-1]]))[0] if len(b) else np.array([], np.int64)
    if not len(starts):
        return np.array([], np.uint64), starts, b
    up, down = _Table.of(len(b))
    terms = VALUE[LOWERED[b]] * up[: len(b)]
    terms[kind == 0] = 0
    return scrambled(np.add.reduceat(terms, starts) * down[starts]), starts, b


def words_hashed(raw: bytes | None, kinds: np.ndarray = BLACK) -> np.ndarray:
    """The hashes of all lower-cased words of a text, in order."""
    found = [word_hashes(p, kinds)[0] for p in parts_of(raw or b"")]
    return found[0] if len(found) == 1 else np.concatenate(found)


def grams_hashed(b: np.ndarray, k: int) -> np.ndarray:
    """The hash of b[i : i + k] at every i; b is a uint8 array of at most some MB."""
    n = len(b) - k + 1
    if n <= 0:
        return np.array([], np.uint64)
    up, down = _Table.of(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUE[b] * up[: len(b)], out=total[1:])
    return scrambled((total[k:] - total[:n]) * down[:n])


def shingles_hashed(words: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words; of all words, if they are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    x = words[:n]
    for i in range(1, k):
        x = x * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
    return scrambled(x)
