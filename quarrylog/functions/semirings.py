"""Annotation domains: what joining and merging tuples does to their annotations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """type: Spark type of an annotation; one: that of a fact; mul: of two columns; add: an aggregate of a column's annotations.

    idempotent: a + a = a, so that annotations settle in recursion.
    """

    name: str
    type: str
    zero: object
    one: object
    mul: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    idempotent: bool


def _either(p: Column) -> Column:
    """1 - product of (1 - p), by logarithms; certain if any is."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    apart = F.sum(F.when(q < 1.0, F.log1p(-q)).otherwise(F.lit(0.0)))
    return F.when(F.max(q) >= 1.0, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(apart))


def _latest(word: Column) -> Column:
    """The word with the highest id (low 48 bits); flags (bit 63) of equal ids are or-ed."""
    ident = word.bitwiseAND(F.lit((1 << 48) - 1))
    return F.max_by(word, F.struct(ident, word < 0, word))


BOOLEAN = Semiring("BooleanSR", "boolean", False, True, lambda a, b: a & b, F.bool_or, True)
BAG = Semiring("NaturalBag", "bigint", 0, 1, lambda a, b: a * b, F.sum, False)
PROBABILITY = Semiring("ProbIndep", "double", 0.0, 1.0, lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * b)), _either, False)
#: Words of 1 flag bit, 15 bits of scope and 48 of id, compared as unsigned: a set flag is above all without.
ENHANCED_ID = Semiring("EnhancedIDSR", "bigint", 0, -(1 << 63), lambda a, b: F.when((a < 0) != (b < 0), F.when(a < 0, a).otherwise(b)).otherwise(F.greatest(a, b)), _latest, True)

SEMIRINGS = {s.name: s for s in (BOOLEAN, BAG, PROBABILITY, ENHANCED_ID)} | {"Bag": BAG}


def semiring_of(name) -> Semiring | None:
    """None for relations without annotations."""
    if isinstance(name, Semiring):
        return name
    if name in ("", None, "NoProvenance"):
        return None
    if name not in SEMIRINGS:
        raise ValueError(f"no semiring {name}")
    return SEMIRINGS[name]
