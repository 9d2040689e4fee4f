"""Rules for pairs, in cells.

Where the two variables of a head meet only over what both halves of the body share, very many pairs may come from few tuples: suppliers of
one nation, ties over a hub, a product. Each half is made once, without repetitions, and the valuations are counted from the halves'
degrees. If they are many, tuples are dealt to a grid, the left half by its variable to rows and the right half to columns, so that a cell
has some PAIRS valuations however skewed the shared values are. A pair belongs to one cell, which joins, tests and deduplicates it:
what is moved are the halves, as often as the grid has columns or rows, and never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import condition_of
from ..language import Atom, Filter, Negation, Relation, Rule, Var
from ..plans.ordering import Variant, clause_order, needs
from .body import Body, quoted, scan, types_of

#: Valuations in a cell, cells at most (beyond that they get larger), and the bytes up to which a half's relations are counted before.
PAIRS, CELLS, COUNTED_BYTES = 4_000_000, 20_000, 256 << 20


@dataclass(frozen=True)
class Halves:
    """A rule as two rules with the shared variables in their heads, and what tests a pair."""

    left: Rule
    right: Rule
    ends: tuple[str, str]
    shared: tuple[str, ...]
    filters: tuple[Filter, ...]
    without: tuple[Negation, ...]


def halves(rule: Rule) -> Halves | None:
    """The halves of a rule that has such, none if a clause needs more than one half and the pair."""
    ends = tuple(dict.fromkeys(t.name for h in rule.heads for t in h.terms if isinstance(t, Var)))
    if len(ends) != 2 or len(rule.heads) > 1 or rule.count or rule.plans or not all(isinstance(c, Atom | Filter | Negation) for c in rule.body):
        return None
    own = [[c for c in rule.atoms if end in c.variables] for end in ends]
    bound = [{v for c in half for v in c.variables} for half in own]
    shared = bound[0] & bound[1]
    between = [c for c in rule.atoms if not set(ends) & set(c.variables)]
    if not all(own) or shared & set(ends) or not all(set(c.variables) <= shared for c in between):
        return None
    sides: list[list] = [[*half, *between] for half in own]
    filters, without = [], []
    for c in rule.body:
        if isinstance(c, Atom):
            continue
        need = needs(rule, c)
        side = next((k for k in (0, 1) if need <= bound[k]), None)
        if side is not None:
            sides[side].append(c)
        elif need <= set(ends):
            (filters if isinstance(c, Filter) else without).append(c)
        else:
            return None
    names = tuple(sorted(shared))
    made = [replace(rule, heads=(Relation(f"{rule.name}_{k}", 1 + len(names))(Var(ends[k]), *map(Var, names)),), body=tuple(sides[k])) for k in (0, 1)]
    return Halves(*made, ends, names, tuple(filters), tuple(without))


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pairs(rule: Rule, body: Body, keep: Callable[[DataFrame, str], DataFrame], kinds: list[str]) -> DataFrame | None:
    """The pairs of a rule, each once, if it has halves with many valuations. keep writes a half down."""
    split = halves(rule)
    if not split or any(_bytes(body.relation(c.rel, False)) > COUNTED_BYTES for c in rule.atoms):
        return None
    made = [body.evaluate(Variant(r, -1, clause_order(r))).select(quoted(end), *map(quoted, split.shared)).distinct() for r, end in zip((split.left, split.right), split.ends, strict=True)]
    types = [types_of(m)[end] for m, end in zip(made, split.ends, strict=True)]
    tested = [scan(c.atom, body.relation(c.atom.rel, False), set(split.ends)) for c in split.without]
    whole = {"bigint", "int", "smallint", "tinyint", "string", "boolean", "date"}  # of one value, equal ones have one hash
    if set(types) - whole or any([types_of(t)[end] for end in split.ends] != types for t in tested) or kinds != types:
        return None
    left, right = (keep(m, f"{rule.name}-{k}") for k, m in enumerate(made))
    sizes, number = [left.count(), right.count()], 0
    if split.shared:
        degrees = [half.groupBy(*map(quoted, split.shared)).agg(F.count(F.lit(1)).alias(f"__d{k}")) for k, half in enumerate((left, right))]
        number = degrees[0].join(degrees[1], list(split.shared)).agg(F.sum(F.col("__d0").cast("double") * F.col("__d1"))).first()[0] or 0
    else:
        number = sizes[0] * sizes[1]
    if number <= 2 * PAIRS:
        return None
    once = not split.shared or any(half.select(quoted(end)).distinct().count() == size for half, end, size in zip((left, right), split.ends, sizes, strict=True))
    return _dealt(split, left, right, tested, sizes, math.ceil(number / PAIRS), once)


def _dealt(split: Halves, left: DataFrame, right: DataFrame, tested: list[DataFrame], sizes: list[int], cells: int, once: bool) -> DataFrame:
    """The pairs by cell. once: no pair has two valuations, as one end has one tuple each."""
    x, y = split.ends
    cells = min(cells, CELLS)
    rows = max(1, min(cells, round(math.sqrt(cells * sizes[0] / sizes[1]))))
    columns = math.ceil(cells / rows)
    cells = rows * columns
    row, column = F.pmod(F.xxhash64(quoted(x)), F.lit(rows)), F.pmod(F.xxhash64(quoted(y)), F.lit(columns))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    parts = max(cells, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fewer would be dealt anew
    place = lambda df: df.repartition(parts, "__cell")
    spread = min(cells, 200)
    left = left.repartition(spread, x).withColumn("__at", each(columns))
    for k, t in enumerate(tested):  # what a column of the grid has against a tuple goes with it, so pairs are not moved to be tested
        t = t.select(quoted(x), quoted(y)).dropna().join(right.select(quoted(y)), y, "left_semi")
        against = t.withColumn("__at", column.cast("long")).groupBy(quoted(x), "__at").agg(F.collect_set(quoted(y)).alias(f"__not{k}"))
        left = left.join(against, [x, "__at"], "left")
    left = place(left.withColumn("__cell", row * columns + F.col("__at")).drop("__at"))
    held = place(right.repartition(spread, y).withColumn("__at", each(rows)).withColumn("__cell", F.col("__at") * columns + column).drop("__at"))
    if not once:  # else Spark deals by the shared variables too, and moves the pairs to deduplicate them
        left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    now = left.join(held.hint("shuffle_hash"), ["__cell", *split.shared])
    for f in split.filters:
        now = now.where(condition_of(f.code, types_of(now), f.vars))
    for k in range(len(tested)):
        now = now.where(F.col(f"__not{k}").isNull() | quoted(y).isNull() | ~F.array_contains(F.col(f"__not{k}"), quoted(y)))
    now = now.select("__cell", quoted(x), quoted(y))
    return (now if once else now.distinct()).select(quoted(x), quoted(y))
