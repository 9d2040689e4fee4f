"""Strata: one pass for those without recursion, and the semi-naive loop for the others.

The loop's state is tables in the shared folder. Each iteration is one job: the rules' variants over what changed last, for all
relations of the stratum together and tagged, without repetitions and without what is known, written and counted at
once. What is known is a list of such tables; every COMPACT iterations they become one.

Where much is known, LARGE tuples or more, it is not shuffled any more: the derived tuples are written first, and up to FEW of them,
of FEW_BYTES on disk, go to wherever the known ones are. So an iteration moves what it derives, not what earlier ones did.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semirings import Semiring
from ..language import Atom, Filter, Negation, Relation, Rule, Var, atom_of
from ..plans.compiler import Compiled, StratumPlan
from ..plans.ordering import Variant
from . import cells
from .body import PROV, Body, head_tuples, quoted, scan, types_of
from .tables import Tables

COMPACT = 8
LARGE, FEW, FEW_BYTES = 2_000_000, 500_000, 32 << 20


@dataclass
class Context:
    """What a hook is given: where the evaluation is, and the relations."""

    rule: Rule
    stratum: tuple[str, ...]
    iteration: int
    relation: Callable[[str], DataFrame]


class NotSettled(RuntimeError):
    """Annotations that may grow for ever met recursion without a limit on iterations."""


@dataclass
class Evaluation:
    compiled: Compiled
    tables: Tables
    semiring: Semiring | None
    kinds: Callable[[Relation], list[tuple[str, str]]]
    max_iterations: int = 0
    full: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    iterations: dict[tuple[str, ...], int] = field(default_factory=dict)
    changed: dict[str, DataFrame] = field(default_factory=dict)
    made: int = 0

    def name(self, what: str) -> str:
        self.made += 1
        return f"{self.made:04d}-{what[:60]}"

    def relation(self, name: str, changed: bool = False) -> DataFrame:
        if not name:
            return self.tables.spark.range(1).select(*([F.lit(self.semiring.one).cast(self.semiring.type).alias(PROV)] if self.semiring else [F.lit(1).alias("__unit")]))
        return self.changed[name] if changed else self.full[name]

    def body(self) -> Body:
        return Body(self.relation, self.semiring, lambda df: self.tables.write(df, self.name("split")))

    def merged(self, df: DataFrame, name: str) -> DataFrame:
        """A set again: without repetitions, or with their annotations added up."""
        if not self.semiring:
            return df.distinct()
        keys = [k for k, _ in self.kinds(self.compiled.relations[name])]
        return df.groupBy(*keys).agg(self.semiring.add(F.col(PROV)).alias(PROV))

    def run(self) -> None:
        uses = Counter(a.rel for r in self.compiled.rules for c in r.body if (a := atom_of(c)))
        for name, df in self.full.items():  # facts that a query makes, and that are read more than once, are made once
            if uses[name] > 1 and name not in self.given_nothing and _MADE.search(df._jdf.queryExecution().optimizedPlan().toString()):
                self.full[name] = self._stored(name)
        for plan in self.compiled.plans:
            self._once(plan, uses)
            if plan.recursive:
                self._loop(plan)

    def _heads(self, variants: list[Variant]) -> dict[str, DataFrame]:
        """What the variants derive, by relation; a body with several heads is written out once."""
        found: dict[str, list[DataFrame]] = {}
        for v in variants:
            valuations = self.body().evaluate(v)
            if len(v.rule.heads) > 1:
                valuations = self.tables.write(valuations if self.semiring else valuations.distinct(), self.name(v.rule.name))
            for head in v.rule.heads:
                rel = self.compiled.relations[head.rel]
                found.setdefault(head.rel, []).append(head_tuples(head, valuations, self.kinds(rel)))
        return {k: reduce(DataFrame.unionByName, v) for k, v in found.items()}

    def _hooks(self, variants: list[Variant], stratum: tuple[str, ...], iteration: int) -> None:
        for rule in {id(v.rule): v.rule for v in variants}.values():
            if callable(rule.hook):
                rule.hook(Context(rule, stratum, iteration, self.relation))

    def _once(self, plan: StratumPlan, uses: Counter) -> None:
        for v in plan.base:
            if v.rule.count:
                self.counts[v.rule.name] = self.body().count(v) if not self.semiring else self.body().evaluate(v).count()
        live = [v for v in plan.base if not v.rule.count]
        dealt = self._pairs(live)
        for name, new in (dealt or self._heads(live)).items():
            rows = new if dealt else self.merged(self.full[name].unionByName(new), name) if not self._empty_input(name) else self.merged(new, name)
            # what several rules read, or a loop, is computed once
            self.full[name] = self.tables.write(rows, self.name(name)) if uses[name] > 1 and not plan.recursive else rows
            self.raw.discard(name)
        self.iterations[plan.stratum.relations] = 1 if live else 0
        self._hooks(live, plan.stratum.relations, 0)

    def _pairs(self, live: list[Variant]) -> dict[str, DataFrame]:
        """What a relation's only rule derives, as a set, if it makes very many pairs."""
        if len(live) != 1 or self.semiring or not self._empty_input(live[0].rule.head.rel):
            return {}
        head = live[0].rule.head
        target = self.kinds(self.compiled.relations[head.rel])
        kinds = {t.name: kind for t, (_, kind) in zip(head.terms, target, strict=True) if isinstance(t, Var)}
        found = cells.pairs(live[0].rule, self.body(), lambda df, name: self.tables.write(df, self.name(name)), list(kinds.values()))
        return {head.rel: head_tuples(head, found, target)} if found is not None else {}

    def _empty_input(self, name: str) -> bool:
        return name in self.given_nothing

    given_nothing: set[str] = field(default_factory=set)
    #: How many tuples are known of each relation of the loop.
    known: dict[str, int] = field(default_factory=dict)
    #: Relations of facts that may be repeated.
    raw: set[str] = field(default_factory=set)

    def _packed(self, parts: dict[str, DataFrame], names: tuple[str, ...]) -> DataFrame:
        """Several relations as one table: __rel is the place in names; columns are shared by place and type."""
        wide: dict[str, str] = {}
        for n in names:
            wide |= {f"{c}_{_plain(k)}": k for c, k in self.kinds(self.compiled.relations[n])}
        prov = [PROV] if self.semiring else []
        out = []
        for k, n in enumerate(names):
            if n in parts:
                own = {f"{c}_{_plain(t)}": F.col(c) for c, t in self.kinds(self.compiled.relations[n])}
                out.append(parts[n].select(F.lit(k).alias("__rel"), *(own.get(w, F.lit(None)).cast(t).alias(w) for w, t in wide.items()), *prov))
        return reduce(DataFrame.union, out)

    def _unpacked(self, table: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
        prov = [PROV] if self.semiring else []
        return {n: table.where(F.col("__rel") == k).select(*(F.col(f"{c}_{_plain(t)}").alias(c) for c, t in self.kinds(self.compiled.relations[n])), *prov) for k, n in enumerate(names)}

    def _unknown(self, new: DataFrame, name: str) -> DataFrame:
        """The derived tuples that are new, or whose annotation is another one together with the known one."""
        keys = [k for k, _ in self.kinds(self.compiled.relations[name])]
        derived, known = self.merged(new, name), self.full[name]
        if self.known.get(name, 0) >= LARGE:
            derived, (size,) = self.tables.write_counted(derived.withColumn("__rel", F.lit(0)), self.name(f"derived-{name}"), 1)
            derived = derived.drop("__rel")
            if size <= FEW and self.tables.size(derived) <= FEW_BYTES:
                known = known.join(F.broadcast(derived.select(*keys)), keys, "left_semi")
        if not self.semiring:
            return derived.join(known, keys, "left_anti")
        known = known.withColumn("__old", F.col(PROV))
        both = derived.select(*keys, PROV, F.lit(None).cast(self.semiring.type).alias("__old")).unionByName(known)
        added = both.groupBy(*keys).agg(self.semiring.add(F.col(PROV)).alias(PROV), F.max("__old").alias("__old"), F.count(F.lit(1)).alias("__parts"), F.count("__old").alias("__held"))
        return added.where((F.col("__parts") > F.col("__held")) & ~F.col(PROV).eqNullSafe(F.col("__old"))).drop("__old", "__parts", "__held")

    def _loop(self, plan: StratumPlan) -> None:
        names = plan.stratum.relations
        if self.semiring and not self.semiring.idempotent and not self.max_iterations:
            raise NotSettled(f"{', '.join(names)}: recursion with {self.semiring.name} needs max_iterations")
        derived = tuple(sorted({h.rel for v in plan.recursive for h in v.rule.heads}))
        inputs = {a.rel for v in plan.recursive for c in v.rule.body if (a := atom_of(c)) and a.rel not in names}
        for name in inputs:
            self.full[name] = self._stored(name)
        start, sizes = self.tables.write_counted(self._packed({n: self.full[n].distinct() if n in self.raw else self.full[n] for n in names}, names), self.name("start"), len(names))
        self.known = dict(zip(names, sizes, strict=True))
        self.raw -= set(names)
        segments = {n: [df] for n, df in self._unpacked(start, names).items()}
        labels: dict[str, list[str]] = {n: [] for n in names}  # of the tables behind the segments that steps wrote
        written: set[str] = set()
        self.full |= {n: s[0] for n, s in segments.items()}
        self.changed |= self.full
        recursive = plan.recursive if self.semiring else self._needed(plan.recursive)
        alone = self._alone(plan.recursive, names)
        step = 0
        while not self.max_iterations or step < self.max_iterations:
            step += 1
            found = self._heads(recursive)
            new = self._packed(found if alone else {n: self._unknown(df, n) for n, df in found.items()}, derived)
            label = self.name(f"step{step}")
            table, sizes = self.tables.write_counted(new, label, len(derived))
            self._hooks(plan.recursive, names, step)
            if not any(sizes):
                self.tables.drop(label)
                break
            parts = self._unpacked(table, derived)
            written.add(label)
            for n in names:
                size = sizes[derived.index(n)] if n in derived else 0
                self.changed[n] = parts[n] if size else self.full[n].limit(0)
                if size:
                    self.known[n] += size  # of annotated tuples at most, as some are there before
                    segments[n].append(parts[n])
                    labels[n].append(label)
                    self.full[n] = self._together(n, segments[n])
                    if len(segments[n]) > (8 * COMPACT if alone else COMPACT):  # alone, the loop does not read them
                        place = self.name(n)
                        segments[n], labels[n] = [self.tables.write(self.full[n], place)], [place]
                        self.full[n] = segments[n][0]
                        written.add(place)
            for old in written - {label} - {x for own in labels.values() for x in own}:  # nothing reads these any more
                self.tables.drop(old)
                written.discard(old)
        self.iterations[names] = step
        self.changed.clear()

    def _alone(self, recursive: list[Variant], names: tuple[str, ...]) -> bool:
        """Whether no tuple can be derived twice, so that none needs to be looked up. Each rule takes (x, y) to (x, z) by a step from y to z, no
        relation is read by two, each x starts from one tuple, and from each y there is one step, which leads to a greater z: then
        there is one tuple of an x at a time, and its second value only grows. The data are asked for the last three."""
        read: list[str] = []
        steps: dict[tuple, DataFrame] = {}
        kinds = {tuple(k for _, k in self.kinds(self.compiled.relations[n])) for n in names}
        if self.semiring or kinds != {("bigint", "bigint")}:
            return False
        for v in recursive:
            body, head = v.rule.body, v.rule.head
            inside = [c for c in v.rule.atoms if c.rel in names]
            outside = [c for c in v.rule.atoms if c.rel not in names]
            if len(v.rule.heads) > 1 or len(inside) != 1 or len(outside) != 1 or not all(isinstance(c, Atom | Filter | Negation) for c in body):
                return False
            ends = [[t.name for t in c.terms if isinstance(t, Var)] for c in (head, inside[0])]
            if [len({*e}) for e in ends] != [2, 2] or len({*ends[0], *ends[1]}) != 3 or ends[0][0] != ends[1][0] or ends[0][0] in outside[0].variables:
                return False
            y, z = ends[1][1], ends[0][1]
            if not {y, z} <= set(outside[0].variables):
                return False
            read.append(inside[0].rel)
            taken = scan(outside[0], self.full[outside[0].rel], {y, z})
            if set(types_of(taken).values()) != {"bigint"}:
                return False
            steps[outside[0].rel, tuple(t.name if isinstance(t, Var) and t.name in (y, z) else repr(t) for t in outside[0].terms)] = taken.select(quoted(y).alias("y"), quoted(z).alias("z"))
        if len(set(read)) < len(read):
            return False
        once = lambda df, c: df.groupBy(c).count().where("count > 1").isEmpty()
        start = reduce(DataFrame.unionByName, (self.full[n].select("c0") for n in names))
        return once(start, "c0") and all(step.where("NOT coalesce(z > y, false)").isEmpty() and once(step, "y") for step in steps.values())

    @staticmethod
    def _needed(recursive: list[Variant]) -> list[Variant]:
        """Where a relation's only recursive rule composes it with itself, what changed last is composed with all that is known, on one
        side only: tuples of up to n steps being known, one of n + 1 to 2n steps begins with one of just n, which changed last."""
        rule = recursive[0].rule if recursive else None
        if rule and len(recursive) == 2 and recursive[1].rule is rule and len(rule.heads) == 1 and len(rule.body) == 2:
            head, first, second = rule.head, *rule.atoms
            terms = [t.name for a in (head, first, second) for t in a.terms if isinstance(t, Var)]
            if len(terms) == 6 and {head.rel, first.rel, second.rel} == {head.rel} and len({*terms}) == 3 and [terms[0], terms[3], terms[1]] == [terms[2], terms[4], terms[5]]:
                return [v for v in recursive if v.delta == 0]
        return recursive

    def _together(self, name: str, parts: list[DataFrame]) -> DataFrame:
        """One set of several parts; of a tuple's annotations that of the last part counts."""
        every = parts[0]
        keys = [k for k, _ in self.kinds(self.compiled.relations[name])]
        for part in parts[1:]:
            every = (every.join(part, keys, "left_anti") if self.semiring else every).unionByName(part)
        return every

    def _stored(self, name: str) -> DataFrame:
        """An input of a loop, computed once and kept as a table."""
        df = self.full[name]
        if name in self.settled:
            return df
        self.settled.add(name)
        if name in self.raw:
            self.raw.discard(name)
            df = df.distinct()
        return self.tables.write(df, self.name(name))

    settled: set[str] = field(default_factory=set)


#: What a plan has that does more than read and choose.
_MADE = re.compile(r"\b(Join|Aggregate|Window|Generate|MapInArrow|MapInPandas|Sort)\b")


def _plain(kind: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in kind)
