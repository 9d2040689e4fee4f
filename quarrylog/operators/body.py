"""A rule body as a DataFrame plan: its columns are the rule's variables.

A relation is a DataFrame of columns c0, c1, ... that holds a set; a relation with annotations has the column __prov too.
Constants and repeated variables become conditions on the scan, so they are pushed down to the source. After each step only
the variables that something later needs are kept. An atom that only tests what is bound is a left-semi join.

Cyclic bodies are evaluated variable by variable, not atom by atom: each valuation so far takes the next variable's values from
that of the atoms which has the fewest for it, and the other atoms test them. So what is made on the way never exceeds what the
smallest atom allows for each valuation, whatever the skew. Rules that are only counted carry a number of valuations instead of variables
that nothing later needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column_of, condition_of
from ..functions.semirings import Semiring
from ..language import Agg, Atom, Const, Filter, Let, Negation, Rule, Split, Var
from ..plans.ordering import Variant, group_vars, needs

PROV = "__prov"
#: Where a plan asks for balance, values with more than HEAVY tuples are dealt to SALTS parts.
HEAVY, SALTS = 100_000, 32
#: How many valuations a row stands for, in rules that are only counted.
NUMBER = "__n"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def types_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def literal(value) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def scan(atom: Atom, df: DataFrame, keep: set[str] | None = None) -> DataFrame:
    """The atom's matching tuples, its variables as columns; of wildcards and others only those in keep, if it is given."""
    first: dict[str, str] = {}
    conditions = []
    for k, t in enumerate(atom.terms):
        if isinstance(t, Const):
            conditions.append(F.col(f"c{k}") == literal(t.value))
        elif isinstance(t, Var):
            if t.name in first:
                conditions.append(F.col(f"c{k}") == F.col(first[t.name]))
            else:
                first[t.name] = f"c{k}"
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    chosen = [F.col(c).alias(v) for v, c in first.items() if keep is None or v in keep]
    return df.select(*chosen, *([PROV] if PROV in df.columns else []))


class Body:
    """Evaluates variants of a rule. `relation(name, changed)` gives a relation, or what changed of it last."""

    def __init__(self, relation: Callable[[str, bool], DataFrame], semiring: Semiring | None = None, cut: Callable[[DataFrame], DataFrame] | None = None):
        self.relation, self.semiring, self.cut = relation, semiring, cut or (lambda df: df)

    def _later(self, variant: Variant, at: int, done: set[int]) -> set[str]:
        """The variables that the heads or any clause after place `at` of the order need, but for those evaluated already."""
        rule = variant.rule
        need = set() if rule.count else {t.name for h in rule.heads for t in h.terms if isinstance(t, Var)}
        for k in variant.order[at + 1 :]:
            if k not in done:
                c = rule.body[k]
                need |= set(c.variables) if isinstance(c, Atom) else needs(rule, c) if not isinstance(c, Split) else set()
        return need

    def _closing(self, variant: Variant, at: int, bound: set[str], done: set[int]) -> list[int]:
        """The later atoms, up to a split, that together with the atom at this place bound one fresh variable: a cycle closes."""
        body = variant.rule.body
        fresh = [v for v in body[variant.order[at]].variables if v not in bound]
        if len(fresh) != 1 or len(body[variant.order[at]].variables) < 2:
            return []
        found = []
        for k in variant.order[at + 1 :]:
            if isinstance(body[k], Split):
                break
            own = set(body[k].variables) if isinstance(body[k], Atom) and k not in done else set()
            if fresh[0] in own and len(own) > 1 and own <= bound | set(fresh):
                found.append(k)
        return found

    def evaluate(self, variant: Variant) -> DataFrame:
        """The valuations that satisfy the body. Without annotations, they may be repeated, and only variables of heads stay; of rules
        that are only counted, none, but the column __n says how many valuations a row stands for, if there is one."""
        rule, done = variant.rule, set()
        exact, counting = self.semiring is not None, rule.count and self.semiring is None
        now: DataFrame | None = None
        for at, k in enumerate(variant.order):
            if k in done:
                continue
            clause = rule.body[k]
            if isinstance(clause, Atom):
                closing = self._closing(variant, at, set(now.columns), done) if now is not None and not exact else []
                if closing:
                    done |= set(closing)
                    now = self._extend(now, [(rule.body[j], j == variant.delta) for j in (k, *closing)])
                else:
                    now = self._join(now, clause, k == variant.delta, self._later(variant, at, done), exact, counting, bool(variant.plan and (variant.plan.balanced_root or variant.plan.balanced_sources)))
            elif isinstance(clause, Filter):
                now = self._of(now).where(condition_of(clause.code, types_of(self._of(now)), clause.vars))
            elif isinstance(clause, Let):
                now = self._of(now)
                value = column_of(clause.code, types_of(now), clause.deps)
                now = now.where(quoted(clause.var) == value) if clause.var in now.columns else now.withColumn(clause.var, value)
            elif isinstance(clause, Negation):
                now = self._without(self._of(now), clause.atom, rule)
            elif isinstance(clause, Agg):
                now = self._aggregate(now, clause, rule)
            elif isinstance(clause, Split):
                later = self._later(variant, at, done)
                now = self.cut(now if exact or counting else now.select(*(quoted(c) for c in now.columns if c in later)).distinct())
            if now is not None and not exact:
                later = self._later(variant, at, done)
                kept = [c for c in now.columns if c in later or c == NUMBER]
                if len(kept) < len(now.columns) and (kept or not counting):
                    now = now.select(*map(quoted, kept))
                    if counting and set(kept) - {NUMBER} == self._next_key(variant, at, set(kept), done) != set():
                        now = self._summed(now)  # in the partitioning that the next join needs
                if not counting and self._early_distinct(variant, at) and kept:
                    now = now.distinct()
        return now

    def count(self, variant: Variant) -> int:
        """The number of valuations of a rule that is only counted."""
        found = self.evaluate(variant)
        return found.agg(F.sum(NUMBER)).first()[0] or 0 if NUMBER in found.columns else found.count()

    def _next_key(self, variant: Variant, at: int, bound: set[str], done: set[int]) -> set[str]:
        """The variables on which the next atom is joined."""
        after = next((variant.rule.body[k] for k in variant.order[at + 1 :] if k not in done and isinstance(variant.rule.body[k], Atom)), None)
        return set(after.variables) & bound if after else set()

    @staticmethod
    def _summed(now: DataFrame) -> DataFrame:
        keys = [quoted(c) for c in now.columns if c != NUMBER]
        return now.groupBy(*keys).agg((F.sum(NUMBER) if NUMBER in now.columns else F.count(F.lit(1))).alias(NUMBER))

    def _extend(self, now: DataFrame, atoms: list[tuple[Atom, bool]]) -> DataFrame:
        """Valuations with one more variable, which several atoms bound. Each takes its values from the atom that has the fewest for it;
        all proposals are one join, on the place of the atom and the values of its bound variables."""
        bound = set(now.columns)
        (fresh,) = [v for v in atoms[0][0].variables if v not in bound]
        sources = [scan(a, self.relation(a.rel, changed)) for a, changed in atoms]
        shared = [[v for v in a.variables if v != fresh] for a, _ in atoms]
        columns = now.columns
        for k, (source, keys) in enumerate(zip(sources, shared, strict=True)):
            now = now.join(source.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(f"__d{k}")), keys)
        degrees = [F.col(f"__d{k}") for k in range(len(sources))]
        least = F.least(*degrees)
        chosen, key = F.lit(len(sources) - 1), self._key(sources[-1], shared[-1])
        for k in reversed(range(len(sources) - 1)):
            chosen = F.when(degrees[k] == least, k).otherwise(chosen)
            key = F.when(degrees[k] == least, self._key(sources[k], shared[k])).otherwise(key)
        offers = [s.select(F.lit(k).alias("__of"), self._key(s, keys).alias("__key"), quoted(fresh)) for k, (s, keys) in enumerate(zip(sources, shared, strict=True))]
        offered = reduce(DataFrame.unionByName, offers)
        now = now.select(*map(quoted, columns), chosen.alias("__of"), key.alias("__key")).join(offered, ["__of", "__key"]).drop("__of", "__key")
        for source, keys in zip(sources, shared, strict=True):
            now = now.join(source, [*keys, fresh], "left_semi")
        return now

    @staticmethod
    def _key(source: DataFrame, keys: list[str]) -> Column:
        kinds = types_of(source)
        return F.array(*(quoted(v).cast(kinds[v]).cast("string") for v in keys))

    def _early_distinct(self, variant: Variant, at: int) -> bool:
        """dedup_hash: repeated valuations go before the last join."""
        left = [k for k in variant.order[at + 1 :] if isinstance(variant.rule.body[k], Atom)]
        return bool(variant.plan and variant.plan.dedup_hash and len(left) == 1 and isinstance(variant.rule.body[variant.order[at]], Atom))

    def _of(self, now: DataFrame | None) -> DataFrame:
        return now if now is not None else self.relation("", False)

    def _join(self, now: DataFrame | None, atom: Atom, changed: bool, later: set[str], exact: bool, counting: bool = False, balanced: bool = False) -> DataFrame:
        source = self.relation(atom.rel, changed)
        if now is None:
            if counting and (dropped := [v for v in atom.variables if v not in later]) and len(dropped) < len(atom.variables):
                return self._summed(scan(atom, source).select(*(quoted(v) for v in atom.variables if v in later)))
            return scan(atom, source, None if exact or counting else later)
        bound = set(now.columns) - {PROV, NUMBER}
        shared = [v for v in atom.variables if v in bound]
        fresh = [v for v in atom.variables if v not in bound]
        wanted = fresh if exact else [v for v in fresh if v in later]
        if counting and len(wanted) < len(fresh):
            right = scan(atom, source).groupBy(*map(quoted, [*shared, *wanted])).agg(F.count(F.lit(1)).alias("__more"))
            out = now.join(right, shared) if shared else now.crossJoin(F.broadcast(right) if not wanted else right)
            return out.withColumn(NUMBER, F.col("__more") * (F.col(NUMBER) if NUMBER in now.columns else 1)).drop("__more")
        right = scan(atom, source, {*shared, *wanted})
        if PROV in right.columns:
            right = right.withColumnRenamed(PROV, "__right")
        elif not wanted:
            test = right.select(*map(quoted, shared)) if shared else right.select(F.lit(True).alias("__some")).limit(1)
            return now.join(test, shared, "left_semi") if shared else now.join(F.broadcast(test), how="left_semi", on=F.lit(True))
        if balanced and shared:
            now, right, shared = self._balanced(now, right, shared)
        out = (now.join(right, shared) if shared else now.crossJoin(right)).drop("__salt")
        if "__right" in out.columns:
            value = self.semiring.mul(F.col(PROV), F.col("__right")) if PROV in now.columns else F.col("__right")
            out = out.withColumn(PROV, value).drop("__right")
        return out

    @staticmethod
    def _balanced(now: DataFrame, right: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with a salt to join on as well: tuples of values that have very many are dealt to parts, and the valuations of such
        values go to every part; all others are in part 0. The result is the same."""
        keys = [quoted(c) for c in shared]
        heavy = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__many")).where(F.col("__many") > HEAVY).withColumn("__many", F.lit(True))
        parts = F.when(F.col("__many"), SALTS).otherwise(1)
        left = now.join(heavy, shared, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__many")
        dealt = F.when(F.col("__many"), F.pmod(F.xxhash64(*(quoted(c) for c in right.columns)), F.lit(SALTS)).cast("int")).otherwise(0)
        return left, right.join(heavy, shared, "left").withColumn("__salt", dealt).drop("__many"), [*shared, "__salt"]

    def _without(self, now: DataFrame, atom: Atom, rule: Rule) -> DataFrame:
        bound = set(now.columns) - {PROV, NUMBER}
        tested = [v for v in atom.variables if v in bound]
        right = scan(atom, self.relation(atom.rel, False), set(tested)).drop(PROV)
        if tested:
            return now.join(right.distinct() if len(tested) < atom.relation.arity else right, tested, "left_anti")
        return now.join(F.broadcast(right.select(F.lit(True).alias("__some")).limit(1)), how="left_anti", on=F.lit(True))

    def _aggregate(self, now: DataFrame | None, clause: Agg, rule: Rule) -> DataFrame:
        """Of the distinct tuples that match. count, sum and exists of none are 0, 0 and false; other aggregates of none have no row."""
        groups = group_vars(rule, clause)
        free = [v for v in clause.atom.variables if v not in groups]
        tuples = scan(clause.atom, self.relation(clause.atom.rel, False)).drop(PROV)
        value = quoted((free or groups)[-1]) if free or groups else F.lit(1)
        made = {"count": lambda: F.count(F.lit(1)), "exists": lambda: F.count(F.lit(1)) > 0, "sum": lambda: F.sum(value), "min": lambda: F.min(value), "max": lambda: F.max(value)}
        result = (clause.custom(value) if clause.custom else made[clause.func]()).alias(clause.result)
        empty = {"count": F.lit(0).cast("long"), "sum": F.lit(0), "exists": F.lit(False)}.get(clause.func) if not clause.custom else None
        found = tuples.groupBy(*map(quoted, groups)).agg(result)
        if not groups:
            found = found.select(F.coalesce(quoted(clause.result), empty).alias(clause.result)) if empty is not None else found.where(quoted(clause.result).isNotNull())
            return found if now is None else now.crossJoin(F.broadcast(found))
        if now is None:
            return found
        joined = now.join(found, groups, "left" if empty is not None else "inner")
        return joined.withColumn(clause.result, F.coalesce(quoted(clause.result), empty)) if empty is not None else joined


def head_tuples(head: Atom, body: DataFrame, target: list[tuple[str, str]]) -> DataFrame:
    """The head's columns c0, ... from valuations, as the relation's types; with __prov, if the body has it."""
    columns = []
    for k, (t, (_, kind)) in enumerate(zip(head.terms, target, strict=True)):
        value = quoted(t.name) if isinstance(t, Var) else literal(t.value)
        columns.append(value.cast(kind).alias(f"c{k}"))
    return body.select(*columns, *([PROV] if PROV in body.columns else []))

