"""The engine: facts in, a program run, relations out."""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.semirings import Semiring, semiring_of
from .language import Agg, LanguageError, Program, Relation, atom_of
from .operators.body import PROV
from .operators.fixpoint import Evaluation
from .operators.tables import Tables
from .plans.compiler import Compiled, Pipeline, compile_program
from .sources.delimited import read_facts, redistribute, write_facts

_KINDS = {int: "bigint", float: "double", str: "string", bool: "boolean"}


def column_kinds(relation: Relation) -> list[tuple[str, str]]:
    return [(f"c{k}", t.simpleString() if isinstance(t, T.DataType) else _KINDS.get(t) or str(t)) for k, t in enumerate(relation.column_types)]


@dataclass
class Result:
    """What a run derived. Relations are DataFrames of c0, c1, ..., and __prov where annotations are asked for."""

    relations: dict[str, DataFrame]
    counts: dict[str, int]
    iterations: dict[tuple[str, ...], int]
    compiled: Compiled
    _sizes: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, name: str | Relation) -> DataFrame:
        return self.relations[name.name if isinstance(name, Relation) else name]

    def named(self, name: str, *columns: str) -> DataFrame:
        return self[name].toDF(*columns)

    def size(self, name: str) -> int:
        if name not in self._sizes:
            self._sizes[name] = self[name].count()
        return self._sizes[name]

    @property
    def sizes(self) -> dict[str, int]:
        """Of the relations declared with print_size."""
        return {r.name: self.size(r.name) for r in self.compiled.relations.values() if r.print_size}

    def contains(self, name: str, *values) -> bool:
        return not self.matching(name, *values).isEmpty()

    def matching(self, name: str, *prefix) -> DataFrame:
        """The tuples that begin with these values."""
        out = self[name]
        for k, v in enumerate(prefix):
            out = out.where(F.col(f"c{k}") == F.lit(v))
        return out

    def head(self, name: str, n: int = 10) -> list[tuple]:
        return [tuple(r) for r in self[name].limit(n).collect()]

    def show(self, name: str, n: int = 10) -> None:
        self[name].show(n, truncate=False)


class Engine:
    """Holds the facts of relations. Facts are bound to DataFrames, read from files, or given as rows; all are sets."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline | None = None):
        self.spark, self.pipeline = spark, pipeline or Pipeline()
        self.facts: dict[str, DataFrame] = {}
        self.relations: dict[str, Relation] = {}

    def _add(self, relation: Relation, df: DataFrame) -> Engine:
        self.relations[relation.name] = relation
        known = self.facts.get(relation.name)
        self.facts[relation.name] = df if known is None else known.unionByName(df, allowMissingColumns=True)
        return self

    def bind(self, relation: Relation, df: DataFrame, *columns: str | Column, annotation: str | Column | None = None) -> Engine:
        """The relation's facts are these columns of df, all by default, in order. annotation: of relations with a semiring."""
        chosen = [F.col(c) if isinstance(c, str) else c for c in columns or df.columns]
        if len(chosen) != relation.arity:
            raise LanguageError(f"{relation.name} has {relation.arity} columns, not {len(chosen)}")
        own = [c.cast(k).alias(n) for c, (n, k) in zip(chosen, column_kinds(relation), strict=True)]
        if annotation is not None:
            ring = semiring_of(relation.semiring)
            own.append((F.col(annotation) if isinstance(annotation, str) else annotation).cast(ring.type).alias(PROV))
        return self._add(relation, df.select(*own))

    def load(self, relation: Relation, path: str, delimiter: str | None = None) -> Engine:
        return self._add(relation, read_facts(self.spark, path, column_kinds(relation), delimiter))

    def load_parquet(self, relation: Relation, path: str, *columns: str) -> Engine:
        return self.bind(relation, self.spark.read.parquet(path), *columns)

    def load_all(self, program: Program, root: str) -> Engine:
        """The files named by the program's relations."""
        for r in program.relations:
            if r.input_file:
                self.load(r, f"{root.rstrip('/')}/{r.input_file}")
        return self

    def add_facts(self, relation: Relation, rows: Iterable[tuple]) -> Engine:
        schema = ", ".join(f"{c} {k}" for c, k in column_kinds(relation))
        return self._add(relation, self.spark.createDataFrame([tuple(r) for r in rows], schema))

    def distribute(self, relation: Relation, column: int, partitions: int | None = None) -> Engine:
        """Facts hash-partitioned by a column."""
        self.facts[relation.name] = redistribute(self.facts[relation.name], column, partitions)
        return self

    def clear(self, relation: Relation) -> Engine:
        self.facts.pop(relation.name, None)
        return self

    def clone(self) -> Engine:
        out = Engine(self.spark, self.pipeline)
        out.facts, out.relations = dict(self.facts), dict(self.relations)
        return out

    def _ring(self, compiled: Compiled) -> Semiring | None:
        rings = {s.name: s for r in compiled.relations.values() if (s := semiring_of(r.semiring))}
        if len(rings) > 1:
            raise LanguageError(f"one program, several semirings: {', '.join(rings)}")
        return next(iter(rings.values()), None)

    def _given(self, relation: Relation, ring: Semiring | None, once: bool) -> DataFrame:
        """The facts: without repetitions, if `once`, or with the annotations of repeated ones added up."""
        kinds = column_kinds(relation)
        keys = [c for c, _ in kinds]
        df = self.facts[relation.name]
        if ring is None:
            return df.select(*keys).distinct() if once else df.select(*keys)
        one = F.lit(ring.one).cast(ring.type)
        df = df.select(*keys, (F.coalesce(F.col(PROV), one) if PROV in df.columns else one).alias(PROV))
        return df.groupBy(*keys).agg(ring.add(F.col(PROV)).alias(PROV))

    def run(self, program: Program, max_iterations: int = 0, allow_negative_cycles: bool = False, annotations: bool = True) -> Result:
        """Derives everything. max_iterations: of each recursive stratum, 0 for no limit. Relations without facts or rules are empty."""
        compiled = compile_program(program, self.pipeline, allow_negative_cycles)
        ring = self._ring(compiled) if annotations else None
        state = Evaluation(compiled, Tables(self.spark), ring, column_kinds, max_iterations)
        # heads are made sets anyway, so facts are only where their number counts: that saves a shuffle of each source
        counted = {a.rel for r in compiled.rules for c in r.body if (a := atom_of(c)) and (r.count or isinstance(c, Agg))}
        for r in compiled.relations.values():
            if r.name in self.facts:
                state.full[r.name] = self._given(r, ring, r.name in counted)
                if ring is None and r.name not in counted:
                    state.raw.add(r.name)
            else:
                empty = ", ".join(f"{c} {k}" for c, k in column_kinds(r)) + (f", {PROV} {ring.type}" if ring else "")
                state.full[r.name] = self.spark.createDataFrame([], empty)
                state.given_nothing.add(r.name)
        state.run()
        sets = {n: df.distinct() if n in state.raw else df for n, df in state.full.items()}
        out = Result(sets, state.counts, state.iterations, compiled)
        for r in compiled.relations.values():
            if r.output_file:
                write_facts(out[r.name].drop(PROV), r.output_file)
        return out


def explain(program: Program, mode: str = "json") -> str:
    """The compiled program: strata, rules, variants and their clause orders; as JSON, HTML, or a line each."""
    compiled = compile_program(program)
    if mode == "html":
        return "\n".join(_as_html(compiled.describe()))
    if mode == "json":
        return compiled.json()
    return "\n".join(f"{'rec' if p.stratum.is_recursive else 'base'} {{{', '.join(p.stratum.relations)}}}: {v.rule.name} delta={v.delta} order={list(v.order)}" for p in compiled.plans for v in (*p.base, *p.recursive))


def _as_html(told: dict) -> Iterable[str]:
    """Relations as a table, and a part for each stratum with its rules; no scripts, so that it shows in a notebook."""
    safe = entities.escape
    yield "<table><tr><th>relation</th><th>columns</th><th>semiring</th><th>file</th></tr>"
    for r in told["relations"]:
        yield f"<tr><td>{safe(r['name'])}</td><td>{safe(', '.join(r['types']))}</td><td>{safe(r['semiring'])}</td><td>{safe(r['input_file'])}</td></tr>"
    yield "</table>"
    for k, s in enumerate(told["strata"]):
        yield f"<details open><summary>stratum {k}: {safe(', '.join(s['relations']))}{' (recursive)' if s['recursive'] else ''}</summary><ol>"
        for v in (*s["base"], *s["variants"]):
            changed = f", change in clause {v['delta']}" if v["delta"] >= 0 else ""
            yield f"<li title='{safe(v['where'], quote=True)}'><b>{safe(v['rule'])}</b>{' (counted)' if v['count'] else ''}: <code>{safe(v['text'])}</code> clauses {v['clause_order']}{changed}</li>"
        yield "</ol></details>"


def run(spark: SparkSession, program: Program, facts: dict[Relation, DataFrame] | None = None, load: Callable[[Engine], object] | None = None, **options) -> Result:
    engine = Engine(spark)
    for relation, df in (facts or {}).items():
        engine.bind(relation, df)
    if load:
        load(engine)
    return engine.run(program, **options)
