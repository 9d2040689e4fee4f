import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylog import SPLIT, Agg, Const, Engine, Filter, LanguageError, Let, Program, Relation, Var, agg, count, cpp, run
from quarrylog import sum as total
from quarrylog.operators import body, fixpoint
from quarrylog.operators.fixpoint import NotSettled
from quarrylog.sources.delimited import detect_delimiter

from .naive import evaluate, valuations

builtins_sum = sum
E, F2, P, Q, G = Relation("E", 2), Relation("F", 2), Relation("P", 2), Relation("Q", 1), Relation("G", 2)
x, y, z, w, _ = Var("x"), Var("y"), Var("z"), Var("w"), Var("_")


def rows(result, name):
    return {tuple(r) for r in result[name].collect()}


def engine(spark, **facts):
    out = Engine(spark)
    for name, tuples in facts.items():
        out.add_facts({"E": E, "F": F2, "G": G}[name], tuples)
    return out


#: Strata of rules with Python functions as expressions, and the relations to compare.
PROGRAMS = {
    "closure": ([[P(x, y) <= E(x, y), P(x, z) <= P(x, y) & E(y, z)]], ["P"]),
    "nonlinear": ([[P(x, y) <= E(x, y), P(x, z) <= P(x, y) & P(y, z)]], ["P"]),
    "mutual": ([[P(x, y) <= E(x, y), G(x, z) <= P(x, y) & F2(y, z), P(x, z) <= G(x, y) & E(y, z)]], ["P", "G"]),
    "same generation": ([[P(x, y) <= E(z, x) & E(z, y) & Filter(("x", "y"), lambda a, b: a != b), P(x, y) <= E(z, x) & P(z, w) & E(w, y)]], ["P"]),
    "triangle": ([[P(x, y) <= E(x, y) & E(y, z) & E(z, x)]], ["P"]),
    "clique": ([[P(x, y) <= E(x, y) & E(y, z) & E(x, z) & E(x, w) & E(y, w) & E(z, w)]], ["P"]),
    "square": ([[P(x, z) <= E(x, y) & F2(y, z) & E(z, w) & F2(w, x)]], ["P"]),
    "labeled triangle": ([[P(x, z) <= E(x, y) & F2(y, z) & E(z, x) & F2(x, w) & F2(y, w) & F2(z, w) & Filter(("x", "z"), lambda a, b: a != b)]], ["P"]),
    "recursive triangle": ([[P(x, y) <= E(x, y), P(x, z) <= P(x, y) & E(y, z) & F2(z, x)]], ["P"]),
    "cycle through a constant": ([[Q(x) <= E(x, y) & F2(y, Const(1)) & F2(x, y) & E(y, x)]], ["Q"]),
    "repeated": ([[Q(x) <= E(x, x) & F2(x, x)]], ["Q"]),
    "negation": ([[P(x, y) <= E(x, y), P(x, z) <= P(x, y) & E(y, z)], [Q(x) <= E(x, _) & ~P(x, x) & ~F2(_, x)]], ["P", "Q"]),
    "negated constant": ([[Q(x) <= E(x, _) & ~F2(x, Const(1))]], ["Q"]),
    "cross": ([[P(x, y) <= E(x, _) & F2(_, y)]], ["P"]),
    "heads": ([[(P(x, y) | G(y, y) | Q(x)) <= E(x, z) & F2(z, y)]], ["P", "G", "Q"]),
    "recursive heads": ([[(Q(y) | P(x, y)) <= Q(x) & E(x, y), Q(x) <= F2(x, Const(0))]], ["P", "Q"]),
    "counts": ([[P(x, y) <= E(x, _) & count("y", F2(x, z))]], ["P"]),
    "sums": ([[P(x, y) <= E(x, _) & total("y", F2(x, z))]], ["P"]),
    "least": ([[P(x, y) <= E(x, _) & agg("y", "min", F2(x, z))]], ["P"]),
    "lets": ([[P(x, w) <= E(x, y) & Let("w", lambda a: a * 2 + 1, ("y",)) & Filter(("w",), lambda a: a > 2)]], ["P"]),
    "constants": ([[P(x, Const(9)) <= E(Const(1), x), P(Const(3), x) <= F2(x, Const(2))]], ["P"]),
    "split": ([[P(x, z) <= E(x, y) & SPLIT & F2(y, z)]], ["P"]),
    "existence": ([[Q(x) <= E(x, _) & F2(_, _)]], ["Q"]),
    "ground": ([[Q(x) <= E(x, _) & ~F2(Const(0), Const(0))]], ["Q"]),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_programs_agree_with_plain_evaluation(spark, name):
    strata, heads = PROGRAMS[name]
    draw = random.Random(name)
    facts = {k: {(draw.randrange(6), draw.randrange(6)) for _ in range(12)} for k in ("E", "F")}
    expected = evaluate(strata, facts)
    got = engine(spark, E=facts["E"], F=facts["F"]).run(Program([r for rules in strata for r in rules]))
    for h in heads:
        assert rows(got, h) == expected.get(h, set()), h


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=10), st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=10))
def test_any_facts(spark, e, f):
    rules = [P(x, y) <= E(x, y), P(x, z) <= P(x, y) & P(y, z) & F2(z, _)]
    got = engine(spark, E=sorted(e), F=sorted(f)).run(Program(rules))
    assert rows(got, "P") == evaluate([rules], {"E": e, "F": f}).get("P", set())


def test_hints_change_nothing(spark):
    facts = {"E": {(0, 1), (1, 2), (2, 0), (2, 3)}, "F": {(1, 4), (3, 5)}}
    plain = P(x, w) <= E(x, y) & E(y, z) & F2(z, w)
    forms = [plain, plain.with_semi_join(), plain.with_plan(clause_order=(2, 1, 0), dedup_hash=True), plain.with_plan(var_order=("z", "y"), fanout=True, work_stealing=True, block_group=True, balanced_root=("E",))]
    found = [rows(engine(spark, **facts).run(Program([f])), "P") for f in forms]
    assert found[0] and all(f == found[0] for f in found)


def test_balanced_joins_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(body, "HEAVY", 3)
    draw = random.Random(2)
    e = {(draw.randrange(40), draw.choice([0, 0, 0, 1, 2])) for _ in range(60)} | {(1, None)}
    f = {(draw.choice([0, 0, 0, 0, 1, 2]), draw.randrange(40)) for _ in range(60)} | {(None, 1)}
    plain = P(x, z) <= E(x, y) & F2(y, z)
    expected = {(a, d) for a, b in e for c, d in f if b == c and b is not None}
    for rule in (plain, plain.with_plan(balanced_root=["y"], balanced_sources=["E", "F"])):
        assert rows(engine(spark, E=sorted(e, key=str), F=sorted(f, key=str)).run(Program([rule])), "P") == expected
    ring = [Relation(n, 2, semiring="Bag") for n in "EFP"]
    rule = (ring[2](x, z) <= ring[0](x, y) & ring[1](y, z)).with_plan(balanced_root=["y"])
    got = Engine(spark).add_facts(ring[0], [r for r in e if r[1] is not None]).add_facts(ring[1], [r for r in f if r[0] is not None]).run(Program([rule]))["P"].collect()
    assert {tuple(r) for r in got} == {(a, d, builtins_sum((a, k) in e and (k, d) in f for k in range(3))) for a, d in expected}


def test_facts_are_sets_and_derived_relations_may_have_some(spark):
    got = Engine(spark).add_facts(E, [(1, 2), (1, 2)]).add_facts(P, [(7, 7), (1, 2)]).run(Program([P(x, y) <= E(x, y)]))
    assert sorted(map(tuple, got["P"].collect())) == [(1, 2), (7, 7)] and got.size("P") == 2


def test_counts_are_of_valuations(spark):
    program = Program([(P(x, y) <= E(x, y) & F2(y, _)).named("n").with_count(), (Q(x) <= E(x, _)).named("m").with_count()])
    got = engine(spark, E=[(0, 1), (2, 1)], F=[(1, 5), (1, 6)]).run(program)
    assert got.counts == {"n": 4, "m": 2} and got.size("P") == 0


COUNTED = {
    "star": P(x, y) <= E(x, y) & E(x, z) & F2(x, w),
    "chain": P(x, w) <= E(x, y) & F2(y, z) & E(z, w),
    "triangle": P(x, y) <= E(x, y) & E(y, z) & E(z, x),
    "wild": Q(x) <= E(x, _) & F2(_, x),
    "product": P(x, y) <= E(x, _) & F2(y, _),
    "filtered": P(x, z) <= E(x, y) & F2(y, z) & Filter(("x", "z"), lambda a, b: a != b) & ~E(z, x),
    "ground": Q(x) <= E(x, Const(1)) & F2(_, Const(2)),
    "split": P(x, z) <= E(x, y) & SPLIT & F2(y, z),
    "let": P(x, w) <= E(x, y) & Let("w", lambda a: a + 1, ("y",)) & Filter(("w",), lambda a: a > 2) & F2(y, z),
}


@pytest.mark.parametrize("name", COUNTED)
def test_counts_agree_with_plain_valuations(spark, name):
    draw = random.Random(name)
    facts = {k: {(draw.randrange(5), draw.randrange(5)) for _ in range(11)} for k in ("E", "F")}
    got = engine(spark, **{k: [*v, *v] for k, v in facts.items()}).run(Program([COUNTED[name].named("n").with_count()]))
    rule = COUNTED[name]
    named = rule if name not in ("wild", "product", "ground") else {"wild": Q(x) <= E(x, y) & F2(z, x), "product": P(x, y) <= E(x, z) & F2(y, w), "ground": Q(x) <= E(x, Const(1)) & F2(y, Const(2))}[name]
    assert got.counts["n"] == len(valuations(named, facts))


def test_iterations_can_be_limited(spark):
    rules = [P(x, y) <= E(x, y), P(x, z) <= P(x, y) & E(y, z)]
    got = engine(spark, E=[(k, k + 1) for k in range(12)]).run(Program(rules), max_iterations=2)
    assert max(b - a for a, b in rows(got, "P")) == 3 and got.iterations[("P",)] == 2


def test_long_chains_are_compacted(spark):
    rules = [P(x, y) <= E(x, y), P(x, z) <= P(x, y) & E(y, z)]
    got = engine(spark, E=[(k, (k + 1) % 14) for k in range(14)]).run(Program(rules))
    assert got.size("P") == 196


@pytest.mark.parametrize("few", [0, 3, 10**6])
def test_much_that_is_known_stays_where_it_is(spark, monkeypatch, few):
    monkeypatch.setattr(fixpoint, "LARGE", 5)
    monkeypatch.setattr(fixpoint, "FEW", few)
    draw = random.Random(5)
    for name in ("nonlinear", "mutual", "recursive triangle"):
        strata, heads = PROGRAMS[name]
        facts = {k: {(draw.randrange(7), draw.randrange(7)) for _ in range(14)} for k in ("E", "F")}
        got = engine(spark, E=facts["E"], F=facts["F"]).run(Program([r for rules in strata for r in rules]))
        expected = evaluate(strata, facts)
        assert all(rows(got, h) == expected.get(h, set()) for h in heads)
    test_annotated_recursion(spark)


def test_hooks_see_every_iteration(spark):
    seen = []
    rules = [P(x, y) <= E(x, y), (P(x, z) <= P(x, y) & E(y, z)).with_hook(lambda c: seen.append((c.iteration, c.relation("P").count())))]
    engine(spark, E=[(0, 1), (1, 2), (2, 3)]).run(Program(rules))
    assert [k for k, _ in seen] == [1, 2, 3]


def test_types(spark):
    people, old = Relation("People", 3, (str, int, float)), Relation("Old", 2, (str, float))
    program = Program([old(x, z) <= people(x, y, z) & Filter(("y",), "y >= 40") & Filter(("x",), 'x != "c"')])
    got = Engine(spark).add_facts(people, [("a", 41, 1.5), ("b", 12, 2.5), ("c", 50, 0.5), (None, 60, 1.0)]).run(program)
    assert rows(got, "Old") == {("a", 1.5)}


def test_null_keys_never_join(spark):
    got = engine(spark, E=[(1, None), (1, 2)], F=[(None, 3), (2, 4)]).run(Program([P(x, z) <= E(x, y) & F2(y, z)]))
    assert rows(got, "P") == {(1, 4)}


def test_computed_terms(spark):
    got = engine(spark, E=[(1, 2), (3, 4)]).run(Program([P(x, cpp("x * y")) <= E(x, y)]))
    assert rows(got, "P") == {(1, 2), (3, 12)}


@pytest.mark.parametrize(("ring", "notes", "expected"), [("NaturalBag", (2, 3, 5), 2 * 3 + 5 * 3), ("BooleanSR", (True, True, False), True), ("ProbIndep", (0.5, 0.5, 0.2), 1 - (1 - 0.25) * (1 - 0.1)), ("EnhancedIDSR", (4, 9, 6), 9)])
def test_annotations(spark, ring, notes, expected):
    a, b, out = Relation("A", 2, semiring=ring), Relation("B", 1, semiring=ring), Relation("Out", 1, semiring=ring)
    p, q, r = notes
    kind = "boolean" if ring == "BooleanSR" else "double" if ring == "ProbIndep" else "bigint"
    left = spark.createDataFrame([(1, 1, p), (1, 2, r)], f"x bigint, y bigint, n {kind}")
    right = spark.createDataFrame([(1, q), (2, q)], f"y bigint, n {kind}")
    made = Engine(spark).bind(a, left, "x", "y", annotation="n").bind(b, right, "y", annotation="n")
    ((_, got),) = made.run(Program([out(x) <= a(x, y) & b(y)]))["Out"].collect()
    assert got == pytest.approx(expected)


def test_annotated_recursion(spark):
    e, p = Relation("E", 2, semiring="BooleanSR"), Relation("P", 2, semiring="BooleanSR")
    df = spark.createDataFrame([(0, 1, True), (1, 2, False), (0, 2, True), (2, 0, True)], "x bigint, y bigint, n boolean")
    got = Engine(spark).bind(e, df, "x", "y", annotation="n").run(Program([p(x, y) <= e(x, y), p(x, z) <= p(x, y) & e(y, z)]))
    found = {(a, b): n for a, b, n in got["P"].collect()}
    assert found[0, 2] is True and found[1, 2] is False and found[0, 0] is True
    bag = Relation("E", 2, semiring="Bag")
    path = Relation("P", 2, semiring="Bag")
    with pytest.raises(NotSettled):
        Engine(spark).add_facts(bag, [(0, 1)]).run(Program([path(x, y) <= bag(x, y), path(x, z) <= path(x, y) & bag(y, z)]))


def test_custom_aggregate(spark):
    squares = Agg("y", "agg", F2(x, z), custom=lambda value: F.sum(value * value))
    got = engine(spark, E=[(1, 0), (2, 0)], F=[(1, 3), (1, 4)]).run(Program([P(x, y) <= E(x, _) & squares]))
    assert rows(got, "P") == {(1, 25)}


@pytest.mark.parametrize(("line", "sign"), [("1\t2,3", "\t"), ("1,2 3", ","), ("a b   c", " {2,}"), ("1 2", " "), ("1", " ")])
def test_delimiters(line, sign):
    assert detect_delimiter(line) == sign


@pytest.mark.parametrize("sep", ["\t", ",", "   ", " "])
def test_files(spark, tmp_path, sep):
    (tmp_path / "e.facts").write_text(f"\n1{sep}2{sep}extra\n\n 3{sep}4\n" if sep != " " else "1 2 extra\n\n3 4\n")
    out = tmp_path / "out"
    source, target = Relation("E", 2, input_file="e.facts"), Relation("P", 2, output_file=str(out), print_size=True)
    got = Engine(spark).load_all(Program([target(y, x) <= source(x, y)]), str(tmp_path)).run(Program([target(y, x) <= source(x, y)]))
    assert rows(got, "P") == {(2, 1), (4, 3)} and got.sizes == {"P": 2}
    assert sorted(line for f in out.glob("part-*") for line in f.read_text().split()) == ["2,1", "4,3"]


def test_results(spark):
    got = run(spark, Program([P(x, y) <= E(x, y)]), {E: spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")})
    assert got.contains("P", 1, 2) and not got.contains("P", 2, 1)
    assert got.matching("P", 1).count() == 2 and len(got.head("P", 1)) == 1 and got.named("P", "a", "b").columns == ["a", "b"]


def test_engines_are_cloned_cleared_and_distributed(spark):
    first = engine(spark, E=[(1, 2)])
    other = first.clone().add_facts(E, [(3, 4)]).distribute(E, 0, 3)
    program = Program([P(x, y) <= E(x, y)])
    assert first.run(program).size("P") == 1 and other.run(program).size("P") == 2
    assert other.clear(E).run(program).size("P") == 0
    with pytest.raises(LanguageError):
        first.bind(E, spark.range(3))


def test_compositions_of_a_relation_with_itself_need_one_variant(spark, monkeypatch):
    used, inner = [], fixpoint.Evaluation._heads
    monkeypatch.setattr(fixpoint.Evaluation, "_heads", lambda self, variants: used.append([v.delta for v in variants]) or inner(self, variants))
    strata, names = PROGRAMS["nonlinear"]
    draw = random.Random(7)
    facts = {"E": {(draw.randrange(30), draw.randrange(30)) for _ in range(40)} | {(k, k + 1) for k in range(30, 45)}}
    found = engine(spark, **facts).run(Program(strata[0]))
    assert rows(found, "P") == evaluate(strata, facts)["P"] and [0] in used and [0, 1] not in used


@pytest.mark.parametrize("steps, looked_up", [({(k, k + 2) for k in range(9)}, False), ({(0, 1), (1, 2), (2, 0)}, True), ({(0, 1), (0, 2), (1, 3), (2, 3)}, True)])
@pytest.mark.parametrize("name", ["closure", "mutual"])
def test_chains_are_not_looked_up(spark, monkeypatch, name, steps, looked_up):
    asked, inner = [], fixpoint.Evaluation._unknown
    monkeypatch.setattr(fixpoint.Evaluation, "_unknown", lambda self, *args: asked.append(args) or inner(self, *args))
    strata, names = PROGRAMS[name]
    facts = {"E": steps, "F": steps, "G": set()}
    found = engine(spark, E=sorted(steps), F=sorted(steps)).run(Program(strata[0]))
    expected = evaluate(strata, facts)
    for n in names:
        got = [tuple(r) for r in found[n].collect()]
        assert len(got) == len(set(got)) and set(got) == expected.get(n, set())
    assert bool(asked) == looked_up
