"""Rules for pairs, dealt to cells: the same pairs, each once, and none of them moved."""

import random

import pytest

from quarrylog import Const, Engine, Filter, Program, Relation, Var
from quarrylog.operators import cells

from .naive import evaluate

E, F2, Q, P = Relation("E", 2), Relation("F", 2), Relation("Q", 1), Relation("P", 2)
x, y, z, w, _ = map(Var, ("x", "y", "z", "w", "_"))
LESS = Filter(("x", "w"), lambda a, b: a < b)

PROGRAMS = {
    "diamond": [P(x, w) <= E(x, y) & E(x, z) & E(y, z) & E(y, w) & E(z, w) & LESS],
    "shared": [P(x, w) <= E(x, y) & F2(w, y) & LESS],
    "one end": [P(w, x) <= E(x, y) & Q(w) & LESS],
    "product less pairs": [P(x, w) <= Q(x) & F2(w, _) & ~E(w, x)],
    "shared less pairs": [P(x, w) <= F2(x, y) & F2(w, y) & ~E(x, w) & ~E(y, Const(1))],
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_pairs_in_cells(spark, monkeypatch, name):
    monkeypatch.setattr(cells, "PAIRS", 2)
    monkeypatch.setattr(cells, "COUNTED_BYTES", 1 << 70)  # of rows from Python the size is not known
    dealt, inner = [], cells._dealt
    monkeypatch.setattr(cells, "_dealt", lambda *args: dealt.append(args) or inner(*args))
    draw = random.Random(5)
    facts = {n: {(draw.randrange(40), draw.randrange(4) if draw.random() < 0.6 else draw.randrange(40)) for _ in range(150)} for n in "EF"} | {"Q": {(k,) for k in range(0, 40, 3)}}
    engine = Engine(spark)
    for rel in (E, F2, Q):
        engine.add_facts(rel, [*facts[rel.name]] * 2)
    found = [tuple(r) for r in engine.run(Program(PROGRAMS[name]))["P"].collect()]
    expected = evaluate([PROGRAMS[name]], facts)["P"]
    assert dealt and len(found) == len(set(found)) and set(found) == expected



@pytest.mark.parametrize("name", ["diamond", "product less pairs"])
def test_pairs_are_not_moved(spark, monkeypatch, name):
    monkeypatch.setattr(cells, "PAIRS", 2)
    monkeypatch.setattr(cells, "COUNTED_BYTES", 1 << 70)  # of rows from Python the size is not known
    engine = Engine(spark)
    for rel in (E, F2, Q):
        engine.add_facts(rel, [(k, k % 3)[: rel.arity] for k in range(60)])
    df = engine.run(Program(PROGRAMS[name]))["P"]
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in text and not text.split("Join")[0].count("Exchange"), text
