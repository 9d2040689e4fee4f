"""A Datalog evaluator over Python sets, as plain as can be: the oracle for programs without expressions in C."""

from itertools import product

from quarrylog.language import Agg, Atom, Const, Filter, Let, Negation, Var


def _matches(atom, tuples, env):
    for row in tuples:
        new = dict(env)
        for term, value in zip(atom.terms, row, strict=True):
            if isinstance(term, Const):
                if term.value != value:
                    break
            elif not term.wild and new.setdefault(term.name, value) != value:
                break
        else:
            yield new


def valuations(rule, facts):
    envs = [{}]
    for c in rule.body:
        if isinstance(c, Atom):
            envs = [e for env in envs for e in _matches(c, facts.get(c.rel, set()), env)]
    for c in rule.body:
        if isinstance(c, Agg):
            out = []
            for env in envs:
                rows = {tuple(r) for r in facts.get(c.atom.rel, set()) if any(True for _ in _matches(c.atom, [r], env))}
                free = [i for i, t in enumerate(c.atom.terms) if isinstance(t, Var) and t.name not in env]
                values = [r[free[-1]] if free else 0 for r in rows]
                made = {"count": len(rows), "exists": bool(rows), "sum": sum(values), "min": min(values, default=None), "max": max(values, default=None)}[c.func]
                if made is not None:
                    out.append(env | {c.result: made})
            envs = out
        if isinstance(c, Let):
            envs = [env | {c.var: c.code(*(env[d] for d in c.deps))} for env in envs]
    for c in rule.body:
        if isinstance(c, Filter):
            envs = [env for env in envs if c.code(*(env[v] for v in c.vars))]
        if isinstance(c, Negation):
            envs = [env for env in envs if not any(True for _ in _matches(c.atom, facts.get(c.atom.rel, set()), env))]
    return envs


def evaluate(strata, facts):
    """facts after all rules of each stratum were applied until nothing is new."""
    facts = {k: set(v) for k, v in facts.items()}
    for rules in strata:
        while True:
            new = {(h.rel, tuple(t.value if isinstance(t, Const) else env[t.name] for t in h.terms)) for r in rules for env in valuations(r, facts) for h in r.heads}
            new = {(rel, row) for rel, row in new if row not in facts.setdefault(rel, set())}
            if not new:
                break
            for rel, row in new:
                facts[rel].add(row)
    return facts


def all_tuples(n, arity):
    return set(product(range(n), repeat=arity))
