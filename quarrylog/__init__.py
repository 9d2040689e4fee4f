"""A Datalog analytics engine on Spark DataFrames."""

from .engine import Engine, Result, explain, run
from .language import SPLIT, Agg, Atom, Code, Const, Filter, LanguageError, Let, PlanEntry, Program, Relation, Rule, Var, agg, count, cpp, sum
from .plans.compiler import PassInfo, PassLevel, Pipeline, compile_program
from .plans.rewrites import load_meta, resolve_consts
from .plans.stratify import UnstratifiableProgram

#: Under the names that programs of the rule language use for these steps.
compile_to_hir = compile_program
resolve_program_consts = resolve_consts

__all__ = ["Agg", "Atom", "Code", "Const", "Engine", "Filter", "LanguageError", "Let", "PassInfo", "PassLevel", "Pipeline", "PlanEntry", "Program", "Relation", "Result", "Rule", "SPLIT", "UnstratifiableProgram", "Var", "agg", "compile_program", "compile_to_hir", "count", "cpp", "explain", "load_meta", "resolve_consts", "resolve_program_consts", "run", "sum"]
