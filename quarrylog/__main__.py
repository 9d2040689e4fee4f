"""python -m quarrylog {info,explain,run} PROGRAM.py [--data DIR] [--meta JSON] [--entry NAME] [--plans JSON] [--as json|text|html] [--max-iter N] [--show RELATION]

PROGRAM.py has a module-level Program, or a function program() or build_*_program(), which may take the constants of --meta.
"""

from __future__ import annotations

import argparse
import importlib.util
import inspect
import json
import re
import sys
from pathlib import Path

from .engine import Engine, explain
from .language import Program
from .plans.compiler import compile_program
from .plans.rewrites import load_meta, resolve_consts


def find_program(path: str, meta: dict[str, int] | None = None, entry: str = "") -> Program:
    """The program that a Python file has or makes, under the name `entry`, if it is given; its named constants are resolved, if there
    is meta data."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    named = {n: v for n, v in vars(module).items() if n == entry or not entry}
    found = next((v for v in named.values() if isinstance(v, Program)), None)
    if found is None:
        makers = [f for n, f in named.items() if callable(f) and (n in ("program", entry) or re.fullmatch(r"build_\w*program", n))]
        if not makers:
            raise SystemExit(f"{path} has no {entry}" if entry else f"{path} has no Program, program() or build_*_program()")
        made = makers[0](meta or {}) if inspect.signature(makers[0]).parameters else makers[0]()
        found = made[0] if isinstance(made, tuple) else made
    return resolve_consts(found, meta) if meta else found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylog", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("info", "explain", "run"))
    parser.add_argument("program")
    parser.add_argument("--data", default=".", help="folder of the relations' input files")
    parser.add_argument("--meta", help="JSON file of named constants")
    parser.add_argument("--entry", default="", help="name of the program, or of the function that makes it")
    parser.add_argument("--plans", help="JSON file of other plans: rule names to lists of hints")
    parser.add_argument("--as", dest="form", choices=("json", "text", "html"), default="json", help="form of explain")
    parser.add_argument("--max-iter", type=int, default=0)
    parser.add_argument("--show", action="append", default=[], metavar="RELATION")
    args = parser.parse_args(argv)
    program = find_program(args.program, load_meta(args.meta) if args.meta else None, args.entry)
    if args.plans:
        program = program.planned(json.loads(Path(args.plans).read_text()))
    if args.command == "explain":
        print(explain(program, args.form))
        return 0
    if args.command == "info":
        compiled = compile_program(program)
        print(f"{len(compiled.relations)} relations, {len(compiled.rules)} rules, {len(compiled.plans)} strata; inputs: {', '.join(compiled.inputs)}")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(Path(args.program).stem).getOrCreate()
    result = Engine(spark).load_all(program, args.data).run(program, max_iterations=args.max_iter)
    derived = {h.rel for r in program.rules for h in r.heads}
    sizes = result.sizes or {n: result.size(n) for n in sorted(derived)}
    for name, n in (sizes | result.counts).items():
        print(f"{name}\t{n}")
    for name in args.show:
        result.show(name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
