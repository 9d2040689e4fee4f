import json

import pytest

from quarrylog import Engine, LanguageError, PlanEntry, Program, Relation, Var
from quarrylog.__main__ import find_program, main
from quarrylog.streaming import maintain

SOURCE = '''
from quarrylog import Const, Program, Relation, Var
def build_small_program(meta):
    e, p = Relation("E", 2, input_file="e.csv"), Relation("P", 2, print_size=True)
    x, y, z = map(Var, "xyz")
    return Program([p(x, y) <= e(x, y), p(x, z) <= p(x, y) & e(y, z), p(x, x) <= e(x, Const("LAST"))])
'''


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "prog.py").write_text(SOURCE)
    (tmp_path / "e.csv").write_text("1,2\n2,3\n")
    (tmp_path / "meta.json").write_text(json.dumps({"LAST": 3}))
    assert len(find_program(str(tmp_path / "prog.py")).rules) == 3
    meta = ["--meta", str(tmp_path / "meta.json")]
    assert main(["info", str(tmp_path / "prog.py"), *meta]) == 0
    assert "2 relations, 3 rules, 1 strata; inputs: E" in capsys.readouterr().out
    assert main(["explain", str(tmp_path / "prog.py"), *meta]) == 0
    assert json.loads(capsys.readouterr().out)["strata"]
    assert main(["run", str(tmp_path / "prog.py"), "--data", str(tmp_path), *meta, "--show", "P"]) == 0
    out = capsys.readouterr().out
    assert "P\t4" in out


def test_programs_are_shown_and_planned_anew(tmp_path, capsys):
    (tmp_path / "prog.py").write_text(SOURCE.replace("p(x, y) <= e(x, y), p(x, z)", "(p(x, y) <= e(x, y)).named('first'), p(x, z)") + "\ndef other(meta):\n    return build_small_program(meta)\n")
    program = find_program(str(tmp_path / "prog.py"), entry="other")
    assert program.rules[0].where.endswith("prog.py:6")
    assert "<code>P(x, y) &lt;= E(x, y)</code>" in program._repr_html_()
    with pytest.raises(SystemExit):
        find_program(str(tmp_path / "prog.py"), entry="none")
    (tmp_path / "plans.json").write_text(json.dumps({"first": [{"delta": -1, "var_order": ["y", "x"]}]}))
    assert program.planned(json.loads((tmp_path / "plans.json").read_text())).rules[0].plans == (PlanEntry(var_order=("y", "x")),)
    with pytest.raises(LanguageError):
        program.planned({"none": []})
    assert main(["explain", str(tmp_path / "prog.py"), "--entry", "other", "--plans", str(tmp_path / "plans.json"), "--as", "text"]) == 0
    assert "first delta=-1" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    e, p = Relation("E", 2), Relation("P", 2)
    x, y, z = map(Var, "xyz")
    program = Program([p(x, y) <= e(x, y), p(x, z) <= p(x, y) & e(y, z)])
    folder = tmp_path / "in"
    seen = {}
    for rows in ([(1, 2), (2, 3)], [(3, 4), (1, 2)], [(4, 5)]):
        spark.createDataFrame(rows, "a bigint, b bigint").coalesce(1).write.mode("append").parquet(str(folder))
        if len(seen) in (0, 2):  # the third part meets a query that is started again
            stream = spark.readStream.schema("a bigint, b bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))
            query = maintain(Engine(spark), program, e, stream, p, lambda df, n: seen.__setitem__(n, {tuple(r) for r in df.collect()}), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        if len(seen) == 2:
            query.stop()
    query.stop()
    batches = [seen[n] for n in sorted(seen) if seen[n]]
    assert batches == [{(1, 2), (2, 3), (1, 3)}, {(3, 4), (2, 4), (1, 4)}, {(4, 5), (3, 5), (2, 5), (1, 5)}]
