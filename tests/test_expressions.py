import pytest
from pyspark.sql import functions as F

from quarrylog.functions.expressions import ExpressionError, column_of, condition_of, names_in


@pytest.mark.parametrize(
    ("code", "value"),
    [
        ("return 7 / 2;", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("a * 10 + b", 73), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("1 << 4 | 3", 19), ("a & 6 ^ 1", 7),
        ("~a", -8), ("a > b ? a : b", 7), ("a > 1 && b > 5 || !(a == 7) ? 1 : 0", 0), ("(int)a + static_cast<long>(b)", 10), ("std::max(a, b) - min(a, b)", 4), ("abs(b - a)", 4),
        ("7 / 2.0", 3.5), ("d * 2", 3.0), ("9007199254740993 / 1", 9007199254740993), ("a >> 1", 3), ("10u + 1L", 11), ("true ? 1 : 2", 1), ('s == "x" ? 1 : 0', 1),
    ],
)
def test_values_are_those_of_c(spark, code, value):
    df = spark.sql("SELECT CAST(7 AS BIGINT) a, CAST(3 AS BIGINT) b, 1.5D d, 'x' s")
    assert df.select(column_of(code, dict(df.dtypes))).first()[0] == value


def test_conditions_and_functions(spark):
    df = spark.range(10).withColumnRenamed("id", "a")
    assert df.where(condition_of("a", dict(df.dtypes))).count() == 9
    assert df.where(condition_of(lambda c: c % 2 == 0, {}, ("a",))).count() == 5
    assert df.select(F.sum(column_of("a + 1", dict(df.dtypes)))).first()[0] == 55


@pytest.mark.parametrize("code", ["", "a +", "b", "a $ 1", "foo(a)", "(a", "a b"])
def test_what_is_no_expression_is_rejected(spark, code):
    with pytest.raises(ExpressionError):
        column_of(code, {"a": "bigint"})


def test_names():
    assert names_in('return x * 10 + abs(y) - (int)z; "w"') == {"x", "y", "z"}
