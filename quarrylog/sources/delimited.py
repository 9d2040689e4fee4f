"""Delimited text files of facts: the delimiter is told from the first line, columns are read by the relation's types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_delimiter(line: str) -> str:
    """A pattern: tab, else comma, else two or more spaces, else one space."""
    if "\t" in line:
        return "\t"
    if "," in line:
        return ","
    return " {2,}" if re.search(r"\S {2,}\S", line) else " "


def _parsed(field: Column, kind: str) -> Column:
    text = F.trim(field)
    if kind == "string":
        return text
    return F.when(text.rlike("(?i)^(true|1)$"), True).when(text.rlike("(?i)^(false|0)$"), False) if kind == "boolean" else text.try_cast(kind)


def read_facts(spark: SparkSession, path: str, kinds: list[tuple[str, str]], delimiter: str | None = None) -> DataFrame:
    """The file's, or files', rows as (c0, c1, ...). Blank lines are skipped, further columns ignored, and fields trimmed; a field
    that is missing or cannot be read as its type is null. Only the first line that is not blank comes to the driver."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if delimiter is None:
        first = lines.first()
        delimiter = detect_delimiter(first.value) if first else "\t"
    body = F.trim("value") if delimiter.startswith(" ") else F.col("value")
    fields = F.split(F.regexp_replace(body, r"\r$", ""), delimiter)
    return lines.select(fields.alias("f")).select(*(_parsed(F.get("f", F.lit(k)), t).alias(c) for k, (c, t) in enumerate(kinds)))


def write_facts(df: DataFrame, path: str, single_file: bool = False, sep: str = ",") -> None:
    """As delimited text without a header. Into one file only if asked for, as that is one task's work."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, sep=sep)


def redistribute(df: DataFrame, column: int, partitions: int | None = None) -> DataFrame:
    """The relation hash-partitioned by one column, for joins on it."""
    return df.repartition(partitions, F.col(f"c{column}")) if partitions else df.repartition(F.col(f"c{column}"))
