"""Derived relations over a growing relation: every micro-batch adds facts, and what is newly derived goes to a sink.

Facts only grow, so for programs without negation and aggregates so do the derived relations, and each tuple is given out once. For
others the sink gets the tuples that were not derived before; those that are not derived any more are not taken back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine, column_kinds
from ..language import Program, Relation


def maintain(engine: Engine, program: Program, source: Relation, stream: DataFrame, target: Relation, sink: Callable[[DataFrame, int], object], checkpoint: str, max_iterations: int = 0) -> StreamingQuery:
    """Starts a query: the stream's columns are facts of `source`, and sink(new tuples of `target`, batch number) is called.

    What was given and derived is kept under `checkpoint`, beside the stream's own state, one part a batch: a query that is started again
    goes on from there, and a batch that is run again replaces its own part. The sink must bear a batch twice, as any of a stream.
    """
    spark = engine.spark
    kinds = column_kinds(source)
    schema = ", ".join(f"{c} {k}" for c, k in kinds)
    root = f"{checkpoint.rstrip('/')}/relations"

    def step(batch: DataFrame, number: int) -> None:
        facts = batch.toDF(*(c for c, _ in kinds)).selectExpr(*(f"cast({c} as {k}) as {c}" for c, k in kinds))
        facts.write.mode("overwrite").parquet(f"{root}/given/batch={number}")
        given = spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/given").where(F.col("batch") <= number).drop("batch")
        derived = engine.clone().bind(source, given).run(program, max_iterations)[target]
        if _batches(spark, f"{root}/known") - {number}:
            known = spark.read.schema(f"{derived.schema.toDDL()}, batch bigint").parquet(f"{root}/known").where(F.col("batch") < number)
            derived = derived.join(known.drop("batch"), derived.columns, "left_anti")
        path = f"{root}/known/batch={number}"
        derived.write.mode("overwrite").parquet(path)
        sink(spark.read.schema(derived.schema).parquet(path), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def _batches(spark, path: str) -> set[int]:
    """The numbers of the parts that are there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch=")} if fs.exists(folder) else set()
